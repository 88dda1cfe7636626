import hashlib
import sys

import public_tokenizers
import pytest
import tiktoken

from bauwerk.llm import bytebpe


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.load_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_split_is_the_library_s_on_every_character(vocabulary, library):
    for base in range(0, sys.maxunicode, 4096):
        text = "".join(f"a{chr(c)}1 {chr(c)}b" for c in range(base, min(base + 4096, sys.maxunicode)) if not 0xD800 <= c < 0xE000)
        ids = [i for piece in vocabulary.split(text) for i in vocabulary.encode_piece(piece.encode())]
        assert ids == library.encode_ordinary(text)


def test_encode_and_decode(spark, vocabulary, library):
    texts = ["Hello  world's \n\n end", None, "", " ", "a" * 3000, "ünï <|endoftext|> 東京 123!!", "x\0y", "same", "same", "word " * 20000]
    rows = [(i, t, i, b"x", [1]) for i, t in enumerate(texts)] + [(None, "null id", 1, b"", []), (7, "same", 2, b"", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, ids binary, key array<int>")
    got = bytebpe.digests(bytebpe.decode(bytebpe.encode(docs, vocabulary), vocabulary)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table_and_small_blocks(spark, vocabulary, library, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.decode(bytebpe.encode(docs, vocabulary), vocabulary).count() == 0
    rows = [(i, f"word{i % 13} of {i}\n") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bytebpe.encode(docs, vocabulary).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in rows}


def test_coder_gives_the_pattern_s_pieces(vocabulary):
    import random

    rnd = random.Random(3)
    letters = [chr(c) for c in range(0x21, 0x260)] + ["ß", "Ω", "東", "'s", "'re", "12", "́", " ", " "]
    coder, texts = bytebpe.PieceCoder(vocabulary), [""]
    for c in range(0x21, 0x300):
        texts += [f"a {chr(c)} b{chr(c)} {chr(c)}. {chr(c)}{chr(c)}, x{chr(c)}y!"]
    for _ in range(1500):
        texts.append("".join(rnd.choice([" ", " ", "\n", "  ", "a", "be", "!", ",", rnd.choice(letters)]) for _ in range(rnd.randint(0, 40))))
    codes, sizes = coder.finish([coder.codes(t) for t in texts])
    words, at = coder.words(), 0
    for text, size in zip(texts, sizes):
        assert [words[c].decode() for c in codes[at : at + size]] == vocabulary.split(text), repr(text)
        at += size


def test_another_pattern_has_no_path_for_words():
    ranks = {bytes([b]): b for b in range(256)}
    vocabulary = bytebpe.Vocabulary(ranks, r"\p{L}| |[^\p{L} ]+")
    coder = bytebpe.PieceCoder(vocabulary)
    codes, _ = coder.finish([coder.codes("ab cd!")])
    assert [coder.words()[c] for c in codes] == [b"a", b"b", b" ", b"c", b"d", b"!"]
