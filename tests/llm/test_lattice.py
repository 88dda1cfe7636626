import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bauwerk.llm import lattice
from bauwerk.llm.shared import id_crc


def brute(pieces, word):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = sum(pieces.weights[word[:k]] * brute(pieces, word[k:]) for k in range(1, len(word) + 1) if word[:k] in pieces.weights)
    if word[0] not in pieces.weights:
        total += math.prod(pieces.bytes[b] for b in word[0].encode()) * brute(pieces, word[1:])
    return total


@pytest.fixture(scope="module")
def toy():
    s = lattice.START
    return lattice.Pieces({s: 1, s + "a": 2, "a": 3, "b": 1, "ab": 2, "bab": 1, s + "ba": 1}, [0.1] * 256, 0.5)


def test_forward_recursion_sums_all_segmentations(toy):
    for word in ("a", "ab", "babab", "zab", "ü", "bé" * 3):
        assert toy.log_probability(word) == pytest.approx(math.log(brute(toy, lattice.START + word)))


def test_long_words_agree_with_short_ones(toy, monkeypatch):
    short = toy.log_probability("abbab" * 4)
    counts, long_counts = {}, {}
    toy.expect("abzab", 3, counts)
    monkeypatch.setattr(lattice, "SHORT", 0)
    assert toy.log_probability("abbab" * 4) == pytest.approx(short)
    toy.expect("abzab", 3, long_counts)
    assert long_counts == pytest.approx(counts)
    assert math.isfinite(toy.log_probability("ab" * 5000))


UNKNOWN = [("\U0001d400", 16), ("\U0001f9e8", 16), ("\u1013", 22), ("\u0f84", 22), ("\u1100", 22), ("\u1100", 31), ("\U0001f9e8", 31)]


def test_short_words_that_underflow_as_probabilities(monkeypatch):
    pieces = lattice.read_pieces()
    words = [c * n for c, n in UNKNOWN] + ["the" + "\u1013" * 15, "\U0001d400" * 8, "plain"]
    logs, counts = [pieces.log_probability(w) for w in words], []
    for w in words:
        pieces.expect(w, 3, into := {})
        counts.append(into)
    monkeypatch.setattr(lattice, "SHORT", 0)
    assert all(map(math.isfinite, logs)) and logs == pytest.approx([pieces.log_probability(w) for w in words])
    for w, got in zip(words, counts):
        pieces.expect(w, 3, into := {})
        assert {k: v for k, v in got.items() if v > 1e-12} == pytest.approx({k: v for k, v in into.items() if v > 1e-12})


@pytest.mark.parametrize("held_out", ["doc_id >= 100", "doc_id < 100"])
def test_rare_characters_in_training_and_held_out_rows(spark, held_out):
    rows = [(i, "common words " + c * n) for i, (c, n) in enumerate(UNKNOWN)] + [(100 + i, "other common words " + chr(0x1D401) * n) for i, n in enumerate(range(16, 32))]
    got = lattice.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.expr(held_out)).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_scores_of_documents(spark):
    rows = [(i, " ".join(["The", "cat", f"sat{i % 4}", "on"] * (1 + i % 3))) for i in range(60)] + [(70, None), (71, ""), (None, "Null id here"), (3, "The cat"), (72, "w" * 5000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, mark int, key string")
    got = lattice.score_documents(docs, id_crc() % 7 == 2).collect()
    assert len(got) == len(rows)
    out = lambda k: zlib.crc32(str(k).encode() if k is not None else b"") % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for k, t in rows if not out(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), out(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_learned_pieces_beat_the_vocabulary_s_own(spark):
    start = lattice.read_pieces()
    rows = [(i, "common words repeat often in these common texts") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice.score_documents(docs, F.col("doc_id") % 5 == 0, start).collect()}
    plain = sum(start.log_probability(w) for w in rows[0][1].split()) / lattice.LOG10 + math.log10(start.end)
    assert got[0] > plain + 5


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.score_documents(docs, id_crc() % 7 == 2).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lattice.score_documents(docs, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0 and row.score < 0
