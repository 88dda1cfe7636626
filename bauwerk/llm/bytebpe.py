"""Operator 10: byte-level BPE encoding and decoding through a global shuffle of distinct pre-tokens."""

from __future__ import annotations

import base64
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .shared import documents, partitions_for


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file, one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Ranks and pattern, read on the driver and sent along; a vocabulary file bounds its size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self._encoding = self._split = self._bytes = None
        #: A blank and letters are one pre-token, a mark behind them another.
        self.words_of_letters = all(x in pattern.split("|") for x in (r" ?\p{L}+", r" ?[^\s\p{L}\p{N}]+"))

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def encode_piece(self, piece: bytes) -> list[int]:
        if self._encoding is None:
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding._core_bpe.encode_single_piece(piece)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; white space is Unicode's own property."""
        if self._split is None:
            bare = self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
            self._split = regex.compile(bare).findall
        return self._split(text)

    def token_bytes(self) -> list[bytes]:
        if self._bytes is None:
            self._bytes = [b""] * (max(self.ranks.values(), default=-1) + 1)
            for token, rank in self.ranks.items():
                self._bytes[rank] = token
        return self._bytes


class PieceCoder:
    """Codes of a text's pre-tokens.

    A pre-token never reaches over a blank that has a character other than white space on either side, and begins there.
    So a text without blanks that stand between white space or behind it at the end is cut at its blanks, and each distinct chunk is split by the
    pattern once; other texts are split whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.split, self.index = vocabulary.split, blocks.Index()
        self.plain = vocabulary.words_of_letters
        #: Pre-tokens of each chunk, one chunk after the other, and how many each has.
        self.flat, self.lengths = array("i"), array("i")
        self.chunks, self.single = _Chunks(self), _Single(self)

    def add(self, pieces: list[str]) -> int:
        self.flat.extend(map(self.index.__getitem__, pieces))
        self.lengths.append(len(pieces))
        return len(self.lengths) - 1

    def codes(self, text: str) -> np.ndarray:
        """Numbers of the text's chunks; finish() puts their pre-tokens in their place."""
        if _BETWEEN.search(text):
            return np.fromiter(map(self.single.__getitem__, self.split(text)), np.int32)
        first, *rest = text.split(" ")
        return np.fromiter(chain(map(self.single.__getitem__, self.split(first)), map(self.chunks.__getitem__, rest)), np.int32)

    def finish(self, parts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        self.chunks.clear(), self.single.clear()
        lengths, flat = np.array(self.lengths, np.int64), np.array(self.flat, np.int32)
        starts = np.cumsum(lengths) - lengths
        out, sizes = [np.zeros(0, np.int32)], []
        for lo, hi in blocks.slices(np.array([len(p) for p in parts], np.int64), PIECES):
            chunks = np.concatenate(parts[lo:hi])
            size = lengths[chunks]
            ends = np.cumsum(size)
            out.append(flat[np.repeat(starts[chunks] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)])
            bounds = np.r_[0, ends][np.r_[0, np.cumsum([len(p) for p in parts[lo:hi]])]]
            sizes += np.diff(bounds).tolist()
        return np.concatenate(out), sizes

    def words(self) -> list[bytes]:
        return [w.encode() for w in self.index]


class _Chunks(dict):
    """Numbers of chunks, which a blank stands before."""

    def __init__(self, coder: PieceCoder):
        self.coder = coder

    def __missing__(self, chunk: str) -> int:
        # Letters alone, or before one mark, need no pattern. Latin ones are letters in every edition of Unicode.
        if self.coder.plain and (chunk.isascii() or max(chunk) < "\u0250"):
            if chunk.isalpha():
                self[chunk] = got = self.coder.add([" " + chunk])
                return got
            if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
                self[chunk] = got = self.coder.add([" " + chunk[:-1], chunk[-1]])
                return got
        self[chunk] = got = self.coder.add(self.coder.split(" " + chunk))
        return got


class _Single(dict):
    """Numbers of chunks that are one pre-token."""

    def __init__(self, coder: PieceCoder):
        self.coder = coder

    def __missing__(self, piece: str) -> int:
        self[piece] = got = self.coder.add([piece])
        return got


#: Pre-tokens or ids that are worked on at once, whole texts at least.
PIECES = 500_000
_MARKS = tuple(",.;:!?")
#: A blank between white space, or between white space and the end; Python's class holds a few characters more than Unicode's, which only costs speed.
_BETWEEN = re.compile(r"\s (?:\s|\Z)")


def load_vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """A vocabulary by its rank file; the public 50k one where no path is given."""
    import public_tokenizers

    return Vocabulary(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids array<int>): each text's token ids, as the tokenizer library gives them without special tokens.

    Pre-tokens are split with their positions, block by block; each distinct one is shuffled to its bucket and encoded
    once there; its ids are joined back to the blocks that hold it and put at its positions. A null or empty text has
    no ids. Rows are independent: repeated doc_ids or rows give a row each. Other columns don't matter.
    Very long texts and words are encoded whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions_for(docs)
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = blocks.block_input(docs, F.lit(False), F.col("text"))
    key_spark = rows.schema[0].dataType
    key_type = blocks.arrow_type(key_spark)
    schema = blocks.code_rows(key_spark)
    coder = lambda: PieceCoder(shared.value)

    def encode_words(batches):
        known: dict[bytes, list[int]] = {}
        one = shared.value.encode_piece
        for batch in batches:
            out = []
            for number, check, blob, sizes, places in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3, 4, 5)]):
                words = blocks.unpack_words(blob, sizes)
                ids = []
                for word in words:
                    got = known.get(word)
                    if got is None:
                        got = known[word] = one(word)
                    ids.append(got)
                lengths = np.fromiter(map(len, ids), "<u4", len(ids))
                flat = np.fromiter((x for one_ids in ids for x in one_ids), "<i4", int(lengths.sum()))
                out.append((number, check, places, blocks.pack_codes(lengths), blocks.pack_codes(flat)))
            for at in range(0, len(out), 200):
                yield blocks.found_batch(out[at : at + 200], key_type, schema.names)

    def learn(state, places, lengths, flat):
        state.append((np.frombuffer(places, "<u4"), blocks.unpack_codes(lengths), blocks.unpack_codes(flat)))

    def use(state, part):
        if state and not isinstance(state[0], dict):
            places = np.concatenate([s[0] for s in state])
            lengths = np.concatenate([s[1] for s in state]).astype(np.int64)
            flat = np.concatenate([s[2] for s in state]).astype(np.int32)
            begins, size = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            begins[places], size[places] = np.cumsum(lengths) - lengths, lengths
            state[:] = [{"begins": begins, "size": size, "flat": flat}]
        keys, every_code = part.column(7), [blocks.unpack_codes(b) for b in part.column(4).to_pylist()]
        for at, end in blocks.slices(np.array([len(c) for c in every_code]), PIECES):
            codes = every_code[at:end]
            table = state[0] if state else {"begins": np.zeros(0, np.int64), "size": np.zeros(0, np.int64), "flat": np.zeros(0, np.int32)}
            every = np.concatenate(codes)
            size = table["size"][every]
            ends = np.cumsum(size)
            where = np.repeat(table["begins"][every] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            word_ends = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
            offsets = np.concatenate([[0], ends])[word_ends].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table["flat"][where]))
            yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), ids], names=["doc_id", "ids"])

    def reassemble(batches):
        for made in blocks.by_block(batches, list, learn, use):
            yield from made

    words = blocks.scan_words(rows, coder, n, False)
    found = words.repartitionById(n, "bucket").mapInArrow(encode_words, schema)
    out = T.StructType([T.StructField("doc_id", key_spark), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return blocks.meet(found, blocks.scan_codes(rows, coder), n).mapInArrow(reassemble, out)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded (doc_id, ids) with decoded binary added: ids looked up in the token-byte table and joined.

    A null list or an empty one gives empty bytes; an id without a token is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        blocks.give_back()
        table = shared.value.token_bytes()
        length = np.fromiter(map(len, table), np.int64, len(table))
        start, data = np.cumsum(length) - length, np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            numbers = np.asarray(batch.column(1).value_lengths().fill_null(0))
            for at, end in blocks.slices(numbers, PIECES):
                part = batch.slice(at, end - at)
                column = part.column(1)
                ids = column.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(table) or not length[ids].all()):
                    raise ValueError("an id has no token")
                size = length[ids]
                ends = np.cumsum(size)
                where = np.repeat(start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
                tokens = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
                offsets = np.concatenate([[0], ends])[tokens].astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data[where])])
                yield pa.RecordBatch.from_arrays([part.column(0), column, texts], names=["doc_id", "ids", "decoded"])

    schema = T.StructType([*encoded.select("doc_id", "ids").schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of (doc_id, ids, decoded)."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again by the public byte-level ranks."""
    vocabulary = load_vocabulary()
    return digests(decode(encode(documents(spark, sf_dir), vocabulary), vocabulary))
