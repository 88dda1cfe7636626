"""Blocks: documents as codes into a dictionary of the block's distinct words.

A scan cuts each partition into blocks of whole documents. Each distinct word of a block leaves it once, so the
global shuffle by word carries a word at most once a block, however often it occurs: a frequent word is no hot
key. What is found out about a word goes back to the blocks, where the documents' codes say at which positions it
stands. Words and codes come from two scans of the same table; a check value tells if these didn't see the same
rows in the same order, which a table in files always does, also when tasks are run again; anything else is written to files first.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settled

#: A block is closed once its texts have this many characters: what a task holds in memory.
BLOCK_CHARS = 16_000_000
#: Rows of documents' codes in one outgoing batch.
OUT_ROWS = 2_000

_squeeze = zstandard.ZstdCompressor(level=1)
_unsqueeze = zstandard.ZstdDecompressor()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


_stages: set[int] = set()


def give_back() -> None:
    """Return what earlier stages have freed in this worker to the system, once a stage: workers live on, and what they keep counts beside
    what this stage needs. Within a stage it is kept, as the next block needs it again."""
    task = TaskContext.get()
    if task is None or task.stageId() in _stages:
        return
    _stages.add(task.stageId())
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pack_codes(codes: np.ndarray) -> bytes:
    """uint32 codes, byte plane by byte plane, compressed; the upper planes are mostly zero."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return _squeeze.compress(planes.tobytes())


def unpack_codes(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_unsqueeze.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return b"".join(words), np.fromiter(map(len, words), "<u4", len(words)).tobytes()


def unpack_words(blob: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


def word_buckets(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % np.uint32(n)


class Block:
    """Documents of one block: ids, marks and codes, and the words in order of their codes."""

    def __init__(self, number: int, words: list[bytes], codes: np.ndarray, sizes: list[int], ids: list, marks: list):
        counts = np.bincount(codes, minlength=len(words))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        self.number, self.ids, self.marks, self.sizes = number, ids, marks, sizes
        self.words = [words[i] for i in order]
        self.codes = place[codes] if len(codes) else codes.astype(np.uint32)
        self.check = xxhash.xxh3_64_intdigest(b"\0".join(self.words)) >> 1

    def documents(self) -> Iterator[tuple[object, object, np.ndarray]]:
        at = 0
        for key, mark, n in zip(self.ids, self.marks, self.sizes):
            yield key, mark, self.codes[at : at + n]
            at += n


class Index(dict):
    """Numbers for keys, in order of appearance."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class WordCoder:
    """Codes of the words that ``split`` finds."""

    def __init__(self, split: Callable[[bytes], list[bytes]]):
        self.split, self.index = split, Index()

    def codes(self, text: bytes) -> np.ndarray:
        words = self.split(text)
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))

    def finish(self, parts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """What codes() gave for the texts of a block, in a row, and how many codes each text has."""
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), [len(p) for p in parts]

    def words(self) -> list[bytes]:
        return list(self.index)


def read_blocks(batches: Iterator[pa.RecordBatch], coder: Callable[[], object]) -> Iterator[Block]:
    """Blocks of the partition. Batches have columns key, mark, text, part; each block has a coder of its own, which
    gives a text's codes, and in the end all codes and its words. A null text has no words. A block is named by the scan's partition,
    which part tells: under a union, a task's own number is another."""
    give_back()
    base, made = 0, 0
    own = coder()
    none = np.zeros(0, np.int32)
    parts, ids, marks, chars = [], [], [], 0

    def close() -> Block:
        codes, sizes = own.finish(parts)
        parts.clear()
        return Block(base + made, own.words(), codes, sizes, ids, marks)

    for batch in batches:
        keys, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if batch.num_rows:
            base = batch.column(3)[0].as_py() << 24
        for key, mark, text in zip(keys, flags, batch.column(2)):
            text = text.as_py()
            parts.append(own.codes(text) if text else none)
            ids.append(key)
            marks.append(mark)
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield close()
                made += 1
                own, parts, ids, marks, chars = coder(), [], [], [], 0
    if ids:
        yield close()


def block_input(docs: DataFrame, mark: Column, text: Column) -> DataFrame:
    """What both scans read: files, where docs are written first unless they are only picked from files."""
    return settled(docs.select(F.col("doc_id").alias("key"), mark.alias("mark"), text.alias("text"))).select("*", F.spark_partition_id().alias("part"))


WORD_ROWS = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("check", T.LongType())]
    + [T.StructField(x, T.BinaryType()) for x in ("words", "sizes", "places", "counts")]
)
CODE_FIELDS = [
    T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("check", T.LongType()),
    T.StructField("mark", T.BooleanType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType()),
]


def code_rows(key_type: T.DataType) -> T.StructType:
    """Rows of kind 0 tell about words of a block (places in a, what was found in b and c); of kind 1 hold a document's codes in a."""
    return T.StructType([*CODE_FIELDS, T.StructField("key", key_type)])


def scan_words(docs: DataFrame, coder, buckets: int, counted: bool) -> DataFrame:
    """Each block's distinct words by bucket. docs: key, mark, text. counts: occurrences in documents whose mark is false."""

    def run(batches):
        for block in read_blocks(batches, coder):
            bucket = word_buckets(block.words, buckets)
            if counted:
                seen = np.repeat(~np.array(block.marks, bool), block.sizes)
                counts = np.bincount(block.codes[seen], minlength=len(block.words)).astype("<u4")
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = []
            for part in np.split(order, edges) if len(order) else []:
                blob, sizes = pack_words([block.words[i] for i in part])
                rows.append((int(bucket[part[0]]), block.number, block.check, blob, sizes, part.astype("<u4").tobytes(), counts[part].tobytes() if counted else b""))
            for at in range(0, len(rows), OUT_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(col), t) for col, t in zip(zip(*rows[at : at + OUT_ROWS]), WORD_ARROW)], names=WORD_ROWS.names
                )

    return docs.mapInArrow(run, WORD_ROWS)


WORD_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def scan_codes(docs: DataFrame, coder) -> DataFrame:
    """Each document's codes into the words of its block."""
    schema = code_rows(docs.schema[0].dataType)

    def run(batches):
        key_type = None
        for block in read_blocks(_noting(batches, kept := []), coder):
            key_type = key_type or kept[0]
            rows = []
            for key, mark, codes in block.documents():
                rows.append((mark, pack_codes(codes), key))
                if len(rows) == OUT_ROWS:
                    yield _code_batch(block, rows, key_type, schema)
                    rows = []
            if rows:
                yield _code_batch(block, rows, key_type, schema)

    return docs.mapInArrow(run, schema)


def _noting(batches, kept: list):
    for batch in batches:
        if not kept:
            kept.append(batch.schema.field(0).type)
        yield batch


def _code_batch(block: Block, rows: list, key_type: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    n = len(rows)
    marks, codes, keys = zip(*rows)
    arrays = [pa.array([block.number] * n, pa.int64()), pa.array([1] * n, pa.int32()), pa.array([block.check] * n, pa.int64()), pa.array(marks, pa.bool_()), pa.array(codes, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(keys, key_type)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def found_batch(rows: list[tuple], key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """Rows (block, check, places, b, c) as kind 0."""
    n = len(rows)
    block, check, a, b, c = zip(*rows)
    arrays = [pa.array(block, pa.int64()), pa.array([0] * n, pa.int32()), pa.array(check, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary()), pa.nulls(n, key_type)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def meet(found: DataFrame, codes: DataFrame, partitions: int) -> DataFrame:
    """What was found about words, then the documents' codes, block by block."""
    return found.unionByName(codes).repartition(partitions, "block").sortWithinPartitions("block", "kind")


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes sum up to at most ``most``; a larger row stands alone."""
    ends = np.cumsum(sizes, dtype=np.int64)
    lo, before = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo, before = hi, int(ends[hi - 1])


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def by_block(batches: Iterator[pa.RecordBatch], start: Callable[[], object], learn: Callable, use: Callable):
    """Drive a task of meet(): state = start() for each block, learn(state, a, b, c) for rows of kind 0,
    use(state, batch slice) for the documents. Yields what use returns."""
    give_back()
    block, state, check = None, None, None
    for batch in batches:
        numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
            if lo == hi:
                continue
            if numbers[lo] != block:
                block, state, check = numbers[lo], start(), None
            part = batch.slice(lo, hi - lo)
            checks = set(part.column(2).to_pylist()) | ({check} if check is not None else set())
            if len(checks) > 1:
                raise RuntimeError("two scans of the input saw different rows; write it to files first")
            check = checks.pop()
            if kinds[lo] == 0:
                for a, b, c in zip(*[part.column(k).to_pylist() for k in (4, 5, 6)]):
                    learn(state, a, b, c)
            else:
                yield use(state, part)
