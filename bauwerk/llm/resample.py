"""Operator 12: resampling by importance towards a target's distribution of hashed n-grams.

Each partition's words become ids; a suffix array over them brings equal n-grams together, runs of common prefixes tell where each
n-gram's occurrences are, and each is hashed once. Buckets go back to the occurrences, so a document's weight is a sum over its stretch of
the text. Two scans: one counts buckets, the other scores.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, WordCoder, arrow_type, block_input, read_blocks
from .ranks import ranked
from .shared import documents, materialise

#: Letters a-z, digits and whatever isn't ASCII make words; A-Z count as small letters.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: The query's parameters.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): where suffixes begin, sorted by their first ``depth`` ids at least, and how many ids, up to depth, each
    shares with the one before. Prefix doubling."""
    rank, known = ids.astype(np.int64), 1
    while known < depth:
        after = np.zeros(len(ids), np.int64)
        after[:-known] = rank[known:] + 1
        order = np.lexsort((after, rank))
        new = np.ones(len(ids), bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank[order] = np.cumsum(new) - 1
        known *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(len(ids), np.int32)
    same = np.ones(max(len(ids) - 1, 0), bool)
    padded = np.concatenate([ids, np.full(depth, -1, ids.dtype)])
    for k in range(depth):
        same &= (padded[order[1:] + k] == padded[order[:-1] + k]) & (padded[order[1:] + k] >= 0)
        shared[1:] += same
    return order, shared


class Grams:
    """All n-grams of a block, 1 to ``longest`` words, with their buckets."""

    def __init__(self, block: Block, longest: int, buckets: int):
        sizes = np.array(block.sizes, np.int64)
        # Documents in a row, each followed by a stop (0): an n-gram that reaches one is none.
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.sizes, self.longest, self.buckets = sizes, longest, buckets
        ids = np.zeros(int((sizes + 1).sum()), np.int32)
        number = np.arange(len(block.codes)) + np.repeat(np.arange(len(sizes)), sizes)
        ids[number] = block.codes.astype(np.int32) + 1
        self.left = np.zeros(len(ids), np.int64)  # words from here to the document's end
        self.left[number] = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(block.codes))
        self.ids, self.words = ids, block.words
        self.order, self.shared = suffix_array(ids, longest)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrences in order of n-grams, first index of each n-gram's run among these, its bucket)."""
        whole = self.left[self.order] >= n
        new = self.shared < n
        run = np.cumsum(new)[whole]  # an n-gram that reaches a stop shares no run with one that doesn't
        at = self.order[whole]
        first = np.flatnonzero(np.diff(run, prepend=-1))
        grams = self.ids[at[first][:, None] + np.arange(n)] - 1 if len(first) else np.zeros((0, n), np.int64)
        words = self.words
        hashed = (zlib.crc32(words[g[0]] if n == 1 else b" ".join([words[i] for i in g])) for g in grams.tolist())
        return at, first, np.fromiter(hashed, np.int64, len(first)) % self.buckets

    def counts(self) -> np.ndarray:
        """Occurrences by bucket."""
        total = np.zeros(self.buckets, np.int64)
        for n in range(1, self.longest + 1):
            at, first, bucket = self.runs(n)
            np.add.at(total, bucket, np.diff(first, append=len(at)))
        return total

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The sum of gains over each document's n-grams."""
        gain = np.zeros(len(self.ids), np.int64)
        for n in range(1, self.longest + 1):
            at, first, bucket = self.runs(n)
            gain[at] += np.repeat(gains[bucket], np.diff(first, append=len(at)))
        sums = np.concatenate([[0], np.cumsum(gain)])
        return sums[self.starts + self.sizes] - sums[self.starts]

    def numbers(self) -> np.ndarray:
        """How many n-grams each document has."""
        return sum(np.maximum(self.sizes - n + 1, 0) for n in range(1, self.longest + 1))


def _coder() -> WordCoder:
    return WordCoder(words_of)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of block_input()."""

    def run(batches):
        for block in read_blocks(batches, _coder):
            counts = Grams(block, longest, buckets).counts()
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _whole(counts: DataFrame, buckets: int) -> np.ndarray:
    """At the driver: as many numbers as there are buckets."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the target's smoothed share over the corpus's, by bucket, rounded down."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + n) / ((int(s) + 1) * (t_all + n)))) for s, t in zip(corpus, target)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Thousandths of a draw from the Gumbel distribution that the id and the seed fix; a null id counts as an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(texts: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of block_input()."""
    key = texts.schema["key"].dataType
    key_arrow = arrow_type(key)
    shared = texts.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for block in read_blocks(batches, _coder):
            grams = Grams(block, longest, len(shared.value))
            weight = grams.weights(shared.value)
            drawn = np.fromiter((noise(k, seed) for k in block.ids), np.int64, len(block.ids))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, key_arrow), pa.array(grams.sizes), pa.array(grams.numbers()), pa.array(weight), pa.array(weight + drawn)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return texts.mapInArrow(run, f"doc_id {key.simpleString()}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text): a draw without repeats of ``percent``
    of the documents with least_words words and more, likelier the more a document's n-grams look like target's (text).

    An n-gram's bucket is its bytes' crc32, words joined by blanks, modulo buckets. A bucket's gain compares smoothed shares in target and docs;
    weight is the sum over the document's n-grams of 1 to ``longest`` words, repeats counted; score adds Gumbel noise
    that seed and doc_id fix, so the highest scores are a draw by exp(weight / 1000). rank is from 1, by score and then the smaller doc_id (then the fewer
    n-grams); null for what isn't drawn.

    Null and empty texts have no words: weight 0, never drawn if least_words is above 0. Texts of any length are taken whole.
    Repeated rows count and stand for themselves each. An empty docs gives an empty result, an empty target a uniform one. Other columns don't matter.
    The two scans hold a block of documents each; bucket counts meet in as many rows as there are buckets, and ranks come from
    ranges of scores.
    """
    text = lambda df, key: block_input(df.select(key.alias("doc_id"), "text"), F.lit(False), F.col("text").cast("binary"))
    texts = text(docs, F.col("doc_id"))
    gain = gains(_whole(bucket_counts(texts, longest, buckets), buckets), _whole(bucket_counts(text(target, F.lit(0)), longest, buckets), buckets))
    found = materialise(scored(texts, gain, longest, seed))
    able = found.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    placed = ranked(able, [], order).select(*found.columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return placed.unionByName(found.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and its rank in the draw."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), target, LONGEST).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH word AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w, true AS ours FROM documents
  UNION ALL
  SELECT NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')), false FROM benchmark
), bytes AS (
  SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM word)
), hashed AS (
  SELECT w, xor(list_reduce(b, lambda c, x: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, x)), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM bytes
), per AS (
  SELECT bucket, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t FROM word JOIN hashed USING (w) GROUP BY bucket
), total AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM per
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS g FROM per, total
), sums AS (
  SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM word JOIN hashed USING (w) JOIN gain USING (bucket) WHERE ours GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(g, 0) AS weight,
    coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN sums USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, {PERCENT} * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
