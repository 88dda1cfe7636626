"""Operator 7: approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise
from .vectors import common_length, is_valid, matrix

#: Vectors a list is meant to hold, copies left out, and lists at most: what every task holds is so many centroids, or twice that.
LIST = 512
MAX_LISTS = 4096
#: Sample vectors a list: centroids, graph and pruning are fitted on LEAF vectors for each list, those with the smallest
#: hashes of their ids; 262,144 at most.
LEAF = 64
#: A vector also goes to lists whose centroid is at most so many times as far as its nearest, up to COPIES in all.
REPLICATE = 1.1
COPIES = 3
#: Share of sample neighbours that the pruning ratio must keep.
RECALL = 0.96
#: Share of the sample that distances are scaled for; vectors longer than these are in a list that every query searches.
USUAL = 0.999
#: Rows of a posting list that one task searches; longer lists are split.
SHARD = 4096
#: Results that a task gathers before it keeps the best of each query.
GATHERED = 1_000_000
#: Queries of which a task holds results before it sends them on.
MERGED = 50_000
K = 20
#: Rows that are held against all centroids, or queries against the whole sample, at once: a block of distances stays within tens of MB.
BLOCK = 512
SEED = 17


class Index:
    """Centroids of balanced clusters, a graph over them, and the pruning ratio. Inner products become distances by
    one more component, which brings all vectors to one norm; a query has 0 there. The few vectors that are longer than
    this norm are in a list of their own, the last one, which every query searches."""

    def __init__(self, centroids: np.ndarray, graph: np.ndarray, norm: float, ratio: float):
        self.centroids, self.graph, self.norm, self.ratio = centroids, graph, norm, ratio
        self.squares = (centroids**2).sum(axis=1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ self.centroids.T + self.squares))

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all copies: each vector's nearest list and near ones across a boundary."""
        found = [self._places(x[lo : lo + BLOCK]) for lo in range(0, max(1, len(x)), BLOCK)]
        return np.concatenate([rows + k * BLOCK for k, (rows, _) in enumerate(found)]), np.concatenate([lists for _, lists in found])

    def _places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.lifted(x))
        c = min(COPIES, d.shape[1])
        near = np.argpartition(d, c - 1, axis=1)[:, :c]
        dist = np.take_along_axis(d, near, axis=1)
        long = (x * x).sum(axis=1) > (self.norm * (1 + 1e-6)) ** 2
        rows, cols = np.nonzero((dist <= REPLICATE * dist.min(axis=1, keepdims=True)) & ~long[:, None])
        return np.r_[rows, np.flatnonzero(long)], np.r_[near[rows, cols], np.full(long.sum(), len(self.centroids))]

    def search(self, q: np.ndarray, ratio: float | None = None) -> list[int]:
        """Lists whose centroid is at most ratio times as far from q as the nearest: best-first over the graph until the
        closest open centroid is beyond that bound."""
        ratio = ratio or self.ratio
        point = np.r_[q / max(1e-300, math.sqrt(q @ q)) * self.norm, 0.0]
        away = lambda rows: np.sqrt(np.maximum(0, point @ point - 2 * self.centroids[rows] @ point + self.squares[rows]))
        seen = np.zeros(len(self.centroids), bool)
        start = np.arange(0, len(seen), max(1, len(seen) // 16))
        seen[start] = True
        heap = [(float(d), int(c)) for c, d in zip(start, away(start))]
        heapq.heapify(heap)
        best, found, slack = heap[0][0], [], 1.05
        while heap:
            d, c = heapq.heappop(heap)
            best = min(best, d)
            if d > best * ratio * slack:
                break
            found.append((d, c))
            new = self.graph[c]
            new = new[~seen[new]]
            seen[new] = True
            for n, x in zip(new.tolist(), away(new).tolist()):
                heapq.heappush(heap, (x, n))
        return [*[c for d, c in found if d <= best * ratio], len(self.centroids)]


def _nearer(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row is at least as near to a as to b."""
    blocks = [part[lo : lo + 16 * BLOCK] for lo in range(0, len(part), 16 * BLOCK)]
    return np.concatenate([((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1) for x in blocks])


def balanced_centroids(x: np.ndarray, leaf: int, rng: np.random.Generator) -> np.ndarray:
    """Means of equal parts: each part is cut at the median along the line between the centres of two clusters."""
    stack, means = [np.arange(len(x))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            means.append(x[rows].mean(axis=0))
            continue
        part = x[rows]
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            near_a = _nearer(part, a, b)
            if near_a.all() or not near_a.any():
                break
            a, b = part[near_a].mean(axis=0), part[~near_a].mean(axis=0)
        order = np.argsort(part @ (a - b), kind="stable")
        stack += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return np.array(means)


def fit(sample: np.ndarray, n: int, k: int = K, recall: float = RECALL, seed: int = SEED) -> Index:
    """Index over the sample's clusters, with the smallest pruning ratio that keeps ``recall`` of the nearest of sample
    queries: as many as stand for k among all n vectors."""
    rng = np.random.default_rng(seed)
    norm = math.sqrt(np.quantile((sample**2).sum(axis=1), USUAL, method="higher"))
    bare = Index(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 0), int), norm, 1.0)
    lifted = bare.lifted(sample)
    centroids = balanced_centroids(lifted, LEAF, rng)
    degree = min(24, len(centroids) - 1)
    square = (centroids**2).sum(axis=1)
    graph = np.zeros((len(centroids), degree), int)
    for lo in range(0, len(centroids), BLOCK):
        d = square[lo : lo + BLOCK, None] - 2 * centroids[lo : lo + BLOCK] @ centroids.T + square
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        graph[lo : lo + BLOCK] = np.argsort(d, axis=1, kind="stable")[:, :degree]
    # Links both ways and to the next centroid keep every centroid reachable.
    both = [set(r.tolist()) for r in graph]
    for i, r in enumerate(graph):
        for j in r.tolist():
            if len(both[j]) < 2 * degree:
                both[j].add(i)
        both[i].add((i + 1) % len(both))
    width = max(map(len, both))
    graph = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(both)])
    index = Index(centroids, graph, norm, 1.0)
    queries = sample[rng.choice(len(sample), min(500, len(sample)), replace=False)]
    rows, place = index.places(sample)
    order = np.argsort(rows, kind="stable")
    place, starts = place[order], np.searchsorted(rows[order], np.arange(len(sample) + 1))
    points = np.c_[queries / np.maximum(1e-300, np.sqrt((queries**2).sum(axis=1, keepdims=True))) * norm, np.zeros(len(queries))]
    far = index.distances(points)
    far = np.c_[far / np.maximum(far.min(axis=1, keepdims=True), 1e-9), np.zeros(len(far))]
    needed = []
    deep = math.ceil(k * len(sample) / max(n, len(sample)))
    for q, s in _scores(queries, sample):
        top = np.argpartition(-s, min(deep, len(s) - 1))[: deep + 1]
        top = top[np.argsort(-s[top], kind="stable")][1:] if len(top) > 1 else top  # the query itself is no neighbour
        needed += [far[q, place[starts[t] : starts[t + 1]]].min() for t in top.tolist()]
    index.ratio = max(1.0, float(np.quantile(needed, recall))) * 1.0001
    return index


def _scores(queries: np.ndarray, sample: np.ndarray):
    """(number, inner products with the sample) of each query, a few at a time."""
    step = max(1, 4 * 1024 * BLOCK // max(1, len(sample)))
    for lo in range(0, len(queries), step):
        yield from enumerate(queries[lo : lo + step] @ sample.T, lo)


def _ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of distinct ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    if len(ids) > 1:
        _, first = np.unique(ids, return_index=True)
        first.sort()
        ids, scores = ids[first], scores[first]
    return ids[:k], scores[:k]


class Best:
    """The best results of a task's queries so far, as arrays; of each query the score that the next ones must reach."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0
        self.queries, self.bounds = np.zeros(0, np.int64), np.zeros(0)

    def bound(self, queries: np.ndarray) -> np.ndarray:
        if not len(self.queries):
            return np.full(len(queries), -np.inf)
        at = np.minimum(np.searchsorted(self.queries, queries), len(self.queries) - 1)
        return np.where(self.queries[at] == queries, self.bounds[at], -np.inf)

    def compare(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Hold queries against rows x. Rough products choose; products that count are taken row by row, so equal vectors
        score equally."""
        rough = queries @ x.T
        rough[query_ids[:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * np.sqrt((queries**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max())
        bound = self.bound(query_ids)
        if len(ids) > self.k + 1 and len(np.unique(ids)) == len(ids):
            bound = np.maximum(bound, np.partition(rough, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        i, j = np.nonzero((rough >= (bound - slack)[:, None]) & (rough > -np.inf))
        self.parts.append((query_ids[i], ids[j], (x[j] * queries[i]).sum(axis=1)))
        self.size += len(i)
        if self.size >= GATHERED + self.k * len(self.queries):
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the k best of each query, ties to the smaller id; of one id the best score."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, i, s = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((-s, i, q))
        q, i, s = q[order], i[order], s[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, i, s = q[new], i[new], s[new]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(q)])
        keep = np.arange(len(q)) - np.repeat(starts, counts) < self.k
        full = counts >= self.k
        self.queries, self.bounds = q[starts], np.where(full, s[np.minimum(starts + self.k - 1, max(0, len(q) - 1))], -np.inf)
        q, i, s = q[keep], i[keep], s[keep]
        self.parts, self.size = [(q, i, s)], len(q)
        return q, i, s


_PARTIAL = "query_id long, ids array<long>, scores array<double>"


def _partials(q: np.ndarray, i: np.ndarray, s: np.ndarray):
    """One row a query, in batches."""
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(q)]
    for at in range(0, len(starts), 5_000):
        a, b = starts[at : at + 5_000], ends[at : at + 5_000]
        offsets = pa.array(np.r_[a, b[-1]] - a[0], pa.int32())
        some = slice(int(a[0]), int(b[-1]))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[some])) for c in (i, s)]
        yield pa.RecordBatch.from_arrays([pa.array(q[a]), *lists], names=["query_id", "ids", "scores"])


class Searcher:
    """An index in the cluster: its fitted part, and the posting lists as a written table."""

    def __init__(self, vectors: DataFrame, k: int = K, recall: float = RECALL, seed: int = SEED, length: int | None = None):
        """vectors(vec_id, embedding); invalid ones take no part, nor do those of another length than ``length``, which is
        the commonest if not given."""
        self.spark, self.k = vectors.sparkSession, k
        rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(is_valid(F.col("embedding")))
        self.length = length or common_length(rows, "embedding")
        if self.length is None:
            return
        self.rows = rows.where(F.size("embedding") == self.length)
        n = self.rows.count()
        lists = min(MAX_LISTS, math.ceil(n / LIST))
        some = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(LEAF * lists).select("embedding").toArrow()
        self.index = fit(matrix(some.column("embedding").combine_chunks()), n, k, recall, seed)
        shared = self.shared = self.spark.sparkContext.broadcast(self.index)
        kind = pa.float32() if dict(rows.dtypes)["embedding"] == "array<float>" else pa.float64()
        self.kind = kind

        def place(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    at, where = shared.value.places(matrix(part.column(1)))
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), part.column(0).take(take), part.column(1).take(take)], names=["list", "vec_id", "embedding"])

        element = "float" if kind == pa.float32() else "double"
        self.lists = materialise(self.rows.mapInArrow(place, f"list int, vec_id long, embedding array<{element}>"))
        counted = self.lists.groupBy("list").count().collect()  # a row a list: twice MAX_LISTS at most
        self.shards = {r["list"]: math.ceil(r["count"] / SHARD) for r in counted}

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best of each valid query(vec_id, embedding), other rows than its own."""
        out = "query_id long, rank int, vec_id long, score double"
        if self.length is None:
            return self.spark.createDataFrame([], out)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shared, shards, k, kind = self.shared, self.spark.sparkContext.broadcast(self.shards), self.k, self.kind
        valid = queries.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(is_valid(F.col("embedding")))
        valid = valid.where(F.size("embedding") == self.length)
        element = "float" if kind == pa.float32() else "double"
        dealt = f"list int, shard int, side int, vec_id long, embedding array<{element}>"

        def ask(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    part = batch.slice(lo, 200)
                    at, where, shard = [], [], []
                    for i, q in enumerate(matrix(part.column(1))):
                        for c in shared.value.search(q):
                            for s in range(shards.value.get(c, 0)):
                                at.append(i), where.append(c), shard.append(s)
                    take = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(shard, pa.int32()), pa.array([1] * len(at), pa.int32()), part.column(0).take(take), part.column(1).take(take)], names=["list", "shard", "side", "vec_id", "embedding"])

        def deal(batches):
            for batch in batches:
                n = np.array([shards.value[c] for c in batch.column(0).to_pylist()], np.int64)
                shard = (batch.column(1).to_numpy() * 2654435761 % 2**31) % np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard.astype(np.int32)), pa.array(np.zeros(len(n), np.int32)), batch.column(1), batch.column(2)], names=["list", "shard", "side", "vec_id", "embedding"])

        def compare(batches):
            best = Best(k)
            now, held, ids, x = None, [], None, None
            for batch in batches:
                key = batch.column(0).to_numpy().astype(np.int64) << 33 | batch.column(1).to_numpy().astype(np.int64) << 1 | batch.column(2).to_numpy()
                cuts = np.flatnonzero(np.diff(key)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                    if lo == hi:
                        continue
                    part = batch.slice(lo, hi - lo)
                    if key[lo] >> 1 != now:
                        now, held, x = key[lo] >> 1, [], None
                    if not key[lo] & 1:
                        held.append(part)
                        continue
                    if not held:
                        continue
                    if x is None:
                        ids = np.concatenate([p.column(3).to_numpy() for p in held])
                        x = np.concatenate([matrix(p.column(4)) for p in held])
                    for at in range(0, part.num_rows, 256):
                        some = part.slice(at, 256)
                        best.compare(some.column(3).to_numpy(), matrix(some.column(4)), ids, x)
                    if len(best.queries) >= MERGED:
                        yield from _partials(*best.reduce())
                        best = Best(k)
            yield from _partials(*best.reduce())

        def merge(batches):
            rows, now, near, scores = [], None, None, None

            def done():
                return [(now, r + 1, int(i), float(s)) for r, (i, s) in enumerate(zip(near, scores))] if now is not None else []

            for batch in batches:
                for q, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if q != now:
                        rows += done()
                        now, near, scores = q, np.array(i, np.int64), np.array(s)
                    else:
                        near, scores = _ranked(np.r_[near, i].astype(np.int64), np.r_[scores, s], k)
                if len(rows) > 20_000:
                    yield _results(rows)
                    rows = []
            rows += done()
            if rows:
                yield _results(rows)

        asked = valid.mapInArrow(ask, dealt)
        stored = self.lists.mapInArrow(deal, dealt)
        met = stored.unionByName(asked).repartition(parts, "list", "shard").sortWithinPartitions("list", "shard", "side")
        partial = met.mapInArrow(compare, _PARTIAL)
        return partial.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, out)


def _results(rows: list[tuple]) -> pa.RecordBatch:
    q, r, i, s = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, **parameters) -> DataFrame:
    """The k vectors of largest inner product for each query, by balanced posting lists.

    A sample, which grows with the table up to a bound, is cut into balanced clusters, one for LIST vectors; every vector
    goes to its nearest list and to those nearly as near; lists longer than SHARD are split. Few very long vectors, which
    would blur all distances, have a list that every query searches. A query finds centroids by a best-first search of an in-memory graph and
    takes the lists within a ratio of the nearest distance, which is calibrated on the sample. Each list is
    searched exactly; results of a query are merged, ties to the smaller vec_id.

    Vectors of each length have an index of their own, fitted one after another, and meet queries of that length only.
    Null, zero or non-finite vectors, null components and null ids take no part. A query is not its own candidate;
    other rows with the same vector are. Rows with one vec_id count as one vector: the better score stays. With fewer
    than k candidates all that are found come back. An empty table gives an empty result.
    """
    valid = vectors.where(F.col("vec_id").isNotNull() & is_valid(F.col("embedding")))
    lengths = sorted(r["d"] for r in valid.select(F.size("embedding").alias("d")).distinct().collect())
    found = [Searcher(vectors, k, length=d, **parameters).search(queries) for d in lengths or [None]]
    return reduce(DataFrame.unionAll, found)


def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
