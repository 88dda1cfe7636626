"""Operator 9: near-duplicate vectors by counting window collisions on one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, materialise
from .vectors import is_valid, matrix

COSINE = 0.93
#: Recall at the threshold itself that tables and count are calibrated to; above it recall is higher.
RECALL = 0.9995
#: Width of the cells that projections are cut into, in units of the projections' spread for random unit vectors.
WIDTH = 1.5
#: Vectors that a cell is meant to hold, and at most so many that one task compares with as many.
CELL = 512
CHUNK = 2048
#: Projections whose window collisions are counted, and half the width of the query-centred window.
COUNTED = 48
WINDOW = 0.45
SEED = 29


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def cell_probability(delta: float, width: float = WIDTH) -> float:
    """That two unit vectors at distance delta share a cell of one projection with a random offset."""
    r = width / delta
    return 2 * _normal(r) - 1 - 2 / (r * math.sqrt(2 * math.pi)) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(projections a table sorts by, tables) for n vectors: cells of about CELL vectors, and as many tables as
    the recall takes. Both grow with log n, so work grows with a power of n well below two."""
    delta = math.sqrt(2 - 2 * cosine)
    apart = cell_probability(math.sqrt(2))
    k = max(0, math.ceil(math.log(max(1, n) / CELL) / -math.log(apart)))
    if k == 0:
        return 0, 1
    return k, math.ceil(math.log(1 - recall) / math.log(1 - cell_probability(delta) ** k))


def least_count(cosine: float, recall: float) -> int:
    """Collisions, of COUNTED, that a pair at the threshold reaches with the recall wanted."""
    p = 2 * _normal(WINDOW / math.sqrt(2 - 2 * cosine)) - 1
    below, count = 0.0, 0
    while True:
        below += math.comb(COUNTED, count) * p**count * (1 - p) ** (COUNTED - count)
        if below > 1 - recall:
            return count
        count += 1


def _projections(d: int, columns: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((columns, d)).T


def _cells(unit: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """A cell number for each vector and table."""
    if k == 0:
        return np.zeros((len(unit), 1), np.uint64)
    rng = np.random.default_rng(seed + 1)
    mixers = rng.integers(1, 2**63, (tables, k), np.int64).astype(np.uint64) | np.uint64(1)
    offsets = rng.random((tables, k))
    steps = np.floor((unit @ _projections(unit.shape[1], tables * k, seed)).reshape(-1, tables, k) / WIDTH + offsets).astype(np.int64).astype(np.uint64)
    h = (steps * mixers).sum(axis=2, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows, in how many columns b lies in the window around a."""
    count = np.zeros((len(a), len(b)), np.uint8)
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        ranked = b[order, j]
        lo, hi = np.searchsorted(ranked, a[:, j] - WINDOW), np.searchsorted(ranked, a[:, j] + WINDOW, "right")
        if (hi - lo).sum() * 8 < count.size:
            for i in np.flatnonzero(hi > lo):
                count[i, order[lo[i] : hi[i]]] += 1
        else:
            count += np.abs(a[:, j, None] - b[None, :, j]) <= WINDOW
    return count


class Forest:
    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True


def _compare(ids, mult, unit, k, tables, table, cosine, least, split, seed):
    """Links found in a cell, between rows before split and rows from it on, or among all where split is None.

    Yields (id, linked vectors) and the pairs of a spanning forest. A pair counts in the first table only in which it shares a cell.
    """
    rng = _projections(unit.shape[1], COUNTED, seed + 2)
    seen = unit @ rng
    linked, edges, forest = np.zeros(len(ids), np.int64), [], Forest()
    left = np.arange(len(ids) if split is None else split)
    right = np.arange(len(ids)) if split is None else np.arange(split, len(ids))
    cells = _cells(unit, k, tables, seed)[:, :table] if table else None
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(_collisions(seen[rows], seen[right]) >= least)
        i, j = rows[i], right[j]
        if split is None:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), 200_000):
            a, b = i[lo : lo + 200_000], j[lo : lo + 200_000]
            good = (unit[a] * unit[b]).sum(axis=1) >= cosine
            a, b = a[good], b[good]
            if cells is not None and len(a):
                new = ~(cells[a] == cells[b]).any(axis=1)
                a, b = a[new], b[new]
            np.add.at(linked, a, mult[b])
            np.add.at(linked, b, mult[a])
            for x, y in zip(ids[a].tolist(), ids[b].tolist()):
                if forest.join(x, y):
                    edges.append((x, y))
    return linked, edges


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): n_links, component_id, kept.

    Rows link when their labels are equal and not null, their vectors are of one length, and the cosine of these, in double
    precision, is at least ``cosine``.
    Equal vectors of a label are one class, with a number of rows; classes are compared, so copies never make pairs. A class is known by
    128 bits of hashes, and 64 more stop the job if different vectors ever have these in common.
    Per label and length, tables of k projections each cut the vectors into cells (k and the number of tables follow its
    size and the recall wanted); in a cell, collisions of query-centred windows over COUNTED sorted projections are
    counted for each pair, and pairs that reach the calibrated count are verified exactly. Cells of more than CHUNK
    classes are split, and each two parts compared in a task of their own; what leaves a task is a number of links
    for each class and a spanning forest, never all pairs.

    Null, empty, zero or non-finite vectors and those with null components link with nothing, as do rows with null
    labels: n_links 0, component_id their own vec_id, kept true. Rows with one vec_id are vectors of their own. An empty table gives an empty result; other columns don't matter.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    able = is_valid(F.col("embedding")) & F.col("label").isNotNull()
    keys = [F.when(able, F.xxhash64(F.lit(k), "label", "embedding")).alias(f"_h{k}") for k in range(3)]
    rows = vectors.select("vec_id", "embedding", "label", *keys)
    slim = rows.select("vec_id", "_h0", "_h1")
    valid = rows.where("_h0 IS NOT NULL")
    if valid.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Two hashes name a class, a third one tells if two vectors have both in common.
    mult = F.when(F.min("_h2") == F.max("_h2"), F.count("*")).otherwise(F.raise_error(F.lit("different vectors with equal hashes")).cast("long"))
    classes = valid.groupBy("_h0", "_h1").agg(F.first("label").alias("label"), F.first("embedding").alias("v"), mult.alias("mult"), F.min("vec_id").alias("least"))
    classes = materialise(classes.withColumn("_c", F.monotonically_increasing_id()))
    sizes = classes.groupBy(F.col("label").alias("l"), F.size("v").alias("d")).agg(F.count("*").alias("n"))
    placed = classes.join(sizes, F.expr("label = l AND size(v) = d")).select(F.xxhash64("l", "d").alias("l"), "n", "_c", "mult", "v")
    fields = "cell long, l long, n long, d int, tab int, c long, mult long, v binary"

    def to_cells(batches):
        for batch in batches:
            kinds = np.c_[batch.column(1).to_numpy(), pc.list_value_length(batch.column(4)).to_numpy()]
            for n, d in np.unique(kinds, axis=0).tolist():
                at = np.flatnonzero((kinds == (n, d)).all(axis=1))
                k, tables = plan(n, cosine, recall)
                for lo in range(0, len(at), 1000):
                    some = at[lo : lo + 1000]
                    take = pa.array(some)
                    v = matrix(batch.column(4).take(take))
                    cells = _cells(_unit(v), k, tables, seed)
                    blobs = pa.array([r.tobytes() for r in v.astype("<f4" if (v.astype("<f4") == v).all() else "<f8")], pa.binary())
                    label, size, c, mult = (batch.column(x).take(take) for x in (0, 1, 2, 3))
                    mark = label.to_numpy().astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                    for t in range(tables):
                        cell = (cells[:, t] ^ (mark + np.uint64(t))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(cell), label, size, pa.array([d] * len(some), pa.int32()), pa.array([t] * len(some), pa.int32()), c, mult, blobs], names=["cell", "l", "n", "d", "tab", "c", "mult", "v"])

    celled = placed.repartition(parts, "_c").mapInArrow(to_cells, fields)
    celled = materialise(celled)
    key = ["cell", "l", "tab"]
    counts = celled.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").withColumn("shards", F.ceil(F.col("m") / CHUNK).cast("int"))
    shard = F.pmod(F.xxhash64("c"), "shards").cast("int")
    dealt = celled.join(counts, key).withColumn("shard", shard)
    others = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda x: F.struct(F.least(x, "shard").alias("i"), F.greatest(x, "shard").alias("j")))
    dealt = dealt.withColumn("ij", F.explode(others)).select(*key, "ij.i", "ij.j", (F.col("shard") != F.col("ij.i")).cast("int").alias("side"), "n", "d", "c", "mult", "v")
    group = [*key, "i", "j"]
    dealt = dealt.repartition(parts, *group).sortWithinPartitions(*group, "side", "c")
    least = least_count(cosine, recall)

    def compare(batches):
        def one(held):
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            blobs = table.column("v").to_pylist()
            d = table.column("d")[0].as_py()
            v = np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * d else "<f8").astype(np.float64) for b in blobs])
            side = table.column("side").to_numpy()
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            n, t = table.column("n")[0].as_py(), table.column("tab")[0].as_py()
            k, tables = plan(n, cosine, recall)
            ids = table.column("c").to_numpy()
            linked, edges = _compare(ids, table.column("mult").to_numpy(), _unit(v), k, tables, t, cosine, least, None if i == j else int((side == 0).sum()), seed)
            some = np.flatnonzero(linked)
            a = [*ids[some].tolist(), *[e[0] for e in edges]]
            b = [*[None] * len(some), *[e[1] for e in edges]]
            m = [*linked[some].tolist(), *[0] * len(edges)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int64())], names=["a", "b", "m"])

        held, now = [], None
        for batch in batches:
            keys = list(zip(*[batch.column(x).to_pylist() for x in range(5)]))
            start = 0
            for x in range(len(keys) + 1):
                if x == len(keys) or keys[x] != now:
                    if x > start:
                        held.append(batch.slice(start, x - start))
                    start = x
                    if x < len(keys):
                        yield from one(held)
                        held, now = [], keys[x]
        yield from one(held)

    found = materialise(dealt.mapInArrow(compare, "a long, b long, m long"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("m").alias("others"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("_c", "_h0", "_h1", "mult", "least").join(links, F.expr("_c = a"), "left").join(labels, F.expr("_c = node"), "left")
    named = materialise(named.select("_h0", "_h1", "least", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "_c").alias("comp")))
    leads = named.groupBy("comp").agg(F.min("least").alias("lead"))
    known = named.join(leads, "comp").select(F.col("_h0").alias("_k0"), F.col("_h1").alias("_k1"), "n_links", "lead")
    out = slim.join(known, F.expr("_h0 = _k0 AND _h1 = _k1"), "left")
    component = F.coalesce(F.col("lead"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and its component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id), counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.vec_id LEFT JOIN counted c ON e.vec_id = c.a
"""
