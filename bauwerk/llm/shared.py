"""Session helpers: the shared folder, materialised tables and connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as the contracts define them: runs of anything but space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"

_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset, a folder of its own on a local master; on a
    cluster an error, as executors would write tables to disks of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="bauwerk-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of input files for each partition of a shuffle that holds its share of the input in a task's memory.
PART_BYTES = 32 << 20


def partitions_for(docs: DataFrame) -> int:
    """Partitions for such a shuffle: as many as the session sets, and more where the input's files ask for it."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # rows that are no table count as 2^63 - 1
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES))


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in a table that outlives executors.

    The table is removed by release(), or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(release)
    _tables.append((spark, path))
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df itself where it only picks from files, which every scan gives in one order; a written copy otherwise."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return df if node.getClass().getSimpleName() == "LogicalRelation" else materialise(df)


def tidy(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def written() -> int:
    """How many tables there are; release(since=written()) later removes those that came after."""
    return len(_tables)


def release(since: int = 0, keep: int = 0) -> None:
    """Remove written tables, but for the first ``since`` and the last ``keep`` ones. Call it once the results that are made from them
    are written: a result that isn't can't be read any more."""
    gone = _tables[since : len(_tables) - keep]
    del _tables[since : len(_tables) - keep]
    for spark, path in gone:
        if spark.sparkContext._jsc is not None:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        elif os.path.isdir(plain := path.removeprefix("file:")):
            shutil.rmtree(plain, ignore_errors=True)
        else:
            print(f"left behind, as its session is closed: {path}", file=sys.stderr)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that together name a row's values; nulls hash too."""
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(7), *columns).alias("_k2")]


#: Edges that a single task may hold, some hundred bytes each.
ONE_TASK = 1_000_000


def _join_all(batches):
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (node, component), component being the smallest node.

    Up to ONE_TASK edges, one task joins them in memory. More alternate large-star and small-star steps until the edge
    set is stable. Each step takes the minimum of a node's neighbours by a partially aggregated groupBy and
    joins it back, so a hub with very many neighbours is a skewed join key, which AQE splits, and never one group in
    one task. Both ways give the same rows.
    Edges that join a node to itself or hold nulls are ignored; no edges give no rows.
    """

    def star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return e.join(least, "u")

    e = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    if e.count() <= ONE_TASK:
        return e.repartition(1).mapInArrow(_join_all, "node long, component long")
    seen = None
    while True:
        both = e.selectExpr("a AS u", "b AS v").unionByName(e.selectExpr("b AS u", "a AS v"))
        large = star(both).where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        small = star(large)
        e = materialise(
            small.selectExpr("u AS a", "m AS b")
            .unionByName(small.selectExpr("v AS a", "m AS b"))
            .where("a <> b")
            .distinct()
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
