"""Places of rows in an order, and running sums along it, without a task that holds a group or the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: What monotonically_increasing_id() leaves for the row within a partition.
_ROW_BITS = 33


def ranked(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """rows with place (from 0) among the rows of their group, in the order given, and size, the group's number of rows.

    Rows are dealt out by ranges of group and order, sorted and written with a running number; from each range only its first
    number and its number of rows go on, one row a range and group, and their sums give the places. So a group may hold any
    share of the rows. Nulls are a group like others; rows that tie get places in any order, so give an order that tells apart
    what differs. No groups: the whole table is one. An empty table gives an empty one. Columns named place, size or
    beginning with _at or _g are replaced.
    """
    by = [*[F.col(g).asc_nulls_first() for g in groups], *order]
    put = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    put = put.withColumn("_at_range", F.shiftright("_at", _ROW_BITS))
    names = [f"_g{i}" for i in range(len(groups))]
    runs = put.groupBy("_at_range", *groups).agg(F.min("_at").alias("_at_first"), F.count("*").alias("_at_rows"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_at_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_at_range").alias("_g_range"), *[F.col(g).alias(n) for g, n in zip(groups, names)],
        (F.coalesce(F.sum("_at_rows").over(before), F.lit(0)) - F.col("_at_first")).alias("_at_shift"), F.sum("_at_rows").over(whole).alias("size"),
    )
    meet = F.col("_at_range") == F.col("_g_range")
    for g, n in zip(groups, names):
        meet &= F.col(g).eqNullSafe(F.col(n))
    return put.drop("size").join(runs, meet).select(*[c for c in rows.columns if c not in ("place", "size")], (F.col("_at") + F.col("_at_shift")).alias("place"), "size")


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with, for each name in sums, the sum of its column over the row and all rows before it in the order.

    Built like ranked(): a task sums up its range, and one row a range carries what is before it. Sums are taken in ranges, so
    fractions may round in another way than in one walk. Give an order without ties. Columns that begin with _at or _g are replaced.
    """
    put = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    put = put.withColumn("_at_range", F.shiftright("_at", _ROW_BITS))
    ranges = put.groupBy("_at_range").agg(*[F.sum(c).alias(f"_at_{n}") for n, c in sums.items()])
    before = Window.orderBy("_at_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("_at_range").alias("_g_range"), *[F.coalesce(F.sum(f"_at_{n}").over(before), F.lit(0)).alias(f"_g_{n}") for n in sums])
    inside = Window.partitionBy("_at_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = put.select("*", *[F.sum(c).over(inside).alias(f"_at_{n}") for n, c in sums.items()])
    return local.join(ranges, F.col("_at_range") == F.col("_g_range")).select(*[c for c in rows.columns if c not in sums], *[(F.col(f"_g_{n}") + F.col(f"_at_{n}")).alias(n) for n in sums])
