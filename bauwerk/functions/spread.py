"""Rows dealt out by key, to tasks whose number follows the input's size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files for each task that sorts its share of the rows.
TASK_BYTES = 8 << 20


def tasks_for(df: DataFrame) -> int:
    """Tasks for a shuffle of df: as many as the session sets, and more where the files that df reads ask for it."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # rows that are no table count as 2^63 - 1
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // TASK_BYTES))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys, so that a task's share doesn't grow with the input, nor does the memory to sort it. What follows by these keys,
    or by more than these, stays there."""
    return df.repartition(tasks_for(df), *keys)
