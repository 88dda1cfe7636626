"""Texts that arrive in a folder, parsed as they come: the batch plan for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bauwerk.plans.pipeline import parse_documents


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return rows.select("doc_id", F.element_at(F.split("doc_id", "/"), -1).alias("source"), "text")


def write_tables(out: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: every table of every batch into a folder of its own, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        tables = parse_documents(batch.persist())
        try:
            for name in ("documents", "nodes", "positions", "warnings"):
                tables[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            tables.release()
            batch.unpersist()

    return write


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parse new files in path into Parquet tables under out. A document is whole in its file, so no state is kept."""
    writer = stream_texts(spark, path).writeStream.foreachBatch(write_tables(out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
