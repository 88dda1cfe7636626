"""Layout texts, layout XML and images as DataFrames (S3, S4, S6, S8); PDF files are in pdf.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source, text) of text files, a document each; the file's name is the source."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return rows.select("doc_id", F.url_decode(_name("doc_id")).alias("source"), "text")


def from_strings(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Texts at hand: (source, text)."""
    return spark.createDataFrame([(f"{i:06d}", s, t) for i, (s, t) in enumerate(pairs)], "doc_id string, source string, text string")


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, layout_xml) of layout XML files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("layout_xml"))


def read_images(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """(doc_id, src, content) of image files that a document's layout names by file name."""
    return spark.read.format("binaryFile").load(path).select(F.lit(doc_id).alias("doc_id"), _name().alias("src"), "content")
