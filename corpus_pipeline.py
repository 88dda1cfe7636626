"""A corpus in five stages: quality, repeated lines, near duplicates, source weights, token ids.

Each stage takes (spark, docs, sf_dir), returns a DataFrame, and works on all that the stage before kept; between stages the
rows are written to the cluster's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bauwerk.llm import bytebpe, compression, jaccard, linededup, mixing, shared
from bauwerk.llm.shared import documents, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learned from the labels, isn't below the threshold.

    Null and empty texts are scored as empty ones; repeated rows and equal texts are judged alike, and all of them stay or go.
    Very long texts are scored whole. Without labels every score is a half, and all documents stay. An empty table gives an
    empty one. All columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return compression.keep_good(docs, compression.train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of three lines and more that stood before; n_chars follows the text.

    A null text stays null, n_chars included; a document all of whose lines are removed stays with an empty text. Of equal windows the first
    by (doc_id, row) stays; rows that repeat doc_id and text get the same result. Texts of any length are taken whole. An
    empty table gives an empty one. Columns other than text and n_chars stay as they are, whatever their names.
    """
    kept = linededup.dedup_lines(docs).select(*[F.col(f"`{x}`") for x in docs.columns])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Null, empty and blank texts are no copies of each other and stay; rows that repeat doc_id and text are one document. Texts
    of any length are compared whole. An empty table gives an empty one. All columns stay, whatever their names.
    """
    return jaccard.drop_near_duplicates(docs)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice.

    Null and empty texts have no words and are taken like others of their source; a null source is one, after all others. Of equal rows
    one goes on, as often as all are taken together. A source without words gives none. An empty table gives an empty one.
    All columns stay, whatever their names.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): token counts and digests of ids and of their decoded bytes, a row for each row.

    A null or empty text has no ids, and the digests of nothing. Texts of any length are encoded whole. An empty table gives an
    empty one. Other columns don't matter.
    """
    vocabulary = bytebpe.load_vocabulary()
    return bytebpe.digests(bytebpe.decode(bytebpe.encode(docs, vocabulary), vocabulary))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("sources", sources), ("tokens", tokens)]

#: Compression and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents that all stages keep. Each stage's own tables are removed once its result is written."""
    docs, before = documents(spark, sf_dir), shared.written()
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        shared.release(since=before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
