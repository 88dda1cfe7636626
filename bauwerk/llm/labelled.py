"""Bounded samples of labelled texts, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_crc

#: Characters of the longest text that may be drawn for fitting, which bounds the sample; scoring uses every text whole.
LONGEST = 200_000
#: Rows of one id that may be drawn for fitting.
ROWS = 4


def training_rows(labels: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """(doc_id, y) that may be learned from: not of fold 0, one row an id; of contradicting labels the larger holds."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_crc() % folds != 0))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int], longest: int = LONGEST, most_rows: int = ROWS) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most sizes[y] texts of each class, those whose ids have the smallest hashes, and how many rows each class has.

    The sample's size is a parameter, so the join may broadcast it; an id counts with the texts of most_rows of its rows, those with the
    smallest hashes, so an id that stands in very many rows brings no more. Null texts count as empty; texts of more than
    ``longest`` characters aren't drawn. Ties are equal texts, so which of them is drawn doesn't matter.
    """
    rows = training_rows(labels, label).persist()
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    picked = None
    for y, size in sizes.items():
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    drawn = texts.join(F.broadcast(picked), "doc_id").withColumn("nth", nth).where(F.col("nth") <= most_rows)
    found = drawn.select(F.xxhash64("doc_id").alias("h"), "y", F.col("text").cast("binary").alias("text")).collect()
    rows.unpersist()
    return [(bytes(r["text"]), r["y"]) for r in sorted(found, key=lambda r: (r["h"], bytes(r["text"])))], counts


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression whose first column is the constant; Newton steps that never go up."""

    def loss(w: np.ndarray) -> float:
        m = x @ w
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + penalty * (w[1:] @ w[1:]) / 2)

    w = np.zeros(x.shape[1])
    keep = np.r_[1e-6, np.full(x.shape[1] - 1, penalty)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + keep * w
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(keep) + 1e-9 * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))
