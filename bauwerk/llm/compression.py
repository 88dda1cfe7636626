"""Operator 4: quality by compression with dictionaries of good and of bad text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import LONGEST, fit_logistic, labelled_sample, sigmoid
from .blocks import slices
from .shared import documents, id_crc

#: Labelled texts a class that the classifier is fitted on; every other one builds dictionaries, the rest calibrates.
SAMPLE = 3_000
DICTIONARY = 112_640
LEVEL = 3
THRESHOLD = 0.3
#: Bytes of text that a task scores at once, whole texts at least.
CHARS = 4_000_000


class Model:
    """Two dictionaries and the calibration; sent to the tasks, some 300 KB."""

    def __init__(self, dictionaries: tuple[bytes, bytes], mean=None, spread=None, weights=None, constant: float | None = None):
        self.state = dictionaries, mean, spread, weights, constant
        self._compressors = None

    def __getstate__(self):
        return self.state

    def __setstate__(self, state):
        self.__init__(*state)

    def _sizes(self, texts: list[bytes]) -> np.ndarray:
        """Compressed sizes with the dictionary of bad and of good text, less what an empty text takes."""
        if self._compressors is None:
            made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in self.state[0]]
            self._compressors = [(c.compress, len(c.compress(b""))) for c in made]
        return np.array([[len(run(t)) - empty for run, empty in self._compressors] for t in texts], float).reshape(-1, 2)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The size difference by length, how far the text compresses at all, and terms that let both depend on length."""
        size = self._sizes(texts)
        n = np.maximum(1, np.array([len(t) for t in texts], float))
        diff = (size[:, 0] - size[:, 1]) / n
        least = size.min(axis=1) / n
        return np.c_[diff, diff**2, least, least**2, diff * np.log(n), np.log(n)]

    def calibrated(self, mean, spread, weights) -> Model:
        return Model(self.state[0], mean, spread, weights)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        _, mean, spread, weights, constant = self.state
        if constant is not None:
            return np.full(len(texts), constant)
        x = (self.features(texts) - mean) / spread
        return sigmoid(np.c_[np.ones(len(x)), x] @ weights)


def fit(sample: list[tuple[bytes, int]], counts: dict[int, int]) -> Model:
    """A model of labelled texts. With fewer than eight texts of a class, every score is the share of good labels."""
    classes = {y: [t for t, label in sample if label == y] for y in (0, 1)}
    total = sum(counts.values())
    if min(len(c) for c in classes.values()) < 8:
        return Model((b"", b""), constant=counts.get(1, 0) / total if total else 0.5)
    made = []
    for y in (0, 1):
        try:
            made.append(zstandard.train_dictionary(DICTIONARY, classes[y][::2], level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text for training: the text itself is the dictionary
            made.append(b"\n".join(classes[y][::2])[-DICTIONARY:])
    model = Model(tuple(made))
    rest = [(t, y) for y in (0, 1) for t in classes[y][1::2]]
    x, y = model.features([t for t, _ in rest]), np.array([y for _, y in rest])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    # Classes weigh as often as they are labelled, however many of each were taken.
    share = np.array([counts[0], counts[1]]) / total * len(rest) / np.bincount(y, minlength=2)
    weights = fit_logistic(np.c_[np.ones(len(x)), (x - mean) / spread], y, share[y])
    return model.calibrated(mean, spread, weights)


def _sizes(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs' doc_id and its score, 0 to 1, higher for good text. A null text counts as empty and is scored like one.

    One pass without shuffle; texts of any length are compressed whole; repeated rows and equal texts get equal scores; other
    columns don't matter. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for lo, hi in slices(_sizes(batch, 1), CHARS):
                part = batch.slice(lo, hi - lo)
                scores = shared.value.scores([t or b"" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", column])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, {column} double")


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model of at most ``size`` labelled texts a class, none longer than ``longest`` characters. Without documents or labels
    every score is a half."""
    return fit(*labelled_sample(docs, labels, "quality", {0: size, 1: size}, longest))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows that score at least ``threshold``, with all their columns, whatever their names and types. The whole row goes
    through the scoring task, so nothing is shuffled. Null texts count as empty; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi in slices(_sizes(batch, place), CHARS):
                part = batch.slice(lo, hi - lo)
                texts = [(t or "").encode() for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(shared.value.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from labels outside of fold 0."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
