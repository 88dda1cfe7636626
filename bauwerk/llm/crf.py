"""Operator 5: toxic spans by a linear-chain conditional random field.

Tokens are words; a token is toxic or not. Labels are given per document, so tokens are labelled from these first:
in a toxic document, a word is toxic if it, or the way it begins, occurs in toxic documents far more often than chance
allows. The field learns from these tokens; its marginals, by forward-backward, give spans, and summed up they give the
document's score.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import slices
from .labelled import LONGEST, fit_logistic, labelled_sample, sigmoid
from .shared import WORD, documents, id_crc

#: Labelled texts of each class (0 clean, 1 toxic) that the field is fitted on.
SAMPLE = {0: 4_000, 1: 2_000}
#: Clean lines a line with toxic tokens that take part in training; steps of the optimiser.
CLEAN_LINES = 2
STEPS = 80
#: Share of toxic documents among those with a feature from which on it marks tokens, and the share of marking features that
#: chance may account for.
PURITY, DOUBT = 0.8, 0.1
THRESHOLD = 0.5
#: Words whose emission a task remembers.
REMEMBERED = 1_000_000
#: Tokens of training lines that a step looks at together, and texts that the fit tags at once; both bound its memory.
TOKENS, TAGGED = 200_000, 200
#: Bytes of text that a task tags at once, whole texts at least.
CHARS = 4_000_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: bytes) -> list[str]:
    """The word itself without marks at its ends, how it begins and how it ends."""
    bare = _EDGES.sub("", word.decode(errors="replace").lower())
    found = [f"w{bare}"] if bare else ["mark"]
    found += [f"{k}{bare[:k]}" for k in (3, 4, 5, 6) if len(bare) > k]
    if len(bare) > 4:
        found.append(f"s{bare[-3:]}")
    return found


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once, in odds of toxic to clean.

    emission: log potential of toxic, all chains' tokens in a row; moves: 2 x 2 log potentials. Returns for each token the
    forward odds, the backward odds and the marginal probability. Chains are walked together, longest first.
    """
    n = len(emission)
    forward, backward = np.zeros(n), np.ones(n)
    if n == 0:
        return forward, backward, forward
    psi = np.exp(np.clip(emission, -30, 30))
    (t00, t01), (t10, t11) = np.exp(moves)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, ordered = starts[order], lengths[order]
    longest = int(ordered[0])
    active = np.searchsorted(-ordered, -np.arange(longest), "left")
    at = starts[: active[0]]
    odds = psi[at]
    forward[at] = odds
    for t in range(1, longest):
        k = active[t]
        at = starts[:k] + t
        odds = odds[:k]
        odds = psi[at] * (t01 + odds * t11) / (t00 + odds * t10)
        forward[at] = odds
    back = np.zeros(0)
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]
        if len(back) < k:
            back = np.r_[back, np.ones(k - len(back))]
        after = psi[starts[:k] + t + 1] * back
        back = (t10 + t11 * after) / (t00 + t01 * after)
        backward[starts[:k] + t] = back
    both = forward * backward
    return forward, backward, both / (1 + both)


class Field:
    """Weights of features and moves, and the document's calibration. Bounded by the sample it was fitted on."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, document: np.ndarray | None = None, constant: float | None = None):
        self.weights, self.moves, self.document, self.constant = weights, moves, document, constant

    def emission(self, word: bytes) -> float:
        get = self.weights.get
        return self.weights["bias"] + sum(get(f, 0.0) for f in features(word))

    def remembering(self):
        field = self

        class Memory(dict):
            def __missing__(self, word):
                if len(self) > REMEMBERED:
                    self.clear()
                self[word] = got = field.emission(word)
                return got

        return Memory()

    def tagged(self, texts: list[bytes], memory=None) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all tokens in a row, number of tokens of each text)."""
        memory = self.remembering() if memory is None else memory
        look = memory.__getitem__
        words = [t.lower().split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        emission = np.concatenate([np.zeros(0), *[np.fromiter(map(look, w), np.float64, len(w)) for w in words]])
        return marginals(emission, lengths, self.moves)[2], lengths

    def scores(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lengths), self.constant)
        return sigmoid(document_features(p, lengths) @ self.document)


def document_features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Constant, expected number of toxic tokens, number of likely ones."""
    starts = np.cumsum(lengths) - lengths
    total = lambda x: np.array([x[a : a + n].sum() for a, n in zip(starts, lengths)])
    return np.c_[np.ones(len(lengths)), np.log1p(total(p)), np.log1p(total((p > 0.5).astype(float)))]


def marked_features(sample: list[tuple[bytes, int]]) -> set[str]:
    """Features that are nearly only in toxic documents, beyond what chance does to so many features."""
    share = sum(y for _, y in sample) / max(1, len(sample))
    if not 0 < share < 1:
        return set()
    index: dict[str, int] = {}
    seen = array("i"), array("i")
    for text, y in sample:
        for feature in {f for w in set(text.lower().split()) for f in features(w)}:
            at = index.setdefault(feature, len(index))
            if at == len(seen[0]):
                seen[0].append(0), seen[1].append(0)
            seen[y][at] += 1
    found = []
    for feature, clean, toxic in zip(index, *seen):
        n = clean + toxic
        pure = toxic / n
        if pure >= PURITY and pure > share:
            surprise = n * (pure * math.log(pure / share) + ((1 - pure) * math.log((1 - pure) / (1 - share)) if pure < 1 else 0))
            found.append((surprise, feature))
    # Chance reaches a surprise of s with at most exp(-s) of all features, so the k most surprising ones hold len(index) * exp(-s) by
    # chance; the largest k for which these are few among k.
    found.sort(reverse=True)
    kept = max((k for k, (surprise, _) in enumerate(found, 1) if surprise >= math.log(len(index) / (DOUBT * k))), default=0)
    return {feature for _, feature in found[:kept]}


def token_labels(words: list[bytes], marked: set[str]) -> np.ndarray:
    return np.array([any(f in marked for f in features(w)) for w in words], float)


def fit(sample: list[tuple[bytes, int]], counts: dict[int, int]) -> Field:
    """A field of labelled texts. Where nothing marks toxic documents, every score is the share of toxic labels."""
    total = sum(counts.values())
    marked = marked_features(sample)
    constant = Field({"bias": 0.0}, np.zeros((2, 2)), constant=counts.get(1, 0) / total if total else 0.5)
    if not marked:
        return constant
    hot, cold = [], []
    for text, y in sample:
        for line in text.lower().split(b"\n"):
            labels = token_labels(line.split(), marked) if y else np.zeros(1)
            (hot if labels.any() else cold).append(line)
    clean = [line for line in cold[:: max(1, len(cold) // max(1, CLEAN_LINES * len(hot)))] if line.split()]
    lines = sorted([*((line, True) for line in hot), *((line, False) for line in clean)], key=lambda x: -len(x[0].split()))
    del hot, cold, clean
    index: dict[bytes, int] = {}
    tokens, labels, lengths = array("i"), array("b"), array("i")
    for line, toxic in lines:
        words = line.split()
        tokens.extend(index.setdefault(w, len(index)) for w in words)
        labels.extend(token_labels(words, marked).astype(int).tolist() if toxic else [0] * len(words))
        lengths.append(len(words))
    del lines
    tokens, labels, lengths = np.array(tokens), np.array(labels), np.array(lengths, np.int64)
    names: dict[str, int] = {"bias": 0}
    rows, cols = array("i"), array("i")
    for w, i in index.items():
        found = ["bias", *features(w)]
        rows.extend([i] * len(found))
        cols.extend(names.setdefault(f, len(names)) for f in found)
    rows, cols = np.array(rows), np.array(cols)
    # Lines of about the same length stand together: blocks of them are walked one after another.
    block = np.cumsum(lengths) // TOKENS
    blocks, at = [], 0
    for number in np.unique(block):
        some = lengths[block == number]
        blocks.append((slice(at, at + int(some.sum())), some))
        at += int(some.sum())
    weights, moves = np.zeros(len(names)), np.zeros((2, 2))
    weights[0] = -2.0
    size = len(names) + 4
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        words, by_word, extra = np.bincount(rows, weights[cols], minlength=len(index)), np.zeros(len(index)), np.zeros((2, 2))
        t = np.exp(moves)
        for where, some in blocks:
            y = labels[where]
            emission = words[tokens[where]]
            forward, backward, p = marginals(emission, some, moves)
            inner = np.ones(len(y), bool)
            inner[np.cumsum(some) - some] = False
            after = np.flatnonzero(inner)
            a, b = forward[after - 1], np.exp(np.clip(emission[after], -30, 30)) * backward[after]
            joint = np.array([np.full(len(after), t[0, 0]), t[0, 1] * b, t[1, 0] * a, t[1, 1] * a * b])
            extra += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2) - np.bincount(y[after - 1] * 2 + y[after], minlength=4).reshape(2, 2)
            by_word += np.bincount(tokens[where], p - y, minlength=len(index))
        grad = np.r_[np.bincount(cols, by_word[rows], minlength=len(names)) + 0.05 * weights, extra.ravel() + 0.05 * moves.ravel()]
        grad[len(names)] = 0.0  # the other moves are relative to clean after clean
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        change = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights -= change[: len(names)]
        moves -= change[len(names) :].reshape(2, 2)
    field = Field({k: float(weights[i]) for k, i in names.items() if k == "bias" or abs(weights[i]) > 1e-3}, moves)
    memory = field.remembering()
    some = (field.tagged([t for t, _ in sample[lo : lo + TAGGED]], memory) for lo in range(0, len(sample), TAGGED))
    measured = np.concatenate([document_features(p, n) for p, n in some])
    truth = np.array([label for _, label in sample])
    share = np.array([counts[0], counts[1]]) / total * len(truth) / np.maximum(1, np.bincount(truth, minlength=2))
    field.document = fit_logistic(measured, truth, share[truth], penalty=0.1)
    return field


def tag(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """(doc_id, score, spans) of every row: the document's score, 0 to 1, and its offending spans with offsets in code
    points, end exclusive, and their marginal; neighbouring tokens make one span.

    One pass without shuffle; texts of any length are tagged whole. An empty table gives an empty result. A null or empty text has no tokens: it gets the
    score that none give, and no spans. Repeated rows get equal results; other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])
    word = re.compile(WORD)

    def spans(text: str, p: np.ndarray) -> list[dict]:
        found, last = [], -2
        hot = set(np.flatnonzero(p >= least).tolist())
        for i, m in enumerate(word.finditer(text)):
            if i in hot:
                if last == i - 1:
                    found[-1]["end"] = m.end()
                    found[-1]["probability"] = max(found[-1]["probability"], float(p[i]))
                else:
                    found.append({"start": m.start(), "end": m.end(), "probability": float(p[i])})
                last = i
        return found

    def run(batches):
        memory = shared.value.remembering()
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), CHARS):
                part = batch.slice(lo, hi - lo)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                p, n = shared.value.tagged(texts, memory)
                starts = np.cumsum(n) - n
                hot = np.array([bool(len(x)) and x.max() >= least for x in (p[a : a + k] for a, k in zip(starts, n))], bool)
                every = [spans(t.decode(), p[a : a + k]) if h else [] for t, a, k, h in zip(texts, starts, n, hot)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(p, n), pa.float64()), pa.array(every, pa.list_(span))], names=["doc_id", "score", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, score double, spans array<struct<start: int, end: int, probability: double>>")


def train(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] | None = None, longest: int = LONGEST) -> Field:
    """A field of at most sizes[y] labelled texts of each class, none longer than ``longest`` characters. Without documents or labels
    every score is a half."""
    return fit(*labelled_sample(docs, labels, "toxic", sizes or SAMPLE, longest))


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from labels outside of fold 0, and its offending spans, start:end:probability joined by commas."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    tagged = tag(docs, train(docs, labels))
    joined = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], F.format_number(s["probability"], 4)))
    return tagged.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), F.array_join(joined, ",").alias("spans"))
