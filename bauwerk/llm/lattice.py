"""Operator 8: scoring texts by the marginal probability of all their subword segmentations.

The pieces and their scores come from an existing vocabulary. The scores give the weights that segmentations start with;
one pass over all training words (expected counts, weighted by how often a word occurs) re-estimates the
pieces' probabilities. A piece never crosses a word, so the lattice of a document falls apart at its words: the
forward recursion runs once per distinct word, and the document's log probability is the sum over its words and its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .shared import documents, id_crc, materialise, partitions_for

#: Marks the start of a word in the vocabulary's pieces.
START = "▁"
#: Words up to this length run the recursions on probabilities first, and on logs if these come out below SAFE; longer
#: ones on logs at once. Probabilities from a position on sum to at most 1, so what underflows on the way, under 1e-307
#: each, can't matter to a result of SAFE or more.
SHORT = 32
SAFE = 1e-200
#: Weight of the vocabulary's own distribution against the counts, in pieces.
PRIOR = 2_000.0
LOG10 = math.log(10)


def split_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.lower and bytes.split know ASCII only, which is what is asked for."""
    return text.lower().split()


class Pieces:
    """Pieces with probabilities. ``tree`` maps each prefix of a piece to the piece's probability, 0 where it is none."""

    def __init__(self, weights: dict[str, float], byte_weights: list[float], end: float):
        total = sum(weights.values()) + sum(byte_weights) + end
        self.weights = {p: w / total for p, w in weights.items()}
        self.bytes = [w / total for w in byte_weights]
        self.end = end / total
        self.tree: dict[str, float] = {}
        for piece in self.weights:
            for i in range(1, len(piece)):
                self.tree.setdefault(piece[:i], 0.0)
        self.tree.update(self.weights)

    def __getstate__(self):
        return self.weights, self.bytes, self.end

    def __setstate__(self, state):
        self.__init__(*state)

    def arcs(self, word: str, i: int) -> Iterator[tuple[int, float]]:
        """Ends and probabilities of the pieces that start at i; a character that is no piece is spelled in bytes."""
        get, n, j = self.tree.get, len(word), i + 1
        p = get(word[i:j])
        if not p:
            spelled = 1.0
            for b in word[i].encode():
                spelled *= self.bytes[b]
            yield j, spelled
        while p is not None:
            if p:
                yield j, p
            j += 1
            if j > n:
                return
            p = get(word[i:j])

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations of START + word."""
        word = START + word
        n = len(word)
        if n <= SHORT:
            forward = [0.0] * (n + 1)
            forward[0] = 1.0
            for i in range(n):
                if a := forward[i]:
                    for j, p in self.arcs(word, i):
                        forward[j] += a * p
            if forward[n] >= SAFE:
                return math.log(forward[n])
        logs: list[float] = [-math.inf] * (n + 1)
        logs[0] = 0.0
        for i in range(n):
            a = logs[i]
            if a > -math.inf:
                for j, p in self.arcs(word, i):
                    x, y = a + math.log(p), logs[j]
                    hi, lo = (x, y) if x > y else (y, x)
                    logs[j] = hi + math.log1p(math.exp(lo - hi))
        return logs[n]

    def expect(self, word: str, count: float, into: dict) -> None:
        """Add count times the expected numbers of pieces over all segmentations; bytes as integers."""
        word = START + word
        n = len(word)
        arcs = [list(self.arcs(word, i)) for i in range(n)]
        if n > SHORT:
            self._expect_long(word, arcs, count, into)
            return
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        forward[0] = backward[n] = 1.0
        for i in range(n):
            if a := forward[i]:
                for j, p in arcs[i]:
                    forward[j] += a * p
        if forward[n] < SAFE:
            self._expect_long(word, arcs, count, into)
            return
        for i in range(n - 1, -1, -1):
            backward[i] = sum(p * backward[j] for j, p in arcs[i])
        scale = count / forward[n]
        for i in range(n):
            if a := forward[i]:
                for j, p in arcs[i]:
                    self._add(word[i:j], a * p * backward[j] * scale, into)

    def _expect_long(self, word: str, arcs: list, count: float, into: dict) -> None:
        n = len(word)
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        for i in range(n):
            for j, p in arcs[i]:
                forward[j] = np.logaddexp(forward[j], forward[i] + math.log(p))
        for i in range(n - 1, -1, -1):
            for j, p in arcs[i]:
                backward[i] = np.logaddexp(backward[i], backward[j] + math.log(p))
        for i in range(n):
            for j, p in arcs[i]:
                self._add(word[i:j], count * math.exp(forward[i] + math.log(p) + backward[j] - forward[n]), into)

    def _add(self, piece: str, amount: float, into: dict) -> None:
        if piece in self.weights:
            into[piece] = into.get(piece, 0.0) + amount
        else:
            for b in piece.encode():
                into[b] = into.get(b, 0.0) + amount


def read_pieces(path: str | None = None) -> Pieces:
    """Pieces of a sentencepiece model, without control pieces.

    Scores that are log probabilities are used as they are; scores that only rank (their exponentials don't
    sum up to about 1) weigh a piece by the inverse of its rank, as Zipf's law has it.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    mass = sum(math.exp(s) for s in scores.values() if s < 50)
    if 0.5 < mass < 1.5:
        weights = {p: math.exp(s) for p, s in scores.items()}
    else:
        top = max(scores.values())
        weights = {p: 1 / (20.0 + top - s) for p, s in scores.items()}
    total = sum(weights.values())
    return Pieces({p: w / total for p, w in weights.items()}, [1e-5] * 256, 1e-2)


VOCABULARY = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("check", T.LongType()), T.StructField("types", T.LongType()), T.StructField("tokens", T.LongType())]
    + [T.StructField(x, T.BinaryType()) for x in ("a", "b", "c")]
)
_VOCABULARY = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _emit(rows: list[tuple]):
    for at in range(0, len(rows), 200):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 200]), _VOCABULARY)], names=VOCABULARY.names)


def _gather(batches):
    """Per bucket: its distinct words with their counts (kind 0), and where each block's words stand among these (kind 1)."""
    buckets: dict[int, tuple[dict[bytes, int], list]] = {}
    for batch in batches:
        rows = []
        for bucket, number, check, blob, sizes, places, counts in zip(*[c.to_pylist() for c in batch.columns]):
            words, totals = buckets.setdefault(bucket, ({}, []))
            at = np.fromiter([words.setdefault(w, len(words)) for w in blocks.unpack_words(blob, sizes)], np.int64)
            totals.append((at, np.frombuffer(counts, "<u4")))
            rows.append((bucket, 1, number, check, None, None, places, blocks.pack_codes(at.astype(np.uint32)), None))
        yield from _emit(rows)
    for bucket, (words, totals) in buckets.items():
        counts = np.zeros(len(words), np.uint64)
        for at, n in totals:
            counts[at] += n.astype(np.uint64)
        blob, sizes = blocks.pack_words(list(words))
        yield from _emit([(bucket, 0, None, None, int((counts > 0).sum()), int(counts.sum()), blob, sizes, counts.astype("<u8").tobytes())])


def learn_pieces(vocabulary: DataFrame, start: Pieces, ends: int, prior: float = PRIOR) -> Pieces:
    """Probabilities of the pieces from expected counts over all training words. What reaches the driver is one
    number a piece of the vocabulary."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        into: dict = {}
        pieces = shared.value
        for batch in batches:
            for blob, sizes, counts in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2)]):
                for word, n in zip(blocks.unpack_words(blob, sizes), np.frombuffer(counts, "<u8").tolist()):
                    if n:
                        pieces.expect(word.decode(), n, into)
        names = [k if isinstance(k, str) else f"\0{k}" for k in into]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(into.values()), pa.float64())], names=["piece", "n"])

    words = vocabulary.where("kind = 0 AND tokens > 0").select("a", "b", "c")
    counted = words.mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = {r["piece"]: r["n"] for r in counted}
    weights = {p: counts.get(p, 0.0) + prior * w for p, w in start.weights.items()}
    spelled = [counts.get(f"\0{b}", 0.0) + prior * w for b, w in enumerate(start.bytes)]
    return Pieces(weights, spelled, ends + prior * start.end)


def score_documents(docs: DataFrame, held_out: object, start: Pieces | None = None) -> DataFrame:
    """Scores of all rows by a model of those for which the column ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Tokens are words with A-Z
    lower-cased, then one end. base_score is the add-one word model, score the log10 marginal probability over all
    segmentations into the vocabulary's pieces. A null text counts as empty: its only token is the end. Without
    training rows, counts are 0 and the pieces keep the vocabulary's own weights. Repeated rows count each time and
    give a row each; words and texts of any length are used whole; other columns don't matter.
    """
    spark = docs.sparkSession
    start = start or read_pieces()
    n = partitions_for(docs)
    rows = blocks.block_input(docs, held_out, F.col("text").cast("binary"))
    key_spark = rows.schema[0].dataType
    key_type = blocks.arrow_type(key_spark)
    coder = lambda: blocks.WordCoder(split_words)
    ends = rows.where("NOT mark").count()
    words = blocks.scan_words(rows, coder, n, True)
    vocabulary = materialise(words.repartitionById(n, "bucket").mapInArrow(_gather, VOCABULARY))
    known = vocabulary.where("kind = 0").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    train_tokens = (known["tokens"] or 0) + ends
    types = (known["types"] or 0) + (ends > 0)
    pieces = learn_pieces(vocabulary, start, ends)
    shared = spark.sparkContext.broadcast(pieces)
    schema = blocks.code_rows(key_spark)

    def weigh(batches):
        """Of each word its count and its log10 probability, to its blocks."""
        now, counts, lattice = None, None, None  # of one bucket at a time: its words come first
        for batch in batches:
            out = []
            for bucket, kind, number, check, a, b, c in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6, 7, 8)]):
                if kind == 0:
                    log = shared.value.log_probability
                    lattice = np.array([log(w.decode()) / LOG10 for w in blocks.unpack_words(a, b)])
                    now, counts = bucket, np.frombuffer(c, "<u8")
                else:
                    if bucket != now:
                        raise RuntimeError("a bucket's words are missing")
                    at = blocks.unpack_codes(b)
                    out.append((number, check, a, counts[at].astype("<u8").tobytes(), lattice[at].astype("<f8").tobytes()))
            for i in range(0, len(out), 200):
                yield blocks.found_batch(out[i : i + 200], key_type, schema.names)

    def learn(state, places, counts, lattice):
        state.append((np.frombuffer(places, "<u4"), np.frombuffer(counts, "<u8"), np.frombuffer(lattice, "<f8")))

    scale = math.log10(train_tokens + types + 1)
    end_base, end_lattice = math.log10(ends + 1), math.log10(pieces.end)

    def use(state, part):
        if state and not isinstance(state[0], dict):
            places = np.concatenate([s[0] for s in state])
            base, seen, lattice = np.zeros(len(places)), np.zeros(len(places), np.int64), np.zeros(len(places))
            counts = np.concatenate([s[1] for s in state]).astype(np.float64)
            base[places], seen[places] = np.log10(counts + 1), counts > 0
            lattice[places] = np.concatenate([s[2] for s in state])
            state[:] = [{"base": base, "seen": seen, "lattice": lattice}]
        n_tokens, n_known, base_score, score = [], [], [], []
        for blob in part.column(4).to_pylist():
            codes = blocks.unpack_codes(blob)
            size = len(codes) + 1
            n_tokens.append(size)
            n_known.append((int(state[0]["seen"][codes].sum()) if size > 1 else 0) + (ends > 0))
            base_score.append((float(state[0]["base"][codes].sum()) if size > 1 else 0.0) + end_base - size * scale)
            score.append((float(state[0]["lattice"][codes].sum()) if size > 1 else 0.0) + end_lattice)
        columns = [part.column(7), part.column(3), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([train_tokens] * part.num_rows, pa.int64()), pa.array(base_score, pa.float64()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    out = T.StructType(
        [T.StructField("doc_id", key_spark), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]
    )
    found = vocabulary.repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(weigh, schema)
    met = blocks.meet(found, blocks.scan_codes(rows, coder), n)
    return met.mapInArrow(lambda b: blocks.by_block(b, list, learn, use), out)


def op8_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those whose crc32(doc_id) modulo 7 is not 2."""
    docs = documents(spark, sf_dir)
    return score_documents(docs, id_crc() % 7 == 2)
