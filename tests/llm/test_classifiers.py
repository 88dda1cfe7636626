import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bauwerk.llm import compression, crf, labelled

DOCS = "doc_id long, text string, score int, y string"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def made(n, seed=1):
    """Good prose and bad junk, some of it toxic: (doc_id, text, quality, toxic)."""
    rnd = random.Random(seed)
    syllables = "on er the ing tion ha st re ly ed nd ou".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rnd.randint(4, 12))) + "." for _ in range(rnd.randint(2, 12))]
        quality, toxic = int(rnd.random() < 0.7), int(rnd.random() < 0.25)
        if not quality:
            lines += [" ".join(word() + rnd.choice(["%%%", "$$$", "###"]) for _ in range(10)) for _ in range(8)]
        if toxic:
            for _ in range(rnd.randint(2, 4)):
                at = rnd.randrange(len(lines))
                lines[at] += " " + rnd.choice(["brabble", "grumbex", "vexo" + word()]) + " " + word()
        out.append((i, "\n".join(lines), quality, toxic))
    return out


@pytest.fixture(scope="module")
def rows():
    return made(1500)


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")


def accuracy(got, rows, column, threshold):
    truth = {r[0]: r[column] for r in rows}
    held = [r for r in got if r.doc_id in truth and fold(r.doc_id) == 0]
    assert len(held) > 200
    return sum((r.score >= threshold) == truth[r.doc_id] for r in held) / len(held)


def test_quality_scores_against_plain_compression(spark, rows):
    import zstandard

    docs, labels = tables(spark, rows[:300])
    model = compression.train(docs, labels)
    dictionaries, mean, spread, weights, _ = model.state
    texts = {i: t.encode() for i, t, _, _ in rows[:300]} | {9001: b"", 9002: b"z" * 70000}
    more = spark.createDataFrame([(9001, None, 1, "x"), (9002, "z" * 70000, 1, "x")], DOCS)
    for r in compression.score(docs.unionByName(more), model).collect():
        text, size = texts[r.doc_id], []
        for d in dictionaries:
            pack = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            size.append(len(pack.compress(text)) - len(pack.compress(b"")))
        n = max(1, len(text))
        bad, good = size
        x = [(bad - good) / n, ((bad - good) / n) ** 2, min(size) / n, (min(size) / n) ** 2, (bad - good) / n * math.log(n), math.log(n)]
        m = weights[0] + sum(w * (v - a) / s for w, v, a, s in zip(weights[1:], x, mean, spread))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, m)))), rel=1e-9)


def test_quality_on_held_out_rows(spark, rows):
    docs, labels = tables(spark, rows)
    model = compression.train(docs, labels)
    odd = spark.createDataFrame([(9001, None, 1, "x"), (9002, "", 1, "x"), (None, "text", 1, "x"), (3, "a" * 300000, 1, "x")], DOCS)
    got = compression.score(docs.unionByName(odd), model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    assert accuracy(got, rows, 2, 0.5) > 0.95
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[9001] == by_id[9002]
    kept = compression.keep_good(docs.unionByName(odd), model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.score >= compression.THRESHOLD)


def test_labels_of_fold_0_are_never_read(spark, rows):
    docs, labels = tables(spark, rows)
    got = labelled.training_rows(labels, "quality").collect()
    assert got and all(fold(r.doc_id) for r in got)
    flipped = spark.createDataFrame([(i, q if fold(i) else 1 - q, 0) for i, _, q, _ in rows], "doc_id long, quality int, toxic int")
    a, b = (compression.train(docs, x) for x in (labels, flipped))
    texts = [r[1].encode() for r in rows[:50]]
    assert (a.scores(texts) == b.scores(texts)).all()


def test_few_or_no_labels(spark, rows):
    docs, labels = tables(spark, rows[:10])
    empty = labels.limit(0)
    assert [r.score for r in compression.score(docs, compression.train(docs, empty)).collect()] == [0.5] * 10
    assert [r.score for r in crf.tag(docs, crf.train(docs, empty)).collect()] == [0.5] * 10
    assert compression.score(docs.limit(0), compression.train(docs, labels)).count() == 0
    assert crf.tag(docs.limit(0), crf.train(docs, labels)).count() == 0


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 5, 1, 4])
    emission, moves = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    got = crf.marginals(emission, lengths, moves)[2]
    at = 0
    for n in lengths:
        e = emission[at : at + n]
        total, hot = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(e[i] for i in range(n) if tags[i]) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            hot += w * np.array(tags, float)
        assert got[at : at + n] == pytest.approx(hot / total)
        at += n


def test_toxicity_on_held_out_rows_and_spans(spark, rows):
    docs, labels = tables(spark, rows)
    field = crf.train(docs, labels)
    odd = spark.createDataFrame([(9001, None, 1, "x"), (9002, "", 1, "x"), (None, "ü brabble BRABBLE! on", 1, "x"), (3, "on " * 50000 + "grumbex", 1, "x")], DOCS)
    got = crf.tag(docs.unionByName(odd), field).collect()
    assert accuracy(got, rows, 3, 0.5) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[9001].score == by_id[9002].score < 0.5 and by_id[9001].spans == []
    assert [(s.start, s.end) for s in by_id[None].spans] == [(2, 18)]
    assert any(s.start == 150000 for r in got if r.doc_id == 3 for s in r.spans)


def test_the_field_learns_words_that_few_toxic_documents_hold(spark):
    rows = [(i, f"some plain words a b c {'zorgulic' if i % 600 == 2 else 'quiet'} end", int(i % 3 == 2)) for i in range(6000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    field = crf.train(docs, labels)
    assert field.constant is None
    p, _ = field.tagged([b"some plain zorgulic words", b"some plain quiet words"])
    assert [x > 0.5 for x in p] == [False, False, True, False] + [False] * 4


def test_blocks_of_lines_and_texts_make_the_same_field(monkeypatch):
    sample = [(f"plain {i % 7} words\nthen {'vile' if i % 3 == 0 else 'good'} ones {'more ' * (i % 5)}".encode(), int(i % 3 == 0)) for i in range(300)]
    whole = crf.fit(sample, {0: 200, 1: 100})
    monkeypatch.setattr(crf, "TOKENS", 20)
    monkeypatch.setattr(crf, "TAGGED", 7)
    parts = crf.fit(sample, {0: 200, 1: 100})
    assert parts.weights == pytest.approx(whole.weights) and parts.moves == pytest.approx(whole.moves) and parts.document == pytest.approx(whole.document)


def test_toxicity_scores_against_sums_over_all_tag_sequences():
    """A document's score from marginals that come from every sequence of tags."""
    weights = {"bias": -1.0, "wbad": 2.5, "wugly": 1.5, "wgood": -1.0}
    moves = np.array([[0.0, -0.5], [-0.2, 0.9]])
    document = np.array([-1.0, 0.8, 1.7])
    field = crf.Field(weights, moves, document)
    texts = [b"good bad ugly bad", b"bad", b"", b"ugly ugly good good bad x"]
    p, lengths = field.tagged(texts)
    got = field.scores(p, lengths)
    for text, score in zip(texts, got):
        words = text.split()
        emission = [weights["bias"] + weights.get("w" + w.decode(), 0.0) for w in words]
        total, marked = 0.0, np.zeros(len(words))
        for tags in itertools.product((0, 1), repeat=len(words)):
            mass = math.exp(sum(e * t for e, t in zip(emission, tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += mass
            marked += mass * np.array(tags)
        marked = marked / total if len(words) else marked
        m = document[0] + document[1] * math.log1p(marked.sum()) + document[2] * math.log1p((marked > 0.5).sum())
        assert score == pytest.approx(1 / (1 + math.exp(-m)), rel=1e-9)


def test_the_sample_takes_null_texts_and_leaves_out_very_long_ones(spark):
    docs = spark.createDataFrame([(1, None), (2, "x" * 50), (3, "x" * 51), (4, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "doc_id long, quality int")
    sample, counts = labelled.labelled_sample(docs, labels, "quality", {0: 5, 1: 5}, longest=50)
    known = {i for i in (1, 2, 3, 4) if fold(i) != 0}
    assert sum(counts.values()) == len(known)
    assert sorted(t for t, _ in sample) == sorted({1: b"", 2: b"x" * 50, 4: b"y"}[i] for i in known - {3})


def test_an_id_in_100000_rows_brings_few_of_them(spark):
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionByName(spark.createDataFrame([(2, "b"), (2, None), (3, "c")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    kept = {r.doc_id for r in labelled.training_rows(labels, "quality").collect()}
    texts, counts = labelled.labelled_sample(docs, labels, "quality", {0: 10, 1: 10})
    assert sum(counts.values()) == len(kept)
    assert len(texts) == labelled.ROWS * (1 in kept) + 2 * (2 in kept) + (3 in kept)
    assert texts == labelled.labelled_sample(docs.repartition(5), labels, "quality", {0: 10, 1: 10})[0]
