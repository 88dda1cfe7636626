"""The stages on small rows, each held against a brute-force version on its own input."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_classifiers import made  # noqa: E402
from test_jaccard import brute as brute_components  # noqa: E402
from test_linededup import brute as brute_lines  # noqa: E402

from bauwerk.llm import bytebpe, compression, mixing  # noqa: E402


def test_stages(spark, tmp_path):
    rows = made(160)
    rows += [(1000 + i, t + ("\nan own last line" if i % 2 else ""), q, x) for i, (_, t, q, x) in enumerate(rows[:20])]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, columns, before, tables = dict(corpus_pipeline.STAGES), docs.columns, spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, before, str(tmp_path)).write.parquet(out)
        tables[name] = (before.collect(), spark.read.parquet(out).collect())
        before = spark.read.parquet(out)
        assert name == "tokens" or before.columns == columns
    assert len(stages) == 5

    given, kept = tables["quality"]
    model = compression.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = model.scores([r.text.encode() for r in given])
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r, s in zip(given, scores) if s >= compression.THRESHOLD)

    given, kept = tables["lines"]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(((i, t) for i, t, _, _ in brute_lines([(r.doc_id, r.text) for r in given])), key=str)

    given, kept = tables["near_duplicates"]
    assert sorted(r.doc_id for r in kept) == sorted(i for i, n, c in brute_components([(r.doc_id, r.text) for r in given]) if n == 0 or i == c)

    given, kept = tables["sources"]
    copies = {r.doc_id: r.copies for r in mixing.mix_copies(spark.createDataFrame(given)).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(i for i, n in copies.items() for _ in range(n))

    given, kept = tables["tokens"]
    vocabulary = bytebpe.load_vocabulary()
    vocabulary.encode_piece(b"a")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r.doc_id, sha(" ".join(map(str, vocabulary._encoding.encode_ordinary(r.text))).encode()), sha(r.text.encode())) for r in given]
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in kept) == sorted(want)


CLASHING = ["row", "hash", "nth", "key", "set", "k1", "copies", "lines", "gone", "ids", "bucket", "score"]


def odd_tables(spark, folder, rows):
    """documents with odd rows and columns that have the stages' own names, and labels."""
    extra = ", ".join(f"doc_id * 3 + {i} AS `{x}`" for i, x in enumerate(CLASHING))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra.split(", "), "map('a', doc_id) AS `first`")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:3]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    passage = "one long line of text\nanother one below it\nand a third line\n"
    rows = [
        (1, passage + "first own line", "en", "a", 9), (2, passage + "second own line", None, "a", 9), (3, None, "en", None, None), (4, "", "en", "a", 0), (5, " \n\t", "en", "b", 3),
        (6, "the very same words here", "en", "b", 9), (7, "The very  same words here", "en", None, 9), (6, "the very same words here", "en", "b", 9), (6, "the very same words here", "en", "b", 9),
        (None, "a text without an id", "en", "a", 9), (8, " ".join(f"w{i}" for i in range(60000)), "en", "c", 9),
    ]
    before, stages = odd_tables(spark, tmp_path, rows), dict(corpus_pipeline.STAGES)
    seen = {}
    for name in ("quality", "lines", "near_duplicates", "sources"):
        stages[name](spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == before.columns
        seen[name] = [(r.doc_id, r.text, r.n_chars) for r in after.collect()]
        for r in after.where("doc_id IS NOT NULL").collect():
            assert [r[x] for x in CLASHING] == [r.doc_id * 3 + i for i in range(len(CLASHING))] and r["first"] == {"a": r.doc_id}
        before = after
    assert sorted(seen["quality"], key=str) == sorted(((r[0], r[1], r[4]) for r in rows), key=str)
    assert (2, "second own line", 15) in seen["lines"] and (3, None, None) in seen["lines"] and len(seen["lines"]) == len(rows)
    assert sorted(i for i, *_ in seen["near_duplicates"] if i) == [1, 2, 3, 4, 5, 6, 8]
    assert {t for _, t, _ in seen["sources"]} <= {t for _, t, _ in seen["near_duplicates"]}
    out = stages["tokens"](spark, before, str(tmp_path)).collect()
    assert len(out) == len(seen["sources"])


def test_stages_on_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, [(1, "x", "en", "a", 1)]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        assert after.count() == 0
        assert name == "tokens" or after.columns == docs.columns


def test_run_removes_the_tables_of_its_stages(spark, tmp_path):
    from bauwerk.llm import shared

    odd_tables(spark, tmp_path, [(i, f"some words of text number {i}", "en", "a", 1) for i in range(20)])
    before = shared.written()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 30
    assert shared.written() <= before + 2
    shared.release(since=before)
    assert shared.written() == before


def test_encoding_what_a_shuffle_gives(spark):
    vocabulary = bytebpe.load_vocabulary()
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text").repartition(5)
    got = {r.doc_id: r.ids for r in bytebpe.encode(docs, vocabulary).collect()}
    vocabulary.encode_piece(b"a")
    assert got == {i: vocabulary._encoding.encode_ordinary(f"text {i % 7}") for i in range(400)}
