import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bauwerk.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, _k1 int"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, at_most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, still = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and still:
        total, over = sum(weight[s] for s in still), 0.0
        for s in list(still):
            target[s] += left * weight[s] / total
            if target[s] >= at_most * sizes[s]:
                over += target[s] - at_most * sizes[s]
                target[s] = at_most * sizes[s]
                still.discard(s)
        left = over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("skew", [1, 40])
def test_targets_and_words_taken(spark, skew):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 7}", "x", 1) for i in range(700)]
    rows += [(1000 + i, "same words here", "s1", "x", 1) for i in range(30 * skew)]
    rows += [(5000, None, "s2", "x", 1), (5001, "", None, "x", 1), (5002, "a b c", None, "x", 1), (None, "d", "s3", "x", 1)]
    got = mixing.mix_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += words(text)
    want = brute_targets(sizes)
    for r in got:
        assert 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.copies * r["size"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 51
    again = mixing.mix_copies(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.copies) for r in got) == sorted((str(r.doc_id), r.copies) for r in again)


def test_mix_emits_each_copy_and_all_columns(spark):
    rows = [(i % 40, f"t{i % 40} " * 9, "a" if i % 4 else "b", "x", i) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = sum(r.copies for r in mixing.mix_copies(docs).collect())
    assert mixed.count() == copies
    assert {tuple(r) for r in mixed.collect()} <= {(*r[:3], *r[3:]) for r in rows}


NAMES = ["row", "k1", "k2", "nth", "p1", "p2", "copies", "part", "copy", "rows", "first", "offset", "each", "of", "class", "cell", "_m1", "_n", "_copies"]


def test_extra_columns_come_back_as_they_were(spark):
    extra = ", ".join(f"id * 10 + {i} AS {x}" for i, x in enumerate(NAMES))
    docs = spark.sql(f"SELECT id AS doc_id, repeat('w ', 1 + id % 9) AS text, IF(id % 3 = 0, 'a', 'b') AS source, map('a', id) AS size, {extra} FROM range(200)")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want, got = {r.doc_id: r for r in docs.collect()}, mixed.collect()
    copies = {r.doc_id: r.copies for r in mixing.mix_copies(docs).collect()}
    assert sorted(r.doc_id for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
    assert all(r == want[r.doc_id] for r in got)


def test_a_row_repeated_very_often(spark):
    docs = spark.sql("SELECT IF(id < 100000, 5, id) AS doc_id, IF(id < 100000, 'one two three', concat('a ', id)) AS text, 's' AS source FROM range(100200)")
    copies = mixing.mix_copies(docs)
    assert copies.count() == 100200
    taken, sizes = copies.selectExpr("sum(copies * size)", "sum(size)").first()
    assert abs(taken - 1.5 * sizes) <= 6
    assert mixing.mix(docs).groupBy("doc_id").count().where("doc_id = 5").first()["count"] == copies.where("doc_id = 5").selectExpr("sum(copies)").first()[0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_copies(docs).count() == 0
    assert mixing.mix(docs).count() == 0


def test_every_source_empty(spark):
    docs = spark.createDataFrame([(1, "", "a", "", 1), (2, None, None, "", 1)], SCHEMA)
    assert [(r.target, r.copies) for r in mixing.mix_copies(docs).collect()] == [(0.0, 0), (0.0, 0)]


def test_targets_of_100000_sources(spark):
    """As many sources as rows: targets come from ranges of sources, and agree with filling up source by source."""
    n = 100_000
    stats = spark.range(n).select(F.concat(F.lit("s"), F.format_string("%06d", "id")).alias("source"), F.lit(1).cast("long").alias("n_rows"), (1 + F.col("id") * 7919 % 1000).alias("source_size"))
    got = {r.source: r.target for r in mixing.source_targets(stats.repartition(7), [3, 1, 2], 1.5, 2.0).collect()}
    sizes = {f"s{i:06d}": 1 + i * 7919 % 1000 for i in range(n)}
    assert len(got) == n and abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1
    caps = sorted((2.0 * size / (3, 1, 2)[i % 3], 2.0 * size, (3, 1, 2)[i % 3]) for i, size in enumerate(sizes.values()))
    left, weight = 1.5 * sum(sizes.values()), sum(w for *_, w in caps)
    for level, cap, w in caps:
        if left / weight <= level:
            break
        left, weight = left - cap, weight - w
    water = left / weight
    assert all(got[s] == pytest.approx(min(2.0 * size, (3, 1, 2)[i % 3] * water)) for i, (s, size) in enumerate(sizes.items()))
    assert mixing.source_targets(stats.where("false"), [3, 1, 2], 1.5, 2.0).count() == 0
