import random

from bauwerk.llm import jaccard

SCHEMA = "doc_id long, text string, set int, n string"


def brute(rows, percent=75):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (key is None, key or 0))
    return sorted(((key, len(sets[i]), None if least[find(i)][0] else least[find(i)][1]) for i, (key, _) in enumerate(rows)), key=str)


def check(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = jaccard.near_duplicates(docs, **more).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    return docs


def edited(rnd, words, k):
    words = list(words)
    for _ in range(k):
        words[rnd.randrange(len(words))] = f"e{rnd.random()}"
    return words


def test_groups_of_near_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_PER_ROW", 1)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, footer = [], [f"license{i}" for i in range(30)]
    for g in range(30):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 1, 2, 5, 40])):
            w = edited(rnd, base, rnd.randint(0, 4)) + (footer if rnd.random() < 0.4 else [])
            rows.append((len(rows), " ".join(w)))
    rnd.shuffle(rows)
    check(spark, rows)


def test_pivot_rounds_stay_exact(spark):
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rnd, base, rnd.randint(0, 2)))) for i in range(120)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    every, sets = jaccard.shingle_sets(docs, 5, 75, 3)
    some = {r.node: r.component for r in jaccard.link_sets(sets, 75, 3, rounds=3, worth=0).collect()}
    assert some == {r.node: r.component for r in jaccard.link_sets(sets, 75, 3, rounds=0).collect()}


def test_nulls_short_texts_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, "two one"), (7, "a b c d e"), (None, "A B C D E"), (8, "a b c d"), (9, long), (10, long + " y"), (7, "a b c d e"), (7, "quite another text of seven words"), (None, "lonely text")]
    docs = check(spark, rows)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [
        (False, 1, ""), (False, 2, ""), (False, 3, " \t\n"), (False, 4, "One t"), (False, 6, "two o"), (False, 7, "a b c"), (False, 7, "quite"), (False, 8, "a b c"), (False, 9, "x0 x1"), (True, 0, "lonel"),
    ]


def test_extra_columns_come_back_as_they_were(spark):
    docs = spark.sql("""SELECT id AS doc_id, IF(id < 40, 'same text here', concat('text number ', id)) AS text, id + 7 AS _hash, -id AS _nth, 'k' AS kept, id AS id,
        id AS hash, id * 2 AS _kept, id * 3 AS _id, map('a', id) AS row, id AS nth, 'h' AS text_hash FROM range(50)""")
    docs = docs.unionByName(docs).unionByName(docs)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id: r for r in docs.collect() if r.doc_id == 0 or r.doc_id >= 40}
    assert sorted(kept.collect(), key=lambda r: r.doc_id) == [want[i] for i in sorted(want)]


def test_sets_of_one_name_are_named_anew(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 2) * 7 + k}" for k in range(12))) for i in range(40)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    real, tried = jaccard._scan, []

    def scan(docs, buckets, size, seed):
        tried.append(seed)
        if seed:
            return real(docs, buckets, size, seed)
        made = real(docs, buckets, size, seed)
        return made.selectExpr("bucket % 1 AS bucket", "kind", "`set` % 3 AS `set`", "n", "check", "a", "b", "c", "d", "key").where("kind <> 2")

    monkeypatch.setattr(jaccard, "_scan", scan)
    got = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert tried == [0, 1] and sorted(map(tuple, got), key=str) == brute(rows)


def test_rows_outside_of_the_main_component_meet_the_others(spark):
    rnd = random.Random(21)
    families = [[f"f{k}x{i}" for i in range(50)] for k in range(6)]
    shared = [f"shared{i}" for i in range(25)]
    rows = []
    for i in range(150):
        base = families[i % 6][: rnd.choice([8, 20, 50])]
        rows.append((i, " ".join(edited(rnd, base, rnd.randint(0, 2)) + shared)))
    check(spark, rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = jaccard.near_duplicates(docs, percent=50, orders=1).groupBy("component_id").count().collect()
    assert sum(r["count"] for r in got) == 150


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_duplicates(docs).count() == 0
    assert jaccard.drop_near_duplicates(docs).count() == 0


def test_components_of_many_edges_are_those_of_few(spark, monkeypatch):
    from bauwerk.llm import shared

    rnd = random.Random(1)
    edges = spark.createDataFrame([(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)], "a long, b long")
    few = sorted(map(tuple, shared.components(edges).collect()))
    monkeypatch.setattr(shared, "ONE_TASK", 0)
    assert sorted(map(tuple, shared.components(edges).distinct().collect())) == few
