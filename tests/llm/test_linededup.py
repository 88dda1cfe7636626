from bauwerk.llm import linededup

SCHEMA = "doc_id long, text string, starts string, _lines int"


def brute(rows, size=3):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for doc_id, text in order:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        lines = text.split("\n")
        bare = [x.strip(" \t\r\x0b\x0c") for x in lines]
        gone = set()
        for i in range(len(lines) - size + 1):
            w = tuple(bare[i : i + size])
            if any(w) and seen.setdefault(w, (doc_id, text, i)) != (doc_id, text, i):
                gone |= set(range(i, i + size))
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], key=str)


def test_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    passages = [[f"p{k} line {i}" for i in range(2 + k)] for k in range(5)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            lines += rnd.choice([rnd.choice(passages), [f"own {i} {rnd.random()}"], [""], ["  ", ""], ["same"] * 4])
        rows.append((i, "\n".join(lines)))
    rows += [(900, "\n".join(f"l{i}" for i in range(20000))), (901, "\n".join(f"l{i}" for i in range(5, 20005)))]
    assert check(spark, rows) == brute(rows)


def test_nulls_short_texts_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb\nc "), (None, "x\na\nb\n c\ty"), (5, "a\nb\nc"), (4, "a\nb\nc ")]
    got = check(spark, rows)
    assert got == sorted(
        [(1, None, 0, 0), (2, "", 1, 0), (3, "a\nb", 2, 0), (4, "a\nb\nc ", 3, 0), (4, "a\nb\nc ", 3, 0), (5, "", 3, 3), (None, "x\na\nb\n c\ty", 4, 0)],
        key=str,
    )


def test_empty_table(spark):
    assert check(spark, [] or [(1, "a")]) == [(1, "a", 1, 0)]
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns_come_back_as_they_were(spark):
    names = ["row", "d1", "d2", "f1", "f2", "starts", "lines", "gone", "edges", "_lines", "_gone", "_starts", "h", "g", "ls"]
    extra = ", ".join(f"id * 10 + {i} AS {x}" for i, x in enumerate(names))
    docs = spark.sql(f"SELECT id AS doc_id, concat_ws('\\n', 'a', 'b', 'c', id) AS text, map('a', id) AS m, {extra} FROM range(20)")
    got = linededup.dedup_lines(docs).orderBy("doc_id").collect()
    want = docs.orderBy("doc_id").collect()
    for a, b in zip(got, want):
        assert a.text == (b.text if b.doc_id == 0 else str(b.doc_id))
        assert all(a[x] == b[x] for x in docs.columns if x != "text")
