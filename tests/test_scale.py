"""Long documents, leaves and pages, and the folds and searches against plain versions of theirs."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bauwerk.functions import arrays as A
from bauwerk.functions import patterns as P
from bauwerk.functions import text as X
from bauwerk.operators import images, layout, parse, placeholder, repair, subtotals
from bauwerk.plans import pipeline
from bauwerk.schema import POSITIONS
from bauwerk.sinks import export

BASE = {"doc_id": "d", "leaf_oz": "01.01.01", "short_text": "", "long_text": "", "provisional": False, "price_only": False}


def rows(spark, items):
    return spark.createDataFrame([BASE | {"seq": i, "oz_key": [i]} | r for i, r in enumerate(items)], POSITIONS)


def fold(items):
    """The fold as one would write it: the open row with all that is glued to it."""
    kept = []
    for r in items:
        real = r.get("quantity") is not None or r["provisional"]
        text = "\n".join(x for x in (r["short_text"].strip(), r["long_text"].strip()) if x)
        low = text.lower()
        if not real and (not text or low.startswith("summe") or any(p in low for p in P.SUM_PHRASES)):
            continue
        if kept and not real:
            last = kept[-1]
            end = "\n".join(x for x in (last["short_text"].strip(), last["long_text"].strip()) if x)[-P.TAIL :].lower().rstrip()
            before = last["page_to"] if last["page_to"] is not None else last["page_from"]
            near = before is None or r["page_from"] is None or r["page_from"] <= before + 1
            if near and (any(p in end for p in P.REFERENCE_PHRASES) or any(end.endswith(e) for e in P.OPEN_ENDINGS)):
                more = " ".join(x for x in (r["oz"], text) if x)
                last["long_text"] = f"{last['long_text']}\n{more}" if last["long_text"].strip() else more
                page = r["page_to"] if r["page_to"] is not None else r["page_from"]
                last["page_to"] = max((p for p in (last["page_to"], page) if p is not None), default=None)
                continue
        kept.append(dict(r))
    return [(r["oz"], r["short_text"], r["long_text"], r["page_from"], r["page_to"]) for r in kept]


@pytest.mark.parametrize("seed", range(4))
def test_reference_fold_against_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    texts = ["", " ", "fertig", " und", "siehe Position 1", "x" * 239 + ",", "y" * 300, "Summe 1", " a sowie ", "wie in Position ", "bzw.", "z bzw.", "Ä,  "]
    items = []
    for i in range(400):
        page = rng.choice([None, i // 9, i // 9, i // 9])
        items.append(BASE | {"oz": f"o{i}", "short_text": rng.choice(texts), "long_text": rng.choice(texts), "page_from": page, "page_to": rng.choice([None, page, None if page is None else page + 1]), "provisional": rng.random() < 0.1, "quantity": Decimal(1) if rng.random() < 0.2 else None})
    got = repair.fold_references(rows(spark, items)).orderBy("seq").collect()
    assert [(r.oz, r.short_text, r.long_text, r.page_from, r.page_to) for r in got] == fold(items)


def test_a_leaf_of_100000_rows(spark):
    n = 100_000
    real = F.col("id") % 1000 == 0
    made = spark.range(n).select(
        F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("seq"), F.col("id").cast("string").alias("oz"), F.lit("l").alias("leaf_oz"), F.array("id").alias("oz_key"), F.when(real, F.lit(1)).cast("decimal(18,3)").alias("quantity"),
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("decimal(18,2)").alias("unit_price"), F.lit(None).cast("decimal(18,2)").alias("total_price"), F.lit("weiter und").alias("short_text"), F.lit("").alias("long_text"),
        F.lit(1).alias("page_from"), F.lit(1).alias("page_to"), F.lit(False).alias("provisional"), F.lit(False).alias("price_only"),
    )
    got = repair.fold_references(made).select("seq", F.size(F.split("long_text", "\n")).alias("n")).collect()
    assert len(got) == n // 1000 and {r.n for r in got} == {999}


def test_lines_of_a_page_with_100000_fragments(spark):
    n = 100_000
    item = F.struct((F.col("id") / 2).cast("int").alias("top"), F.col("id").cast("int").alias("left"), F.col("id").cast("int").alias("seq"), (F.col("id") % 100 == 0).alias("bold"), F.col("id").cast("string").alias("text"))
    page = spark.range(n).groupBy(F.lit("d").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    (got,) = layout.group_lines(page).collect()
    # Tops rise by one every two fragments: a line takes three tops.
    assert len(got.lines) == -(-n // 6) and got.lines[1].text == "6 7 8 9 10 11" and [x.bold for x in got.lines[:2]] == [True, False]


def test_openings_keep_their_state(spark):
    # A run opens where the sum of the run so far would go over 10.
    values = [random.Random(7).randint(0, 9) for _ in range(1_000)]
    expected, total = [], 0
    for i, v in enumerate(values, 1):
        opened = i == 1 or total + v > 10
        expected += [i] * opened
        total = v if opened else total + v
    frame = spark.createDataFrame([(values,), ([],)], "v array<int>")
    got = frame.select(A.openings(F.col("v"), F.lit(0), lambda s, x: s + x > 10, lambda s, x, o: F.when(o, x).otherwise(s + x)).alias("o")).collect()
    assert [r.o for r in got] == [expected, []]


def test_subsets_against_all_masks(spark):
    rng = random.Random(3)
    leaves = []
    for n in [1, 2, 7, 8, 9, 12, 15, 16, 16, 17, 17, 30]:
        for planted in (True, False):
            found = [(i, f"o{i}", Decimal(rng.choice([rng.randint(-300, 900), 500])) / 100, rng.random() < 0.4) for i in range(n)]
            members = [f for f in found if rng.random() < 0.4] or found[:1] if n <= 16 else found[:1]
            leaves.append((len(leaves), found, sum((f[2] for f in members), Decimal(0)) + (0 if planted else Decimal("0.017").quantize(Decimal("0.01")) * 37)))

    def best(found, required):
        fits = lambda ms: abs(sum(found[i][2] for i in ms) - required) <= Decimal("0.02")
        if len(found) > 16:
            one = [i for i in range(len(found)) if fits([i])]
            return one if len(one) == 1 else None
        cents, need, top = [int(f[2] * 100) for f in found], int(required * 100), None
        sums, gbs = [0], [0]
        for c, f in zip(cents, found):
            sums += [s + c for s in sums]
            gbs += [g + f[3] for g in gbs]
        for mask in range(1, len(sums)):
            if abs(sums[mask] - need) <= 2:
                key = (-gbs[mask], mask.bit_count(), mask)
                top = min(top or key, key)
        return [i for i in range(len(found)) if top[2] >> i & 1] if top else None

    frame = spark.createDataFrame([(i, found, required, True) for i, found, required in leaves], "i int, found array<struct<seq int, oz string, value decimal(18,2), gb boolean>>, required decimal(38,2), w boolean")
    got = {r.i: r.chosen for r in subtotals.with_matching_subset(frame, F.col("w")).collect()}
    assert got == {i: best(found, required) for i, found, required in leaves}


def test_images_over_100000_pages(spark):
    rng = random.Random(5)
    refs = [(f"d{rng.randint(0, 1)}", i, f"o{i}", rng.choice([1, rng.randint(1, 100_000)]), rng.choice([None, 3, rng.randint(1, 100_000), 99_999])) for i in range(60)]
    shots = [(f"d{rng.randint(0, 2)}", rng.randint(0, 100_001), 0, 1, "x", rng.choice([None, "other"]), i) for i in range(300)]
    expected = {}
    for d, page, _, _, _, _, image in shots:
        spans = [(max(b if b is not None else a, a) - a, -a, seq) for dd, seq, _, a, b in refs if dd == d and a <= page <= max(b if b is not None else a, a)]
        if spans:
            expected[image] = min(spans)[2]
    got = images.assign(
        spark.createDataFrame(shots, "doc_id string, page int, top int, width int, data string, target_oz string, image int"),
        spark.createDataFrame(refs, "doc_id string, seq int, oz string, page_from int, page_to int"),
    ).collect()
    assert {r.image: r.seq for r in got} == expected and len(got) == len(expected)


def plain_segments(text, kind):
    out, head, body, seg = [], None, [], 0
    for page, part in enumerate(text.split("\f"), 1):
        lines = part.split("\n")
        for no, raw in enumerate(lines[:-1] if lines[-1] == "" else lines):
            line = re.sub(r"\s+", " ", raw).strip()
            what = kind(line)
            if what == "noise":
                continue
            if what == "text":
                body.append((page, no, line))
                continue
            if head or body:
                out.append((seg, head and head[3], body, page))
            seg, head, body = seg + 1, (page, no, what, line), []
    return out, (seg, head and head[3], body)


def main_kind(line):
    if line == "" or line.startswith("Angebot"):
        return "noise"
    return "position" if re.match(r"\d\d\.\d\d\.\d\d\.\d{3}(\s|$)", line) else "heading" if re.match(r"\d\d(\.\d\d){0,2}\s+\S", line) else "text"


@pytest.mark.parametrize("seed", range(3))
def test_segments_against_one_walk(spark, seed):
    rng = random.Random(seed)
    texts = ["", "\f\f", "Angebot\n\f x \n"]
    for _ in range(20):
        kinds = ["01.01.01.010 x", "01 Titel", "Angebot", "", "Text", "mehr Text"]
        texts.append("\f".join("\n".join(rng.choice(kinds) for _ in range(rng.choice([0, 1, 3, 9]))) for _ in range(rng.choice([1, 2, 5]))))
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    cut = parse.segments(parse.cut_pages(parse.pages(frame), {parse.MAIN: parse.kind, parse.PLACEHOLDER: placeholder.kind})).where(F.col("parser") == parse.MAIN)
    got = {}
    for r in cut.collect():
        got.setdefault(r.doc_id, []).append((r.seg, r.head and r.head.line, [tuple(b) for b in r.body], r.page_end))
    for i, text in enumerate(texts):
        done, last = plain_segments(text, main_kind)
        ends = [p for p, part in enumerate(text.split("\f"), 1) if part.strip()]
        expected = done + ([(*last, max(ends, default=1))] if last[1] or last[2] else [])
        assert sorted(got.get(str(i), [])) == sorted(expected), i


def test_a_document_of_a_million_lines(spark):
    """Its pages are cut in many tasks, and segments that run over pages are whole."""
    pages, per_page = 20_000, 50
    page = "\n".join(["weiter"] * 9 + ["01.01.01.010 1,000 m 2,00 € 2,00 €"] + ["Text"] * 40)
    frame = spark.range(1).select(F.lit("d").alias("doc_id"), F.concat_ws("\f", F.transform(F.sequence(F.lit(1), F.lit(pages)), lambda _: F.lit(page))).alias("text"))
    read = parse.pages(frame)
    spread = read.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("lines")).alias("n")).collect()
    assert len(spread) > 1 and sum(r.n for r in spread) == pages * per_page and max(r.n for r in spread) < pages * per_page / 2
    cut = parse.segments(parse.cut_pages(read, {parse.MAIN: parse.kind}))
    got = cut.groupBy(F.size("body").alias("n"), (F.col("page_end") - F.col("head.page")).alias("over")).count().collect()
    assert {(r.n, r.over): r["count"] for r in got} == {(9, None): 1, (49, 1): pages - 1, (40, 0): 1}


def test_images_ask_for_few_bins(spark):
    # Asking for bins of all 31 sizes would make 31 rows of each image, in a table that Spark takes for small and sends to every task.
    refs = spark.createDataFrame([("d", 1, "o", 1, 3)], "doc_id string, seq int, oz string, page_from int, page_to int")
    shots = spark.createDataFrame([("d", k) for k in range(4)], "doc_id string, page int")
    got = images._covered(shots, refs.selectExpr("doc_id", "page_from AS a", "page_to AS b"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [r.page for r in got.orderBy("page").collect()] == [1, 2, 3] and "Broadcast" not in plan


@pytest.mark.parametrize("whole", [0, 60, 10**6])
def test_documents_cut_in_their_rows_are_cut_as_pages_are(spark, monkeypatch, whole):
    rng = random.Random(11)
    parts = ["01.01.01.010 1,000 m 2,00 €", "01.01.__.020 x", "01.01 Titel", "Summe 01.01 1,00 €", "Angebot", "", " ", " text  b", "\f", "\f", "\n", "\r\n", "\n"]
    texts = [(f"d{k}", "s", "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(80)] + [("null", "s", None), ("empty", "s", ""), ("pages", "s", "\f\f\n")]
    frame = spark.createDataFrame(texts, "doc_id string, source string, text string")
    kinds = {parse.MAIN: parse.kind, parse.PLACEHOLDER: placeholder.kind}
    monkeypatch.setattr(parse, "WHOLE", whole)
    seen = lambda rows: sorted(map(repr, rows.collect()))
    names = ["doc_id", "parser", "seg", "head", "body", "page_end"]
    assert seen(parse.all_segments(frame, kinds).select(names)) == seen(parse.segments(parse.cut_pages(parse.pages(frame), kinds)).select(names))
    names = ["doc_id", "page", "line_no", "raw", "line"]
    assert seen(parse.all_lines(frame).select(names)) == seen(parse.lines(frame).select(names))


def test_positions_of_short_documents_need_no_shuffle(spark):
    frame = spark.createDataFrame([("d", "s", "01.01.01.010 1,000 m 2,00 €\n")], "doc_id string, source string, text string")
    found = parse.read_positions(parse.whole_segments(frame, {parse.MAIN: parse.kind}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and found.count() == 1


def test_stages_keep_no_rows_uncompressed(spark):
    frame = spark.createDataFrame([("d", "s", "01.01.01.010 1,000 m 2,00 €\n")], "doc_id string, source string, text string")
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, tables = kept(), pipeline.parse_documents(frame)
    assert [tables[name].count() for name in ("documents", "positions", "nodes", "warnings")] == [1, 1, 3, 1] and kept() == before
    tables.release()


def test_sums_of_levels_need_one_row_an_item(spark):
    # A rollup makes five rows of each position before they are summed up.
    items = [BASE | {"doc_id": d, "seq": k, "oz_key": [k], "oz": f"0{k % 2}.0{k % 3}.01.{k:03d}", "total_price": Decimal(k)} for d in ("a", "b") for k in range(7)]
    frame = spark.createDataFrame(items, POSITIONS)
    got = subtotals.subtotal_report(frame)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    plain = frame.selectExpr("doc_id", "substr(oz, 1, 2) AS oz1", "substr(oz, 1, 5) AS oz2", "substr(oz, 1, 8) AS oz3", "total_price").rollup("doc_id", "oz1", "oz2", "oz3").agg(F.sum("total_price").alias("total"), F.count("*").alias("n"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) and got.dtypes == plain.dtypes
    assert subtotals.subtotal_report(frame.limit(0)).count() == 0


def _two_documents(spark):
    text = "Vorwort\n01 Bereich eins\n01.01 Titel\n01.01.01.010 1,000 m 2,00 € 2,00 €\n  Kurz\nLang\n01.01.01.020 1,000 m 2,00 € 2,00 €\n  Kurz\nSumme 01.01.01 Titel 4,00 €\n"
    return spark.createDataFrame([("a", "a.pdf", text), ("b", "b.pdf", text)], "doc_id string, source string, text string")


def test_read_positions_leave_no_second_copy_of_their_texts(spark):
    tables = pipeline.parse_documents(_two_documents(spark))
    assert tables["positions"].count() == 4
    assert tables["segments"].where("head.kind = 'position' AND size(body) > 0").count() == 0
    assert {r.preamble for r in tables["documents"].collect()} == {"Vorwort"}
    assert {(r.oz, r.title) for r in tables["nodes"].collect()} == {("01", "Bereich eins"), ("01.01", "Titel"), ("01.01.01", "")}
    tables.release()


def test_exports_meet_by_document_only(spark):
    read = pipeline.parse_text(_two_documents(spark), placeholders=False)
    tables = {name: read[name].localCheckpoint() for name in ("nodes", "positions", "documents")}
    made = export.exchange_xml(tables, "84", True, F.lit("2024-01-02 03:04:05").cast("timestamp"), allow_conflicts=True)
    assert made._jdf.queryExecution().sparkPlan().toString().count("Join") <= 2  # a join a level and two for ids, before
    xml = made.collect()[0].xml
    assert [xml.count(x) for x in ("<BoQCtgy ", "</BoQCtgy>", "<Itemlist>", "</Itemlist>", "<Item ", "</Item>")] == [3, 3, 1, 1, 2, 2]


def test_an_amount_of_nothing_fits_beside_an_empty_half(spark):
    found = [(i, str(i), Decimal(v), False) for i, v in enumerate(["0.00"] + ["5.00"] * 9)]
    leaf = spark.createDataFrame([(found, Decimal("0.00"))], "found array<struct<seq: int, oz: string, value: decimal(18,2), gb: boolean>>, required decimal(38,2)")
    assert subtotals.with_matching_subset(leaf, F.lit(True)).collect()[0].chosen == [0]


def test_text_tests_as_before_they_were_one_pattern_each(spark):
    lines = ["  Zulage zur Pos. 4", " BEZUG AUF POSITION", "x Zulage zu Position", " 1.000,00 Stk", "Stk 1,00 x", "\t Summe", "eine Titel Summe", "keine summe"]
    told = spark.createDataFrame([(x,) for x in lines], "x string").select(*[f(F.col("x")) for f in (X.is_reference_text, X.is_price_line, X.is_sum_artifact)]).collect()
    assert [[i for i, r in enumerate(told) if r[k]] for k in range(3)] == [[0, 1], [3], [5, 6]]
    row = spark.range(1).select(*[X.attribute(F.lit(a), "top") for a in ("x top=\"top=\" top='2'", "top=\"1", "left='3' top='4'", "left=1")], subtotals.last_amount_offset(F.lit("ä € 10,00 € x 2,00 EUR")), subtotals.last_amount_offset(F.lit("ä")))
    assert list(row.collect()[0]) == ["top=", None, "4", None, 19, -1]


def test_layout_lines_are_read_by_one_pattern(spark):
    plan = layout.bold_short_texts(spark.createDataFrame([("d", "")], "doc_id string, layout_xml string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 1  # one for lines of fragments; the scan of each position's lines was another
