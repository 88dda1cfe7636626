"""Documents cut by patterns over whole pages against the tests of single lines, and steps that Spark has generated code for."""

import random

from pyspark.sql import functions as F

from bauwerk.functions import numbers as N
from bauwerk.functions import text as X
from bauwerk.operators import parse, placeholder


def test_pages_cut_as_a_whole_and_line_by_line(spark):
    rng = random.Random(5)
    lines = [
        "01.01.01.010 x", "01.01.01.010", "01.01.01.0100", "\t01.01.01.010  y ", "01 Titel", "01.01", "01.02 x", "01.02.03  y", "Summe 01.01 1,00 €", "Summe 01", "Summe 01.01.", "Summe 01.011",
        "Druckausgabe vom: 1.1. Seite 1 / 2", "Druckausgabe vom: 1/2 x", "Druckausgabe vom: ٣ / ٤", "Angebot", "Angebote", "LV", "LV 1", "Auftraggeber ", "OZ Menge / Einheit", "OZ Menge / Einheit EP GB",
        "", " ", "\r", "\x00", "\x01 1", "1", "0", "111", "01.01.__.010 p", "01.01.__.010", "01.01.__ x", "01.01.02", "٠١.٠١.٠١.٠١٠ z", "Text mehr", "a\u0085b", "Fortsetzung von vorheriger Seite", "$1\\1",
    ]
    texts = ["", "\f", "\n", "\f\f", " ", "a\n ", "a\n\r", "\r\n", "\n\f \f", "x\r\r\n01 y\r\n", None]
    texts += ["\f".join(rng.choice(["\n", "\r\n"]).join(rng.choice(lines) for _ in range(rng.choice([0, 1, 3, 12]))) + rng.choice(["", "\n"]) for _ in range(rng.choice([1, 2, 4]))) for _ in range(120)]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    kinds = {parse.MAIN: parse.kind, parse.PLACEHOLDER: placeholder.kind}
    names = ["doc_id", "parser", "seg", "head", "body", "page_end"]
    seen = lambda df: sorted(map(repr, df.select(names).collect()))
    assert seen(parse.whole_segments(frame, kinds)) == seen(parse.segments(parse.cut_pages(parse.pages(frame), kinds)))


def test_positions_are_finished_by_generated_code(spark):
    heads = spark.createDataFrame([("d", 0, 1, "01.01.01.010", "1,000 m 2,00 € 2,00 €", [(1, 0, "x")], 1, 1)], "doc_id string, parser int, seg int, oz string, rest string, body array<struct<page:int,line_no:int,line:string>>, page int, page_end int")
    plan = parse.finish(heads)._jdf.queryExecution().optimizedPlan().toString()
    steps = [x for x in plan.split("\n") if "Generate" in x]
    assert steps and not any("lambdafunction" in x for x in steps)


def test_printed_numbers_and_keys(spark):
    values = ["0.00", "1.50", "999.99", "1000.00", "12345.60", "999999.99", "1000000.00", "1234567890.12", "-1.00", "-123.45", "-1234.50", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("decimal(18,2)").alias("v"))
    got = rows.select(N.german(F.col("v")), F.translate(F.format_number(F.col("v").cast("double"), 2), ",.", ".,")).collect()
    assert all(a == b for a, b in got)
    got = spark.range(1200).select(N.padded(F.col("id"), 3), F.format_string("%03d", "id")).collect()
    assert all(a == b for a, b in got)
    keys = spark.createDataFrame([("01.2.__.x",), ("01.02.03.010",), ("1.+2",), ("",), ("9999999999999999999.1",)], "oz string").select(X.oz_key(F.col("oz")).alias("k")).collect()
    assert [r.k for r in keys] == [[1, 2, 4294967295, 4294967295], [1, 2, 3, 10], [1, 2], [4294967295], [4294967295, 1]]
