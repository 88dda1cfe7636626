from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bauwerk.functions import numbers as N
from bauwerk.functions import text as X
from bauwerk.operators import subtotals
from bauwerk.plans import pipeline
from bauwerk.sources import files

TEXT = "Projekt Schule\nVorwort & mehr\n01 Erdbau\n01.01 Aushub\n01.01.01 Boden 12,00 €\n01.01.01.010 2,500 qm 10,00 € 25,00 €\nKurz <1>\nlang\n01.01.01.020 1,000 m 2,00 € Nur Einh.-Pr.\nnur so\n"


@pytest.fixture(scope="module")
def exports(spark):
    tables = pipeline.parse_documents(files.from_strings(spark, [("a.pdf", TEXT), ("b.pdf", TEXT + "01.01.01.010 ohne Preis\n")]))
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    out = pipeline.export_documents(tables, ["json", "xml", "x83", "x84", "x83_priced"], now=now)
    return {k: {r.doc_id: r for r in v.collect()} for k, v in out.items()}


def test_exchange_formats(exports):
    x83, x84, priced = (exports[k]["000000"].xml for k in ("x83", "x84", "x83_priced"))
    assert "DA83/3.3" in x83 and "<DP>83</DP>" in x83 and "<UP>" not in x83
    assert '<Item ID="id00000005" RNoPart="010"><Qty>2.5</Qty><QU>qm</QU><Description>' in x83
    assert "<Provis>WithoutTotal</Provis><LumpSumItem>Yes</LumpSumItem><Qty>1</Qty>" in x83
    assert "<Qty>2.5</Qty><QU>qm</QU><UP>10</UP><IT>25</IT>" in x84 and "<DP>84</DP>" in x84
    assert priced == x84.replace("DA84", "DA83").replace("<DP>84</DP>", "<DP>83</DP>")
    assert "<span>Kurz &lt;1&gt;</span>" in x83 and "<span>Boden</span>" in x83


def test_gate(exports):
    row = exports["x83"]["000001"]
    assert row.xml is None and row.blocked.startswith("X83-Export gesperrt: ") and "- Doppelte OZ: 01.01.01.010" in row.blocked
    assert exports["x84"]["000001"].blocked.startswith("X84-Export gesperrt: ")


def test_json_and_master(exports):
    import json

    tree = json.loads(exports["json"]["000000"].json)
    assert tree["roots"][0]["children"][0]["children"][0]["positions"][0]["quantity"] == "2.500"
    assert tree["roots"][0]["children"][0]["children"][0]["positions"][1]["total_price"] is None
    xml = exports["xml"]["000000"].xml
    assert '<Bereich oz="01" seite="1"><Bezeichnung>Erdbau</Bezeichnung><Titel oz="01.01"' in xml
    assert '<Menge einheit="qm">2.500</Menge><Preise waehrung="EUR"><Einheitspreis>10.00</Einheitspreis>' in xml


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers_and_texts(spark):
    assert value(spark, N.german_decimal(F.lit("1.263,50"))) == Decimal("1263.50")
    assert value(spark, N.german_decimal(F.lit("x"))) is None
    assert value(spark, N.money(F.lit("2.345").cast("decimal(5,3)"))) == Decimal("2.34")
    assert [value(spark, N.plain(F.lit(x).cast("decimal(9,2)"))) for x in ("100", "1.50", "0")] == ["100", "1.5", "0"]
    assert value(spark, X.clean_title(F.lit("Los 2024 Summe 1.000,00 € 2,00"))) == "Los 2024"
    assert value(spark, X.unescape(F.lit("a &#228; &#x20AC; &lt;"))) == "a ä € <"
    assert value(spark, X.unescape(F.lit("a & b &lt;"))) == "a & b &lt;"
    assert value(spark, subtotals.amount_offsets(F.lit("ä € 10,00 € x 2,00 EUR"))) == [7, 19]


def test_subsets(spark):
    def pick(values, gb, need):
        rows = [(i, [(v, g) for v, g in zip(map(Decimal, values), gb)], Decimal(need)) for i in (0, 1)]
        leaves = spark.createDataFrame(rows, "i int, found array<struct<value: decimal(38,2), gb: boolean>>, required decimal(38,2)")
        chosen = {r.i: r.chosen for r in subtotals.with_matching_subset(leaves, F.col("i") == 0).collect()}
        assert chosen[1] is None
        return chosen[0]

    assert pick(["5", "3", "2"], [False] * 3, "5") == [0]
    assert pick(["5", "3", "2"], [False, True, True], "5") == [1, 2]
    assert pick(["5"], [False], "4") is None
    assert pick(["1"] * 16 + ["9"], [False] * 17, "9") == [16]
    assert pick(["1"] * 17, [False] * 17, "1") is None
