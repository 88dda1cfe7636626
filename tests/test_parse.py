"""The parser's cases and what is easy to get wrong, each with texts of our own."""

import pytest

from bauwerk.operators import layout, placeholder, repair
from bauwerk.plans import pipeline
from bauwerk.schema import POSITIONS
from bauwerk.sources import files

TEXTS = {
    "one_line": "Auftraggeber Stadt Köln\nBieter  Bau AG\nProjekt Schule\nVorwort\n01 Erdbau\n01.01 Aushub\n01.01.02 Boden 1.234,50 €\n01.01.02.030 361,000 qm 3,50 € 1.263,50 €\nBoden lösen\nund laden\n",
    "omitted": "01.01.01.010 Position entfällt\n",
    "spread": "01.01.01.010\n12,000 Stk\n10,00 €\n120,00 €\nTür\nliefern\n",
    "pages": "01.01.01.010 1,000 m 2,00 € 2,00 €\nAnfang\nFortsetzung auf nächster Seite\n\fFortsetzung von vorheriger Seite\nEnde\n01.01.01.020 1,000 m 2,00 € Nur Einh.-Pr.\nWeiter\n",
    "unused": "07 Ohne Position\n01.01.01.010 1,000 m 2,00 € 2,00 €\n",
    "last_heading": "01 Alt\n01.01.01.010 1,000 m 2,00 € 2,00 €\n\f01 Neu\n01.01.01.020 1,000 m 2,00 € 2,00 €\n",
    "placeholder": "02 Rohbau\n02.06 Sonstiges\n02.06.__.010 1.621,000 qm 2,80 € 4.538,80 €\nFläche\nSumme 02.06 Sonstiges 4.538,80 €\n02.06.01.010 1,000 m 2,00 € 2,00 €\n",
    "duplicates": "01.01.01.010 1,000 m 2,00 € 2,00 €\n01.01.01.010 3,000 m 2,00 € 9,00 €\n",
    "optional": "01.01.01 Los\n01.01.01.010 1,000 m 10,00 € 10,00 €\na\n01.01.01.020 2,000 m 5,00 € Nur Einh.-Pr.\nb\nSumme 01.01.01 Los 20,00 €\n",
    "empty": "",
}


@pytest.fixture(scope="module")
def parsed(spark):
    texts = files.from_strings(spark, list(TEXTS.items()))
    raw, done = pipeline.parse_text(texts), pipeline.parse_documents(texts)
    names = {f"{i:06d}": n for i, n in enumerate(TEXTS)}
    pick = lambda tables: {t: by(tables[t].collect(), names) for t in ("documents", "nodes", "positions", "warnings")}
    return pick(raw), pick(done)


def by(rows, names):
    out = {n: [] for n in names.values()}
    for r in rows:
        out[names[r.doc_id]].append(r)
    for n in out:
        out[n].sort(key=lambda r: (getattr(r, "seq", None) or 0, getattr(r, "oz", None) or "", getattr(r, "message", "")))
    return out


def test_one_line_price_metadata_and_titles(parsed):
    raw, done = parsed
    p = raw["positions"]["one_line"][0]
    assert (p.oz, str(p.quantity), p.unit, str(p.unit_price), str(p.total_price)) == ("01.01.02.030", "361.000", "qm", "3.50", "1263.50")
    assert (p.short_text, p.long_text) == ("Boden lösen", "und laden")
    d = raw["documents"]["one_line"][0]
    assert (d.client, d.bidder, d.project, d.preamble, d.currency) == ("Stadt Köln", "Bau AG", "Schule", "Vorwort", "EUR")
    assert [(n.oz, n.level, n.title) for n in done["nodes"]["one_line"]] == [("01", 1, "Erdbau"), ("01.01", 2, "Aushub"), ("01.01.02", 3, "Boden")]
    assert raw["nodes"]["one_line"][2].title == "Boden 1.234,50 €"


def test_omitted_and_spread(parsed):
    raw, _ = parsed
    assert raw["positions"]["omitted"][0].short_text == "Position entfällt" and raw["warnings"]["omitted"] == []
    p = raw["positions"]["spread"][0]
    assert (str(p.quantity), p.unit, str(p.total_price), p.short_text, p.long_text) == ("12.000", "Stk", "120.00", "Tür", "liefern")


def test_pages(parsed):
    first, second = parsed[0]["positions"]["pages"]
    assert (first.page_from, first.page_to, first.short_text, first.long_text) == (1, 2, "Anfang", "Ende")
    assert second.provisional and second.price_only and second.total_price is None


def test_headings(parsed):
    raw, _ = parsed
    assert [n.oz for n in raw["nodes"]["unused"]] == ["01", "01.01", "01.01.01"]
    assert (raw["nodes"]["last_heading"][0].title, raw["nodes"]["last_heading"][0].page) == ("Neu", 2)


def test_placeholders_come_first_and_keep_their_text(parsed):
    _, done = parsed
    assert [(p.oz, p.short_text) for p in done["positions"]["placeholder"]] == [("02.06.00.010", "Fläche"), ("02.06.01.010", "")]
    assert [n.oz for n in sorted(done["nodes"]["placeholder"], key=lambda n: n.oz_key)] == ["02", "02.06", "02.06.00", "02.06.01"]


def test_warnings(parsed):
    raw, done = parsed
    assert [w.code for w in raw["warnings"]["duplicates"]] == ["dup_oz", "deviation"]
    assert [w.message for w in done["warnings"]["duplicates"]] == ["Doppelte OZ: 01.01.01.010", "Preis korrigiert: 01.01.01.010 – GP 9 wurde aus Menge × EP als 6 neu berechnet"]
    assert done["positions"]["empty"] == [] and len(done["documents"]["empty"]) == 1


def test_optional_position_that_the_subtotal_contains(parsed):
    _, done = parsed
    p = done["positions"]["optional"][1]
    assert (p.price_only, p.provisional, str(p.total_price)) == (False, False, "10.00")
    assert [w.code for w in done["warnings"]["optional"]] == ["prov_fixed"]


def rows(spark, items):
    base = {"doc_id": "d", "leaf_oz": "01.01.01", "oz_key": [1], "short_text": "", "long_text": "", "provisional": False, "price_only": False}
    return spark.createDataFrame([base | {"seq": i} | r for i, r in enumerate(items)], POSITIONS)


def test_reference_fold(spark):
    from decimal import Decimal

    kept = repair.fold_references(rows(spark, [
        {"oz": "a", "quantity": Decimal(1), "long_text": "wie bereits in Position", "page_from": 1, "page_to": 1},
        {"oz": "b", "short_text": "beschrieben und", "page_from": 2, "page_to": 3},
        {"oz": "c", "short_text": "fertig", "page_from": 4, "page_to": 4},
        {"oz": "d", "short_text": "Untertitelsumme", "page_from": 4},
        {"oz": "e", "page_from": 4},
        {"oz": "f", "short_text": "weit weg", "page_from": 9, "page_to": 9},
        {"oz": "g", "short_text": "POSITION ENTFäLLT".replace("ä", "ä"), "page_from": 9},
    ])).orderBy("seq").collect()
    assert [r.oz for r in kept] == ["a", "f", "g"]
    assert (kept[0].long_text, kept[0].page_to) == ("wie bereits in Position\nb beschrieben und\nc fertig", 4)


def test_bold_short_texts(spark):
    page = lambda *t: '<pdf2xml><fontspec id="1" family="Arial-BoldMT"/><fontspec id="2" family="Arial"/><page number="1">' + "".join(f'<text top="{a}" left="{b}" font="{f}">{x}</text>' for a, b, f, x in t) + "</page></pdf2xml>"
    xml = page((10, 1, 2, "01.01.01.010 1,000 m"), (30, 1, 1, "<b>Tür &amp; Tor</b>"), (31, 50, 1, "neu"), (50, 1, 1, "zwei"), (70, 1, 2, "normal"), (90, 1, 1, "fett"))
    got = layout.bold_short_texts(spark.createDataFrame([("d", xml)], "doc_id string, layout_xml string")).collect()
    assert [(r.oz, r.page, r.short) for r in got] == [("01.01.01.010", 1, "Tür & Tor neu\nzwei")]


def test_oz_order(spark):
    got = placeholder.sort_positions(rows(spark, [{"oz": o, "oz_key": k} for o, k in (("01", [1]), ("00", [0]), ("x", [4294967295]), ("02", [2]))])).orderBy("seq")
    assert [r.oz for r in got.collect()] == ["00", "01", "02", "x"]
