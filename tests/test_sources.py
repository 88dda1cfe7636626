"""Files in, files out: PDF entries by stand-in tools, images, the command line, streams and indented references."""

import argparse
import base64
import struct
import zlib
from decimal import Decimal

import pytest
from conftest import png
from pyspark.sql import functions as F

from bauwerk import cli
from bauwerk.operators import images, indent, layout
from bauwerk.plans import pipeline
from bauwerk.schema import POSITIONS
from bauwerk.sinks import export
from bauwerk.sinks import files as sink
from bauwerk.sources import files, pdf
from bauwerk.streaming import ingest

TEXT = "Projekt Schule\n01 Erdbau\n01.01.01.010 2,500 qm 10,00 € 25,00 €\nKurz\nlang\n01.01.01.020 1,000 m 2,00 € 2,00 €\nZulage zu Position 01.01.01.010\n01.01.01.030 1,000 m 2,00 € 2,00 €\nletzter\n"
LAYOUT = """<pdf2xml><page number="1"><fontspec id="1" family="Arial-Bold"/><text top="100" left="5" font="0">01.01.01.010 2,500 qm</text><text top="120" left="5" font="1"><b>Fetter Text</b></text>
<image top="150" left="1" width="100" height="80" src="$DIR/shot.png"/><image top="160" left="1" width="20" height="80" src="$DIR/shot.png"/></page>
<page number="x"><text top="1" left="1" font="1">01.01.01.030 fort</text></page></pdf2xml>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "good.pdf").write_text(TEXT + "%LAYOUT\n" + LAYOUT)
    (tmp_path / "bare.pdf").write_text(TEXT + "NOLAYOUT\n%LAYOUT\n")
    return tmp_path


def test_pdf_entries(spark, folder):
    raw = pipeline.raw_pdfs(spark, f"{folder}/*.pdf")
    assert sorted((r.source, r.project) for r in raw["documents"].collect()) == [("bare.pdf", "Schule"), ("good.pdf", "Schule")]
    assert raw["positions"].count() == 6
    raw.release()
    tables, layouts, shots = pipeline.parse_pdfs(spark, f"{folder}/*.pdf")
    got = {(r.doc_id.rsplit("/", 1)[-1], r.oz[-3:]): (r.short_text, r.long_text) for r in tables["positions"].collect()}
    # A priced position that refers to another one goes; bold text replaces the short one.
    assert got == {("good.pdf", "010"): ("Fetter Text", "lang"), ("good.pdf", "030"): ("letzter", ""), ("bare.pdf", "010"): ("Kurz", "lang"), ("bare.pdf", "030"): ("letzter", "NOLAYOUT")}
    told = [(r.doc_id.rsplit("/", 1)[-1], r.message) for r in tables["warnings"].collect()]
    assert told == [("bare.pdf", "Kurztext-Layout konnte nicht ausgewertet werden: pdftohtml ist fehlgeschlagen: damaged file")]
    out = {r.doc_id.rsplit("/", 1)[-1]: r for r in pipeline.export_documents(tables, ["x83"], layouts, shots)["x83"].collect()}
    assert out["good.pdf"].n_images == 1 and out["bare.pdf"].n_images == 0
    data = base64.b64encode(png(100, 80)).decode()
    assert f'<span>lang</span></p><p><image width="100" Type="image/png" Encoding="base64">{data}</image></p></Text></DetailTxt>' in out["good.pdf"].xml
    tables.release()


def test_a_broken_pdf_is_a_warning_and_stops_no_other(spark, folder):
    (folder / "bad.pdf").write_text("BROKEN")
    (row,) = pdf.read(spark, f"{folder}/bad.pdf").collect()
    assert (row.text, row.text_error, row.layout_error) == (None, "pdftotext ist fehlgeschlagen: damaged file", "pdftohtml ist fehlgeschlagen: damaged file")
    tables, layouts, _ = pipeline.parse_pdfs(spark, str(folder))
    assert sorted(r.source for r in tables["documents"].collect()) == ["bare.pdf", "good.pdf"] and layouts.count() == 1
    told = sorted((r.doc_id.rsplit("/", 1)[-1], r.stage, r.message) for r in tables["warnings"].where("stage < 4").collect())
    assert told == [("bad.pdf", 0, "PDF-Text konnte nicht gelesen werden: pdftotext ist fehlgeschlagen: damaged file"), ("bare.pdf", 3, "Kurztext-Layout konnte nicht ausgewertet werden: pdftohtml ist fehlgeschlagen: damaged file")]
    tables.release()


def test_pdf_source(spark, folder):
    for i in range(40):
        (folder / f"x{i:02}.pdf").write_text(f"Text {i}\n")
    read = pdf.read(spark, f"file:{folder}/x??.pdf", layout=False)
    assert read.rdd.getNumPartitions() == 3  # 16 files each
    assert sorted(r.text for r in read.collect()) == sorted(f"Text {i}\n" for i in range(40))
    assert spark.read.format("bauwerk_pdf").option("files", "5").load(f"{folder}/x0*.pdf").rdd.getNumPartitions() == 2
    assert pdf.read(spark, f"{folder}/none*.pdf").count() == 0
    assert {r.layout_xml for r in read.collect()} == {None}


def test_texts_layouts_and_placeholders(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("01 Erdbau\n02.06.__.010 1.621,000 qm 2,80 € 4.538,80 €\nFläche\n")
    (tmp_path / "l.xml").write_text(LAYOUT)
    texts = files.read_texts(spark, f"{tmp_path}/*.txt")
    assert [(r.source, r.text[:9]) for r in texts.collect()] == [("a b.txt", "01 Erdbau")]
    assert files.read_layouts(spark, f"{tmp_path}/l.xml").first().layout_xml == LAYOUT
    assert [(r.oz, r.short_text, r.total_price) for r in pipeline.placeholder_rows(texts).collect()] == [("02.06.00.010", "Fläche", Decimal("4538.80"))]


def test_command_line(spark, folder, monkeypatch, capsys):
    monkeypatch.setattr(spark, "stop", lambda: None)
    out = {f: folder / f"out.{f}" for f in cli.FORMATS}
    options = [x for f, p in out.items() for x in (f"--{f.replace('_', '-')}", str(p))]
    assert cli.main(["parse", str(folder / "good.pdf"), *options]) == 0
    said = capsys.readouterr().err
    assert "1 PNG-Abbildung(en) inline eingebettet." in said and "Parsing abgeschlossen." in said
    assert out["x83_priced"].read_text() == out["x84"].read_text().replace("DA84", "DA83").replace("<DP>84</DP>", "<DP>83</DP>")
    assert '"project" : "Schule"' in out["json"].read_text() and "<Kurztext>Fetter Text</Kurztext>" in out["xml"].read_text()
    (folder / "c.txt").write_text(TEXT + "01.01.01.030 1,000 m 2,00 € 2,00 €\nnoch einmal\n")
    assert cli.main(["parse", str(folder / "c.txt"), "--x83", str(folder / "c.x83")]) == 1
    assert not (folder / "c.x83").exists() and "X83-Export gesperrt: 1 Konflikt(e)" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.build_parser().parse_args(["parse"])
    assert isinstance(cli.build_parser().parse_args(["parse", "x.pdf"]), argparse.Namespace)


def test_report_without_export(spark):
    tables = pipeline.parse_documents(files.from_strings(spark, [("a", TEXT + "01.01.01.010 1,000 m 2,00 €\n")]))
    row = export.report(tables).first()
    assert (row.n_warnings, row.warnings[0], row.n_images) == (2, "Doppelte OZ: 01.01.01.010", 0)


def test_png_files():
    good = png(40, 33)
    assert images.check_png(good) == (40, 33)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = lambda *h: chunk(b"IHDR", struct.pack(">IIBBBBB", *h))
    laced = b"\x89PNG\r\n\x1a\n" + header(5, 5, 1, 3, 0, 0, 1) + chunk(b"PLTE", b"\0" * 6) + chunk(b"IDAT", zlib.compress(b"\0\0" * 11)) + chunk(b"IEND", b"")
    assert images.check_png(laced) == (5, 5)
    for bad in (good[:60], good[:-12], good[:45] + b"?" + good[46:], good[:8] + header(40, 33, 3, 0, 0, 0, 0) + good[33:], good[:8] + header(40, 34, 8, 0, 0, 0, 0) + good[33:], good[:8] + good[33:]):
        with pytest.raises(ValueError):
            images.check_png(bad)


def test_unreadable_images_are_left_out_and_told(spark):
    shown = "".join(f'<image top="{k}" left="1" width="100" height="80" src="{s}"/>' for k, s in enumerate(["a.png", "b.png", "c.jpg", "small.png", "none.png"]))
    layouts = spark.createDataFrame([("d", f'<pdf2xml><page number="1">{shown}</page></pdf2xml>')], "doc_id string, layout_xml string")
    content = [("d", "a.png", png(50, 50)), ("d", "b.png", png(50, 50)[:-20]), ("d", "c.jpg", b"\xff\xd8 no image"), ("d", "small.png", png(31, 50))]
    shots = spark.createDataFrame(content, "doc_id string, src string, content binary")
    assert [r.top for r in images.placed_images(layouts, shots).collect()] == [0]
    assert sorted(r.src for r in images.unreadable_images(layouts, shots).collect()) == ["b.png", "c.jpg"]


def test_markers_carry_to_the_next_page(spark):
    page = lambda n, body: f'<page number="{n}">{body}</page>'
    text = lambda top, oz: f'<text top="{top}" left="1" font="1">{oz} 1,000 m</text>'
    image = lambda top: f'<image top="{top}" left="1" width="100" height="80" src="s.png"/>'
    xml = "<pdf2xml>" + page(1, text(100, "01.01.01.010") + text(500, "01.01.01.020") + image(450) + image(700)) + page(2, image(50) + text(90, "01.01.01.030") + image(95)) + "</pdf2xml>"
    layouts = spark.createDataFrame([("d", xml)], "doc_id string, layout_xml string")
    placed = images.placed_images(layouts, spark.createDataFrame([("d", "s.png", png(50, 50))], "doc_id string, src string, content binary"))
    got = images.targets(images.markers(layouts), placed).orderBy("image").collect()
    assert [(r.page, r.top, r.target_oz[-3:]) for r in got] == [(1, 450, "010"), (1, 700, "020"), (2, 50, "020"), (2, 95, "030")]


def rows(spark, items):
    base = {"doc_id": "d", "leaf_oz": "01.01.01", "oz_key": [1], "short_text": "", "long_text": "", "provisional": False, "price_only": False, "page_from": 1, "page_to": 1}
    return spark.createDataFrame([base | {"seq": i} | r for i, r in enumerate(items)], POSITIONS)


def test_indented_references(spark):
    text = lambda top, left, oz: f'<text top="{top}" left="{left}" font="1">{oz} x</text>'
    xml = '<pdf2xml><page number="1">' + text(10, 40, "01.01.01.010") + text(20, 180, "01.01.01.020") + text(30, 50, "01.01.01.030") + text(40, 180, "01.01.01.040") + "</page></pdf2xml>"
    layouts = spark.createDataFrame([("d", xml)], "doc_id string, layout_xml string")
    assert [(r.oz[-3:], r.indented, r.target_oz and r.target_oz[-3:]) for r in indent.occurrences(layouts).orderBy("nth").collect()] == [("010", False, None), ("020", True, "010"), ("030", False, "010"), ("040", True, "030")]
    given = rows(spark, [
        {"oz": "01.01.01.010", "quantity": Decimal(1), "unit": "m", "short_text": "Haupt"}, {"oz": "01.01.01.020", "short_text": "gehört dazu", "page_to": 2},
        {"oz": "01.01.01.030", "quantity": Decimal(1)}, {"oz": "01.01.01.040", "quantity": Decimal(2), "short_text": "hat einen Preis"},
    ])
    got = indent.repair_indented(given, layouts).orderBy("seq").collect()
    assert [(r.oz[-3:], r.long_text, r.page_to) for r in got] == [("010", "01.01.01.020 gehört dazu", 2), ("030", "", 1), ("040", "", 1)]


def test_short_texts_leave_the_long_text(spark):
    given = rows(spark, [{"oz": "a", "short_text": "alt", "long_text": "zwei\ndrei\nRest"}, {"oz": "b", "short_text": "bleibt", "long_text": "x"}, {"oz": "a", "page_from": 2, "short_text": "andere Seite"}])
    shorts = spark.createDataFrame([("d", "a", 1, "eins\nzwei\ndrei")], "doc_id string, oz string, page int, short string")
    got = layout.apply_short_texts(given, shorts).orderBy("seq").collect()
    assert [(r.short_text, r.long_text) for r in got] == [("eins\nzwei\ndrei", "Rest"), ("bleibt", "x"), ("andere Seite", "")]


def test_stream(spark, tmp_path):
    texts, out, state = (tmp_path / n for n in ("in", "out", "state"))
    texts.mkdir()
    (texts / "a.txt").write_text(TEXT)
    ingest.ingest(spark, str(texts), str(out), str(state)).awaitTermination()
    (texts / "b.txt").write_text(TEXT)
    ingest.ingest(spark, str(texts), str(out), str(state)).awaitTermination()
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert sorted((r.source, r.batch) for r in read("documents").collect()) == [("a.txt", 0), ("b.txt", 1)]
    assert read("positions").count() == 4 and read("nodes").where(F.col("level") == 3).count() == 2


def test_released_tables_leave_no_files(spark, tmp_path):
    from pathlib import Path

    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.glob("cut-*"))
    tables = pipeline.parse_documents(files.from_strings(spark, [("a", TEXT)]))
    assert tables["positions"].count() == 2
    assert set(shared.glob("cut-*")) != before
    tables.release()
    assert set(shared.glob("cut-*")) == before


def test_many_documents_to_files(spark, tmp_path):
    n = 10_000
    docs = spark.range(n).select(F.concat(F.lit("in/"), (F.col("id") % 100).cast("string"), F.lit("/LV ä.pdf?"), "id").alias("doc_id"), F.when(F.col("id") != 7, F.concat(F.lit("<x>"), F.col("id").cast("string"), F.lit("</x>"))).alias("xml"), F.when(F.col("id") == 7, F.lit("gesperrt")).alias("blocked"))
    out = tmp_path / "out"
    sink.write_documents(docs.repartition(6), str(out), "x83", folders=1)
    found = list(out.glob("*/*.x83"))
    assert len(found) == n - 1 and {f.read_text() for f in found} == {f"<x>{i}</x>" for i in range(n) if i != 7}
    assert '"files": 9999' in (out / "_SUCCESS").read_text() and [r.reason for r in sink.blocked(docs).collect()] == ["gesperrt"]
    sink.write_documents(docs.limit(50), str(out), "x83", folders=1)  # again: the same names
    assert len(list(out.glob("*/*.x83"))) == n - 1


def test_a_failed_write_leaves_whole_files_only(spark, tmp_path):
    text = "x" * 100_000
    docs = spark.range(200).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.lit(text)).alias("xml"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        with pytest.raises(Exception, match="lost"):
            sink.write_documents(docs.coalesce(2), str(tmp_path / "out"), "xml")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files_left = list((tmp_path / "out").iterdir())
    assert not (tmp_path / "out" / "_SUCCESS").exists() and not [f for f in files_left if f.name.startswith(".")]
    assert {f.stat().st_size for f in files_left} <= {len(text)}


def test_command_line_for_a_folder(spark, folder, monkeypatch, capsys):
    monkeypatch.setattr(spark, "stop", lambda: None)
    (folder / "bad.pdf").write_text("BROKEN")
    (folder / "twice.pdf").write_text(TEXT + "01.01.01.030 1,000 m 2,00 € 2,00 €\nnoch einmal\n%LAYOUT\n" + LAYOUT)
    assert cli.main(["parse", str(folder), "--x83", str(folder / "x83"), "--json", str(folder / "json")]) == 1
    names = lambda kind: sorted(f.name[:4] for f in (folder / kind).glob(f"*.{kind}"))
    assert names("x83") == ["bare", "good"] and names("json") == ["bare", "good", "twic"]
    said = capsys.readouterr().err
    assert "1 Dokument(e) gesperrt" in said and "1 Datei(en) konnten nicht gelesen werden." in said
    assert cli.main(["parse", str(folder / "bad.pdf"), "--json", str(folder / "bad.json")]) == 1 and not (folder / "bad.json").exists()
