"""Command line: parse documents, write exports, report what is left to check."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from bauwerk.operators.images import unreadable_images
from bauwerk.plans import pipeline
from bauwerk.sinks import export
from bauwerk.sinks import files as sink
from bauwerk.sources import files

FORMATS = ["xml", "json", "x83", "x83_priced", "x84"]


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="bauwerk", description="Read bills of quantities into tables and exchange files")
    command = parser.add_subparsers(dest="command", required=True).add_parser("parse", help="parse a PDF or layout text file")
    command.add_argument("input", type=Path, help="a PDF or a layout text; of a folder all *.pdf, or else all *.txt, and outputs are then folders")
    for name in FORMATS:
        command.add_argument(f"--{name.replace('_', '-')}", dest=name, type=Path)
    command.add_argument("--allow-conflicts", action="store_true", help="write exports in spite of conflicts, after a check by hand")
    return parser


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Files written, warnings to stderr; 1 if an export was blocked or a file couldn't be read."""
    layouts = images = None
    many = args.input.is_dir()
    pdfs = any(args.input.glob("*.pdf")) if many else args.input.suffix.lower() == ".pdf"
    if pdfs:
        tables, layouts, images = pipeline.parse_pdfs(spark, str(args.input))
    else:
        tables = pipeline.parse_documents(files.read_texts(spark, f"{args.input}/*.txt" if many else str(args.input)))
    wanted = [f for f in FORMATS if getattr(args, f)]
    exports = pipeline.export_documents(tables, wanted, layouts, images, allow_conflicts=args.allow_conflicts)
    if many:
        return write_folders(tables, {name: (exports[name], getattr(args, name)) for name in wanted})
    blocked = 0
    for row in tables["warnings"].where("code = 'text_failed'").collect():  # one at most
        print(row["message"], file=sys.stderr)
        return 1
    for name in wanted:
        blocked |= write(exports[name], getattr(args, name), "json" if name == "json" else "xml")
    if layouts is not None and wanted:
        for row in unreadable_images(layouts, images).collect():  # a document's images
            print(f"Bild {row['src']} konnte nicht gelesen werden: {row['error']}", file=sys.stderr)
            blocked = 1
    told = export.report(tables, next((exports[n] for n in ("x84", "x83", "x83_priced") if n in exports), None)).first()
    if told:
        if told["n_images"]:
            print(f"{told['n_images']} PNG-Abbildung(en) inline eingebettet.", file=sys.stderr)
        if told["n_provisional"]:
            print(f"{told['n_provisional']} Eventualposition(en) als 'WithoutTotal' markiert.", file=sys.stderr)
        print("Parsing abgeschlossen" + (f" mit {told['n_warnings']} Warnungen." if told["n_warnings"] else "."), file=sys.stderr)
        for line in told["warnings"]:
            print(f"- {line}", file=sys.stderr)
    tables.release()
    return int(blocked)


def write_folders(tables: pipeline.Tables, exports: dict[str, tuple[DataFrame, Path]]) -> int:
    """A file a document in each format's folder, reasons of those that are blocked in _blocked beside them; 1 if there are any, or files
    that couldn't be read."""
    failed = 0
    for name, (exported, path) in exports.items():
        sink.write_documents(exported, str(path), {"xml": "xml", "json": "json"}.get(name, name.removesuffix("_priced")))
        reasons = sink.blocked(exported)
        reasons.write.mode("overwrite").json(f"{path}/_blocked")
        if n := reasons.count():
            print(f"{n} Dokument(e) gesperrt: {path}/_blocked", file=sys.stderr)
            failed = 1
    told = {r["code"]: r["count"] for r in tables["warnings"].groupBy("code").count().collect()}  # a row a kind
    if n := told.get("text_failed"):
        print(f"{n} Datei(en) konnten nicht gelesen werden.", file=sys.stderr)
        failed = 1
    print(f"Parsing abgeschlossen mit {sum(told.values())} Warnungen.", file=sys.stderr)
    tables.release()
    return failed


def write(exported: DataFrame, path: Path, column: str) -> bool:
    """One document's export to a file; true if it was blocked."""
    row = exported.first()
    if row is None or row[column] is None:
        print(row["blocked"] if row and "blocked" in row else "no document", file=sys.stderr)
        return True
    path.write_text(row[column])
    return False


def main(arguments: list[str] | None = None) -> int:
    args = build_parser().parse_args(arguments)
    spark = SparkSession.builder.appName("bauwerk").getOrCreate()
    try:
        return run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
