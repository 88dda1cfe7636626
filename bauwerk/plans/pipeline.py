"""The stages in their order: texts to tables, tables to exports."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import cache

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bauwerk.operators import images, layout, parse, placeholder, repair, subtotals
from bauwerk.schema import message
from bauwerk.sinks import export
from bauwerk.sources import pdf


class Tables(dict):
    """Tables by name. What was kept or written on the way to them stays until release(), so call it once all results are
    written. A table given as a function is made when it is first asked for."""

    def __init__(self, tables: dict, owned: list | None = None):
        super().__init__(tables)
        self.owned = [] if owned is None else owned

    def __or__(self, more: dict) -> Tables:
        return Tables(dict(dict.items(self), **more), self.owned)

    def __getitem__(self, name: str) -> DataFrame:
        table = super().__getitem__(name)
        if not isinstance(table, DataFrame):
            table = self[name] = table()
        return table

    def items(self):
        return [(name, self[name]) for name in self]

    def values(self):
        return [self[name] for name in self]

    def cut(self, made: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        """The end of a lineage: written to the shared folder that the session names, so that plans that go on from here are
        small."""

        def write() -> DataFrame:
            df = made()
            spark = df.sparkSession
            path = f"{_shared_dir(spark)}/cut-{uuid.uuid4().hex}"
            with _shuffles_removed(spark):
                df.write.parquet(path)
            _written[path] = spark
            self.owned.append(lambda: _delete(path))
            return spark.read.schema(df.schema).parquet(path)

        return cache(write)

    def release(self) -> None:
        """Forget kept tables and remove written ones. The tables can't be read any more."""
        while self.owned:
            self.owned.pop()()


def _shared_dir(spark) -> str:
    """The folder in spark.checkpoint.dir; one of its own where that is unset, which only a local master can share."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="bauwerk-")
        context.setCheckpointDir(found)
    return found


@contextmanager
def _shuffles_removed(spark):
    """What runs within removes its shuffle files at its end, instead of when the driver's collector finds them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Written tables that nobody released yet, and their sessions.
_written: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    else:  # the session is closed: what isn't a local folder stays
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


@atexit.register
def release_all() -> None:
    """Remove all written tables, whoever owns them."""
    for path in list(_written):
        _delete(path)


def parse_text(texts: DataFrame, placeholders: bool = True) -> Tables:
    """Tables of the raw parser, in order of appearance and uncleaned. texts: (doc_id, source, text). placeholders: read positions of
    placeholder levels on the way, which recover_placeholders() asks for. Each table's plan is made when the table is asked for."""
    out = Tables({})
    # Tables that several others are made from are written: compressed, and read by columns, they take a fraction of what kept rows do.
    read = out.cut(lambda: texts.select("doc_id", "source", "text"))
    kinds = {parse.MAIN: parse.kind} | ({parse.PLACEHOLDER: placeholder.kind} if placeholders else {})
    cut = cache(lambda: parse.all_segments(read(), kinds))
    found = cache(lambda: parse.read_positions(cut()))
    if placeholders:  # one table with what is read of either kind
        both = out.cut(lambda: parse.read_all(parse.all_segments(read(), kinds), {parse.MAIN: parse.loose_lines, parse.PLACEHOLDER: placeholder.loose_lines}))
        cut = cache(lambda: both().select("doc_id", "parser", "head", "body"))
        found = cache(lambda: both().where("oz IS NOT NULL").drop("head", "body"))
    main = cache(lambda: parse.positions(found()))
    rows = cache(lambda: parse.all_lines(read()))
    headings = cache(lambda: parse.headings(cut()))
    return out | {
        "documents": cache(lambda: parse.documents(read(), rows(), cut())),
        "headings": headings,
        "nodes": cache(lambda: parse.hierarchy(main(), headings())),
        "positions": main,
        "warnings": cache(lambda: parse.first_warnings(main())),
        "lines": rows,
    } | ({"segments": cut, "found": found} if placeholders else {})


def recover_placeholders(tables: Tables) -> Tables:
    """Adds positions of placeholder levels and sorts all by numeric OZ. tables: parse_text() with placeholders."""
    merged = cache(lambda: placeholder.merge_positions(tables["positions"], placeholder.recovered(tables["found"])))

    def nodes() -> DataFrame:
        count = tables["positions"].groupBy("doc_id").agg(F.count("*").alias("n"))
        return placeholder.merge_nodes(tables["nodes"], merged(), placeholder.placeholder_headings(tables["segments"]), count)

    return tables | {"positions": cache(lambda: placeholder.sort_positions(merged())), "nodes": cache(nodes)}


def repair_references(tables: Tables) -> Tables:
    """Split references glued. Each table is written when it is first asked for."""
    folded = tables.cut(lambda: repair.fold_references(tables["positions"]))
    return tables | {
        "positions": folded,
        "nodes": tables.cut(lambda: tables["nodes"]),
        "warnings": tables.cut(lambda: repair.refresh_warnings(tables["warnings"], folded())),
        "documents": tables.cut(lambda: tables["documents"]),
    }


def parse_documents(texts: DataFrame, layouts: DataFrame | None = None, failures: DataFrame | None = None) -> Tables:
    """All stages. layouts: (doc_id, layout_xml), where there are any; failures: (doc_id, error) of the layout tool. Nothing runs before
    a table is asked for."""
    tables = repair_references(recover_placeholders(parse_text(texts)))

    @cache
    def fixed() -> DataFrame:
        rows, _ = layout.post_process(tables["positions"], None, layouts, failures)
        return repair.repair_prices(rows)

    @cache
    def checked() -> tuple[DataFrame, DataFrame]:
        return subtotals.check_subtotals(fixed().drop("_fix"), subtotals.reported_totals(tables["lines"]), subtotals.price_facts(tables["lines"]))

    def warnings() -> DataFrame:
        _, told = layout.post_process(tables["positions"], tables["warnings"], layouts, failures)
        return repair.drop_price_warnings(told).unionByName(repair.price_warnings(fixed())).unionByName(checked()[1])

    return tables | {"positions": tables.cut(lambda: checked()[0]), "nodes": lambda: repair.clean_titles(tables["nodes"]), "warnings": tables.cut(warnings)}


def raw_pdfs(spark: SparkSession, path: str) -> Tables:
    """Tables of the raw parser for PDF files; a file whose text can't be had is no document but a warning."""
    read = pdf.read(spark, path, layout=False).persist(StorageLevel.MEMORY_AND_DISK)
    tables = _with_broken(parse_text(read.where("text IS NOT NULL").select("doc_id", "source", "text"), placeholders=False), read)
    tables.owned.append(read.unpersist)
    return tables


def _with_broken(tables: Tables, read: DataFrame) -> Tables:
    """tables with a warning for each file of pdf.read() without a text."""
    broken = read.where("text_error IS NOT NULL").select(
        "doc_id", F.lit(0).alias("stage"), F.lit(1).alias("ordinal"), F.lit("text_failed").alias("code"), F.lit(None).cast("string").alias("oz"), message("text_failed", F.lit(""), a=F.col("text_error")).alias("message"),
    )
    return tables | {"warnings": cache(lambda: tables["warnings"].unionByName(broken))}


def parse_pdfs(spark: SparkSession, path: str) -> tuple[Tables, DataFrame, DataFrame]:
    """(tables of all stages, layouts, images) of PDF files, each read once; where a tool fails, a warning says so, and the other files
    go on."""
    read = pdf.read(spark, path).persist(StorageLevel.MEMORY_AND_DISK)
    sound = read.where("text IS NOT NULL")
    layouts = sound.where("layout_error IS NULL").select("doc_id", "layout_xml")
    shots = sound.select("doc_id", F.explode("images").alias("i")).select("doc_id", "i.src", "i.content")
    failures = sound.where("layout_error IS NOT NULL").select("doc_id", F.col("layout_error").alias("error"))
    tables = _with_broken(parse_documents(sound.select("doc_id", "source", "text"), layouts, failures), read)
    tables.owned.append(read.unpersist)
    return tables, layouts, shots


def placeholder_rows(texts: DataFrame) -> DataFrame:
    """Positions of placeholder levels alone, of texts (doc_id, source, text)."""
    cut = parse.all_segments(texts, {parse.PLACEHOLDER: placeholder.kind})
    return placeholder.recovered(parse.read_positions(cut))


def export_documents(tables: Tables, formats: list[str], layouts: DataFrame | None = None, files: DataFrame | None = None, now: Column | None = None, allow_conflicts: bool = False) -> dict[str, DataFrame]:
    """Exports by format: json, xml, x83, x84, x83_priced. With both priced ones, the x83 is made from the x84."""
    assigned = None
    now = F.lit(datetime.now(timezone.utc)) if now is None else now  # one time for all formats
    if layouts is not None and files is not None:
        placed = images.targets(images.markers(layouts), images.placed_images(layouts, files))
        assigned = images.assign(placed, tables["positions"])
    out = {}
    more = {"now": now, "assigned": assigned, "allow_conflicts": allow_conflicts}
    if "json" in formats:
        out["json"] = export.json_documents(tables)
    if "xml" in formats:
        out["xml"] = export.master_xml(tables)
    if "x83" in formats:
        out["x83"] = export.exchange_xml(tables, "83", False, **more)
    if "x84" in formats:
        out["x84"] = export.exchange_xml(tables, "84", True, **more)
    if "x83_priced" in formats:
        out["x83_priced"] = export.priced_from_84(out["x84"]) if "x84" in out else export.exchange_xml(tables, "83", True, **more)
    return out


def leaf_totals(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf_oz, n, total): positions and the sum of their totals by leaf."""
    return rows.groupBy("doc_id", "leaf_oz").agg(F.count("*").alias("n"), F.sum("total_price").alias("total"))


def register_views(tables: Tables, prefix: str = "boq_") -> list[str]:
    """Temporary views of all tables, for SQL."""
    names = []
    for name, table in tables.items():
        table.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


__all__ = ["Tables", "export_documents", "leaf_totals", "parse_documents", "parse_pdfs", "parse_text", "placeholder_rows", "raw_pdfs", "recover_placeholders", "register_views", "release_all", "repair_references"]
