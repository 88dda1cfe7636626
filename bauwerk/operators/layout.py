"""Positioned layout XML: fonts, fragments, lines, and bold short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bauwerk.functions import arrays as A
from bauwerk.functions import patterns as P
from bauwerk.functions import text as X
from bauwerk.schema import message

from .repair import refresh_warnings


def bold_fonts(layouts: DataFrame) -> DataFrame:
    """(doc_id, font) of the fonts whose family sounds bold."""
    specs = layouts.select("doc_id", F.explode(F.regexp_extract_all("layout_xml", F.lit(r"<fontspec\b([^>]*)/?>"), F.lit(1))).alias("a"))
    family = F.lower(F.coalesce(X.attribute(F.col("a"), "family"), F.lit("")))
    found = specs.select("doc_id", X.attribute(F.col("a"), "id").alias("font"), family.alias("family"))
    return found.where(F.col("font").isNotNull() & X.contains_any(F.col("family"), P.BOLD_FAMILIES)).select("doc_id", "font").distinct()


def _whole(body: Column, tag: str) -> Column:
    """The elements as they stand there, found by one match each."""
    return F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}\b[^>]*>.*?</{tag}>"), F.lit(0))


def _parts(whole: Column, tag: str) -> tuple[Column, Column]:
    """Attributes and content of an element."""
    end, opened, closed = F.instr(whole, ">"), len(f"<{tag}"), len(f"</{tag}>")
    return F.substr(whole, F.lit(opened + 1), end - opened - 1), F.substr(whole, end + 1, F.length(whole) - end - closed)


def layout_pages(layouts: DataFrame) -> DataFrame:
    """(doc_id, at, page, body); pages whose number isn't one are left out."""
    rows = layouts.select("doc_id", F.posexplode(_whole(F.col("layout_xml"), "page")).alias("at", "p"))
    attributes, body = _parts(F.col("p"), "page")
    rows = A.once(rows, page=X.number_attribute(attributes, "number", None), body=body).drop("p")
    return rows.where("page >= 0")


def fragments(pages: DataFrame) -> DataFrame:
    """(doc_id, at, page, seq, top, left, font, text), text as it stands there."""
    rows = pages.select("doc_id", "at", "page", F.posexplode(_whole(F.col("body"), "text")).alias("seq", "t"))
    rows = rows.select("doc_id", "at", "page", "seq", *[c.alias(x) for c, x in zip(_parts(F.col("t"), "text"), ("_a", "_b"))])
    a = F.col("_a")
    rows = A.once(rows, _top=X.attribute(a, "top"), _left=X.attribute(a, "left"), _bare=X.bare(F.col("_b")))
    zero = lambda c: F.coalesce(X.number(F.col(c)), F.lit(0))
    return rows.select(
        "doc_id", "at", "page", "seq", zero("_top").alias("top"), zero("_left").alias("left"),
        F.coalesce(X.attribute(a, "font"), F.lit("")).alias("font"), X.unescape(F.col("_bare")).alias("text"),
    )


def group_lines(grouped: DataFrame) -> DataFrame:
    """grouped with items, fragments (top, left, seq, bold, text) in this order, as lines (top, bold, text): a fragment joins the line before
    while it lies within two units of that line's first fragment. One pass finds the first fragments, another joins each line's."""
    anchor = lambda top, f, opened: F.when(opened, f["top"]).otherwise(top)
    opens = A.openings(F.col("items"), F.lit(None).cast("int"), lambda top, f: F.abs(top - f["top"]) > 2, anchor)
    line = lambda f, rest: F.struct(f["top"].alias("top"), (f["bold"] | F.exists(rest, lambda r: r["bold"])).alias("bold"), F.array_join(F.concat(F.array(f["text"]), F.transform(rest, lambda r: r["text"])), " ").alias("text"))
    return A.once(grouped, opens=opens).withColumn("lines", A.runs(F.col("items"), F.col("opens"), line)).drop("items", "opens")


def layout_lines(layouts: DataFrame) -> DataFrame:
    """(doc_id, at, page, lines) of each page."""
    cleaned = A.once(fragments(layout_pages(layouts)).withColumnRenamed("text", "_raw"), text=X.normalize(F.col("_raw"))).where("text <> ''")
    marked = cleaned.join(bold_fonts(layouts).withColumn("_bold", F.lit(True)), ["doc_id", "font"], "left")
    item = F.struct("top", "left", "seq", F.coalesce("_bold", F.lit(False)).alias("bold"), "text")
    return group_lines(marked.groupBy("doc_id", "at", "page").agg(F.sort_array(F.collect_list(item)).alias("items")))


def _marked(lines: Column) -> Column:
    """lines with code, what each is to a short text before it: s ends it, n is page furniture, t is taken, x (a price, or other text)
    ends it once it has begun."""

    def mark(line: Column) -> Column:
        text = line["text"]
        code = (
            F.when(text.rlike(P.POSITION) | text.rlike(P.LAYOUT_HEADING), "s").when(X.is_layout_noise(text), "n")
            .when(line["bold"] & X.is_short_text_candidate(text), "t").otherwise("x")  # a price is no candidate
        )
        return F.struct(text.alias("text"), line["bold"].alias("bold"), code.alias("code"))

    return F.transform(lines, mark)


def _scan(first: Column, following: Column) -> Column:
    """Lines of the short text: what the position line starts with and what the following lines add, up to the first that ends it. following:
    _marked()."""
    codes = F.array_join(F.transform(following, lambda x: x["code"]), "")
    read = F.length(F.when(F.size(first) > 0, F.regexp_extract(codes, "^[nt]*", 0)).otherwise(F.regexp_extract(codes, "^[nx]*[nt]*", 0)))
    return F.concat(first, F.transform(F.filter(F.slice(following, F.lit(1), read), lambda x: x["code"] == "t"), lambda x: x["text"]))


def bold_short_texts(layouts: DataFrame) -> DataFrame:
    """(doc_id, oz, page, short): bold lines at or after a position's line; more lines win, then the earlier find."""
    rows = A.once(layout_lines(layouts).withColumnRenamed("lines", "_lines"), lines=_marked(F.col("_lines"))).drop("_lines")
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i)["code"] == "s")
    rows = rows.where(F.size("lines") > 0).select("doc_id", "at", "page", "lines", F.explode(places).alias("i"))
    rows = A.once(rows, l=F.get("lines", F.col("i"))).where(F.col("l.text").rlike(P.POSITION))
    rows = A.once(rows, _rest=F.regexp_extract("l.text", P.POSITION, 2))
    rest = F.col("_rest")
    hits = rows.where(~X.is_reference_text(rest))
    first = F.when(F.col("l.bold") & X.is_short_text_candidate(rest), F.array(rest)).otherwise(F.expr("cast(array() as array<string>)"))
    found = hits.select("doc_id", "at", "page", "i", F.regexp_extract("l.text", P.POSITION, 1).alias("oz"), _scan(first, F.slice("lines", F.col("i") + 2, F.lit(P.LOOK_AHEAD))).alias("short"))
    found = found.where(F.size("short") > 0)
    nth = F.row_number().over(Window.partitionBy("doc_id", "oz", "page").orderBy(F.size("short").desc(), "at", "i"))
    return found.withColumn("_n", nth).where("_n = 1").select("doc_id", "oz", "page", F.array_join("short", "\n").alias("short"))


def drop_references(rows: DataFrame) -> DataFrame:
    """Without positions whose first line refers to another position; priced ones go, too."""
    every = F.concat(X.text_lines(F.col("short_text")), X.text_lines(F.col("long_text")))
    first = F.coalesce(F.try_element_at(F.filter(every, lambda x: ~X.is_blank(x)), F.lit(1)), F.lit(""))
    return rows.where(~X.is_reference_text(first))


def apply_short_texts(rows: DataFrame, shorts: DataFrame) -> DataFrame:
    """Bold short texts replace parsed ones; their further lines leave the start of the long text."""
    known = shorts.select("doc_id", "oz", F.col("page").alias("page_from"), F.col("short").alias("_short"))
    joined = rows.join(known, ["doc_id", "oz", "page_from"], "left")
    more = F.transform(F.slice(X.text_lines(F.col("_short")), 2, F.greatest(F.size(X.text_lines(F.col("_short"))), F.lit(1))), X.normalize)
    long = X.text_lines(F.col("long_text"))
    places = F.sequence(F.lit(1), F.least(F.size(more), F.size(long)))
    same = lambda k: X.normalize(F.element_at(long, k)) == F.element_at(more, k)
    run = F.when(F.least(F.size(more), F.size(long)) > 0, F.aggregate(places, F.lit(0), lambda n, k: F.when((n == k - 1) & same(k), k).otherwise(n))).otherwise(0)
    cut = X.strip(F.array_join(F.slice(long, run + 1, F.greatest(F.size(long), F.lit(1))), "\n"))
    joined = joined.withColumn("long_text", F.when(F.col("_short").isNotNull() & (run > 0), cut).otherwise(F.col("long_text")))
    joined = joined.withColumn("short_text", F.coalesce("_short", "short_text"))
    return joined.select(*rows.columns)


def post_process(rows: DataFrame, warnings: DataFrame | None, layouts: DataFrame | None, failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(positions, warnings) after references are dropped and short texts applied. Documents without layout keep their
    texts; failures(doc_id, error) of the layout tool become warnings of stage 3. warnings may be left out."""
    kept = drop_references(rows)
    if layouts is not None:
        kept = apply_short_texts(kept, bold_short_texts(layouts))
    if warnings is None:
        return kept, None
    if failures is not None:
        told = failures.select("doc_id", F.lit(3).alias("stage"), F.lit(1).alias("ordinal"), F.lit("layout_failed").alias("code"), F.lit(None).cast("string").alias("oz"), message("layout_failed", F.lit(""), a=F.col("error")).alias("message"))
        warnings = warnings.unionByName(told)
    return kept, refresh_warnings(warnings, kept, incomplete=False)
