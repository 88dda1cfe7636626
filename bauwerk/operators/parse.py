"""Layout text to headings, hierarchy, positions and first warnings.

A document is cut in place, in its row, for all parsers together, so nothing is shuffled or joined. Of very long ones the pages are
dealt out once; then only counts of pages meet by document, and pieces that run over a page's end by segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bauwerk.functions import arrays as A
from bauwerk.functions import numbers as N
from bauwerk.functions import patterns as P
from bauwerk.functions import text as X
from bauwerk.schema import message

_ORDER = ["page", "line_no"]

#: Parsers that share one reading of the pages.
MAIN, PLACEHOLDER = 0, 1

#: Characters up to which a document is cut in one row.
WHOLE = 1_000_000


def pages(texts: DataFrame) -> DataFrame:
    """(doc_id, page, raw, lines) of texts(doc_id, text): each page's lines as they stand there, and normalised.

    Pages are dealt out to as many tasks as the session has shuffle partitions, however few bytes they have, as the work on a
    line is much for its size; a very long document is spread like any other.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paged = texts.select("doc_id", F.posexplode(X.pages(F.coalesce("text", F.lit("")))).alias("page", "body"))
    rows = paged.select("doc_id", (F.col("page") + 1).alias("page"), X.text_lines(F.col("body")).alias("raw")).repartition(tasks, "doc_id", "page")
    return rows.withColumn("lines", F.transform("raw", X.normalize))


def lines_of(read: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, raw, line) of pages()."""
    rows = read.select("doc_id", "page", F.posexplode(F.arrays_zip("raw", "lines")).alias("line_no", "x"))
    return rows.select("doc_id", "page", "line_no", "x.raw", F.col("x.lines").alias("line"))


def lines(texts: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, raw, line) of texts(doc_id, text)."""
    return lines_of(pages(texts))


def lines_in_place(texts: DataFrame) -> DataFrame:
    """lines() whose rows stay where their document is, for texts that are in enough partitions and none of them very long."""
    paged = texts.select("doc_id", F.posexplode(X.pages(F.coalesce("text", F.lit("")))).alias("page", "body"))
    rows = paged.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(X.text_lines(F.col("body"))).alias("line_no", "raw"))
    return A.once(rows, line=X.normalize(F.col("raw")))


def _short(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts that are cut in one row, and the others."""
    long = F.coalesce(F.length("text"), F.lit(0)) > WHOLE
    return texts.where(~long), texts.where(long)


def all_lines(texts: DataFrame) -> DataFrame:
    """lines(); only those of very long documents are dealt out. texts are read twice."""
    short, long = _short(texts)
    return lines_in_place(short).unionByName(lines(long))


def all_segments(texts: DataFrame, kinds: dict[int, Callable[[Column], Column]]) -> DataFrame:
    """segments() of texts(doc_id, text), for each parser in kinds. texts are read twice."""
    short, long = _short(texts)
    return whole_segments(short, kinds).unionByName(segments(cut_pages(pages(long), kinds)))


def in_lines(pattern: str) -> str:
    """A pattern of a normalised line, for use behind the beginning of a line among others: white space is one blank there."""
    return pattern.removeprefix("(?U)").removeprefix("^").replace(r"\s+", " ").replace(r"\s*", " ?").replace(r"\s", " ").replace(r"\z", "$")


def kind(line: Column) -> Column:
    """noise, position, heading, sum or text; the first that fits."""
    return (
        F.when(X.is_noise(line), "noise")
        .when(line.rlike(P.POSITION), "position")
        .when(line.rlike(P.HEADING), "heading")
        .when(line.rlike(P.SUM), "sum")
        .otherwise("text")
    )


#: kind()'s tests as patterns of a line among others, for whole_segments().
kind.marks = {
    "noise": "|".join(["$", in_lines(P.FOOTER), *map(re.escape, P.NOISE_PREFIXES)]),
    "position": in_lines(P.POSITION), "heading": in_lines(P.HEADING), "sum": in_lines(P.SUM),
}


def classify(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kind", kind(F.col("line")))


def cut_pages(read: DataFrame, kinds: dict[int, Callable[[Column], Column]]) -> DataFrame:
    """(doc_id, page, parser, n_heads, content, pieces) of pages(), a row for each parser in kinds: its lines but noise, cut before each head, which is a line
    that is neither noise nor text. The first piece has no head: what is left of the page before.
    content tells if the page counts as one with text for the parser. pieces: array<struct<head, body>>.
    """
    item = lambda kind: lambda x, i: F.struct(i.alias("line_no"), kind(x).alias("kind"), x.alias("line"))
    each = F.array(*[F.struct(F.lit(p).alias("parser"), F.transform("lines", item(k)).alias("items")) for p, k in kinds.items()])
    # The main parser takes pages with visible text for the document's last one, the other any page with a line.
    content = F.when(F.col("parser") == MAIN, F.exists("raw", lambda r: r.rlike(r"(?U)\S"))).otherwise(F.size("raw") > 0)
    rows = read.select("doc_id", "page", "raw", F.inline(each)).select("doc_id", "page", "parser", content.alias("content"), F.filter("items", lambda x: x["kind"] != "noise").alias("items"))
    rows = A.once(rows, heads=F.filter(F.transform("items", lambda x, i: F.when(x["kind"] != "text", i + 1)), lambda i: i.isNotNull()))
    rows = A.once(rows, edges=F.concat(F.array(F.lit(0)), "heads"))
    page = F.col("page")
    head = lambda c: F.when(c > 0, F.element_at("items", F.greatest(c, F.lit(1))))
    body = lambda c, k: F.slice("items", c + 1, F.coalesce(F.get("edges", k + 1), F.size("items") + 1) - c - 1)
    piece = lambda c, k: F.struct(
        A.let(head(c), lambda h: F.when(h.isNotNull(), F.struct(page.alias("page"), h["line_no"].alias("line_no"), h["kind"].alias("kind"), h["line"].alias("line")))).alias("head"),
        F.transform(body(c, k), lambda b: F.struct(page.alias("page"), b["line_no"].alias("line_no"), b["line"].alias("line"))).alias("body"),
    )
    return rows.select("doc_id", "page", "parser", F.size("heads").alias("n_heads"), "content", F.transform("edges", piece).alias("pieces"))


#: White space but blanks and line feeds, as \\s with (?U) has it, which takes several times as long.
_SPACES = r"\t\x0B\f\r\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

#: How a line stands with a parser, as a code before it: left out, text, and from there on its kinds of heads in their order.
_NOISE, _TEXT = "0", "1"


def _coded_lines(body: Column, marks: list[dict[str, str]]) -> Column:
    """Lines of a page, normalised, each behind a code a parser; one without codes is empty. The page is gone over once a pattern, which takes
    a fraction of what a test of each line does."""
    text = F.regexp_replace(F.regexp_replace(body, f"[{_SPACES}][ {_SPACES}]*| [ {_SPACES}]+", " "), "(?md)^ | $", "")
    text = F.regexp_replace(text, "(?md)^", _TEXT * len(marks))
    for k, kinds in enumerate(marks):
        before = "." * k
        for code, pattern in enumerate(kinds.values()):
            code += code > 0  # 1 is text
            text = F.regexp_replace(text, rf"(?mdU)^({before}){_TEXT}(?={'.' * (len(marks) - k - 1)}(?:{pattern}))", rf"$1\{code}")
    cut = F.split(text, "\n", -1)
    # What ends on a line end has no line after it; of an empty last line with blanks only the blanks are gone.
    return A.let(cut, lambda c: F.when((body == "") | body.endswith("\n"), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c))


def whole_segments(texts: DataFrame, kinds: dict[int, Callable[[Column], Column]]) -> DataFrame:
    """segments() of texts(doc_id, text), each cut in its row. kinds: functions with marks, the patterns by kind in the order of their tests,
    noise first."""
    n, marks = len(kinds), [k.marks for k in kinds.values()]
    rows = A.once(texts.select("doc_id", "text"), pages=X.pages(F.coalesce("text", F.lit("")))).drop("text")
    line = lambda page: lambda x, i: F.struct((page + 1).alias("page"), i.alias("line_no"), x.alias("line"))
    number = lambda test: F.array_max(F.transform("pages", lambda body, page: F.when(test(body), page + 1)))
    last = {MAIN: lambda body: body.rlike(r"(?U)\S")}  # see content in cut_pages()
    rows = A.once(
        rows, lines=F.flatten(F.transform("pages", lambda body, page: F.transform(_coded_lines(body, marks), line(page)))),
        **{f"last_{p}": number(last.get(p, lambda body: body != "")) for p in kinds},
    ).drop("pages")
    code = lambda x, k: F.substr(x["line"], F.lit(k + 1), F.lit(1))
    kept = lambda k: F.filter("lines", lambda x: code(x, k) >= _TEXT)
    rows = A.once(rows, **{f"items_{p}": kept(k) for k, p in enumerate(kinds)}).drop("lines")
    heads = lambda p, k: F.filter(F.transform(f"items_{p}", lambda x, i: F.when(code(x, k) > _TEXT, i + 1)), lambda i: i.isNotNull())
    rows = A.once(rows, **{f"edges_{p}": F.concat(F.array(F.lit(0)), heads(p, k)) for k, p in enumerate(kinds)})
    bare = lambda x: F.substr(x["line"], F.lit(n + 1))

    def pieces(p: int, k: int) -> Column:
        items, edges = F.col(f"items_{p}"), F.col(f"edges_{p}")

        def piece(c: Column, seg: Column) -> Column:
            names = F.lit(None).cast("string")
            for number, name in enumerate(marks[k]):
                names = F.when(code(F.element_at(items, c), k) == str(number + (number > 0)), name).otherwise(names) if number else names
            head = F.when(c > 0, A.let(F.element_at(items, F.greatest(c, F.lit(1))), lambda h: F.struct(h["page"].alias("page"), h["line_no"].alias("line_no"), names.alias("kind"), bare(h).alias("line"))))
            after = F.get(edges, seg + 1)
            body = F.transform(F.slice(items, c + 1, F.coalesce(after, F.size(items) + 1) - c - 1), lambda b: F.struct(b["page"].alias("page"), b["line_no"].alias("line_no"), bare(b).alias("line")))
            return F.struct(F.lit(p).alias("parser"), seg.alias("seg"), head.alias("head"), body.alias("body"), F.coalesce(F.get(items, after - 1)["page"], f"last_{p}", F.lit(1)).alias("page_end"))

        return F.transform(edges, piece)

    found = F.filter(F.concat(*[pieces(p, k) for k, p in enumerate(kinds)]), lambda s: s["head"].isNotNull() | (F.size(s["body"]) > 0))
    return rows.select("doc_id", F.inline(found))


def segments(cut: DataFrame) -> DataFrame:
    """(doc_id, parser, seg, head, body, page_end): head lines with the text lines up to the next one, in order; seg counts heads, and 0, which has no
    head, is the text before the first. page_end is the page of the next head, or else the last with content. cut: cut_pages().

    Numbers are a prefix sum in two levels: heads of the pages before, and the place in the page. Only page counts meet by document;
    pieces that end on their page are segments, the others meet by segment.
    """
    forward = Window.partitionBy("doc_id", "parser").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("doc_id", "parser").orderBy(F.col("page").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("content"), F.col("page"))).over(Window.partitionBy("doc_id", "parser"))
    counts = cut.select(
        "doc_id", "page", "parser", F.coalesce(F.sum("n_heads").over(forward), F.lit(0)).cast("int").alias("before"),
        F.coalesce(F.last(F.when(F.col("n_heads") > 0, F.col("page")), True).over(backward), last, F.lit(1)).alias("after"),
    )
    # Pages are dealt out by document and page already, so the counts of a page's parsers come to it in one row, and pieces stay where they are.
    known = counts.groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("parser", F.struct("before", "after")))).alias("known"))
    rows = cut.drop("content").join(known, ["doc_id", "page"]).select("doc_id", "page", "parser", "n_heads", F.col("known")[F.col("parser")].alias("c"), "pieces")
    rows = rows.select("doc_id", "page", "parser", "n_heads", "c.before", "c.after", F.posexplode("pieces").alias("k", "p"))
    ends = F.col("k") < F.col("n_heads")
    rows = rows.select(
        "doc_id", "parser", (F.col("before") + F.col("k")).alias("seg"), "p.head", "p.body", F.when(ends, F.col("page")).otherwise(F.col("after")).alias("page_end"),
        "page", (ends & (F.col("k") > 0)).alias("whole"),
    ).where("head IS NOT NULL OR size(body) > 0")
    met = rows.where("NOT whole").groupBy("doc_id", "parser", "seg").agg(F.min("head").alias("head"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"])).alias("body"), F.max("page_end").alias("page_end"))
    return rows.where("whole").drop("page", "whole").unionByName(met)


#: Stands between the parts of a price that one match has cut.
_CUT = "\u0000\u0001"


def _price(source: Column) -> Column:
    """source, or, where it is a price text, its quantity, unit, unit price and total or '', with _CUT between; null where it can't be one."""
    return F.when(source.contains("€") & ~source.contains(_CUT), F.regexp_replace(source, P.PRICED, _CUT.join(f"${k}" for k in (1, 2, 3, 4))))


def finish(heads: DataFrame, *kept: Column) -> DataFrame:
    """Positions of heads(doc_id, parser, seg, oz, rest, body, page, page_end): price, flags and texts, and columns kept. Each step is worked
    out once, and none has a function over elements, for which Spark has no generated code."""
    col, is_price = F.col, lambda c: F.coalesce(F.col(c).contains(_CUT), F.lit(False))
    part = lambda c, k: F.get(F.split(c, _CUT, -1), F.lit(k))
    lines = col("body.line")
    plain = lines
    for phrase in (*P.CONTINUATIONS, P.OPTIONAL):
        plain = F.array_remove(plain, phrase)
    step = A.once(heads.withColumn("rest", F.coalesce("rest", F.lit(""))), _first=_price(col("rest")), _optional=F.array_contains(lines, P.OPTIONAL), _plain=plain).drop("body")
    every = F.when(is_price("_first") | (col("rest") == ""), col("_plain")).otherwise(F.concat(F.array("rest"), "_plain"))
    only = lambda c: F.coalesce(F.col(c).contains(P.PRICE_ONLY), F.lit(False))
    step = A.once(step, _all=every, _only=is_price("_first") & only("rest"), _none=~is_price("_first") | N.german_decimal(part(col("_first"), 0), 3).isNull()).drop("_plain", "rest")
    # A price may be spread over lines; the most that make one count.
    sizes = range(P.PRICE_FRAGMENTS, 0, -1)
    step = A.once(step, **{f"_l{n}": F.when(col("_none") & (F.size("_all") >= n), F.array_join(F.slice("_all", 1, n), " ")) for n in sizes}).drop("_none")
    step = A.once(step, **{f"_t{n}": _price(col(f"_l{n}")) for n in sizes})
    used, found, alone = F, col("_first"), F.lit(False)
    for n in sizes:
        used = used.when(is_price(f"_t{n}"), n)
    for n in reversed(sizes):
        found, alone = F.when(is_price(f"_t{n}"), col(f"_t{n}")).otherwise(found), F.when(is_price(f"_t{n}"), only(f"_l{n}")).otherwise(alone)
    step = A.once(step, _used=used.otherwise(0), _found=found, _flag=col("_optional") | col("_only") | alone)
    step = step.drop("_first", "_only", "_optional", *[f"_{x}{n}" for n in sizes for x in "lt"])
    left = F.array_remove(F.slice("_all", col("_used") + 1, F.greatest(F.size("_all"), F.lit(1))), "")
    step = A.once(step, _parts=F.when(is_price("_found"), F.split("_found", _CUT, -1)), _left=left).drop("_all", "_used", "_found")
    got = lambda k: F.get("_parts", F.lit(k))
    return A.once(
        step, quantity=N.german_decimal(got(0), 3), unit=got(1), unit_price=N.german_decimal(got(2)), total_price=N.german_decimal(F.nullif(got(3), F.lit(""))),
        short_text=F.coalesce(F.try_element_at("_left", F.lit(1)), F.lit("")), long_text=F.array_join(F.slice("_left", 2, F.greatest(F.size("_left"), F.lit(1))), "\n"),
    ).select(
        "doc_id", "parser", F.col("seg").cast("int").alias("seq"), "oz", X.oz_prefix(F.col("oz"), 3).alias("leaf_oz"), X.oz_key(F.col("oz")).alias("oz_key"),
        "quantity", "unit", "unit_price", "total_price", "short_text", "long_text", F.col("page").alias("page_from"), F.greatest("page", "page_end").alias("page_to"),
        F.col("_flag").alias("provisional"), F.col("_flag").alias("price_only"), *kept,
    )


def read_positions(cut: DataFrame) -> DataFrame:
    """Positions of all parsers, with parser. cut: segments()."""
    return finish(_heads(cut.where("head.kind IN ('position', 'open')")))


def read_all(cut: DataFrame, loose: dict[int, Callable[[Column, Column], Column]]) -> DataFrame:
    """read_positions() with other rows whose oz is null, and with head and body as far as they are read otherwise: lines of headings, and
    what loose, by parser, keeps of a head and a body. cut: segments()."""
    lines = F.lit(None)
    for parser, kept in loose.items():
        lines = F.when(F.col("parser") == parser, kept(F.col("head"), F.col("body"))).otherwise(lines)
    kind = F.col("head.kind")
    opens = F.coalesce(kind.isin("position", "open"), F.lit(False))
    head = F.when(F.col("head").isNotNull(), F.col("head").withField("line", F.when(kind == "heading", F.col("head.line"))))
    step = A.once(cut.withColumn("_opens", opens), _head=head, _lines=lines).where(F.col("_opens") | (F.col("_head.kind") == "heading") | (F.size("_lines") > 0))
    heads = _heads(step, "_head", "_lines").withColumn("body", F.when(F.col("oz").isNotNull(), F.col("body")).otherwise(F.slice("body", 1, 0)))
    return finish(heads, F.col("_head").alias("head"), F.col("_lines").alias("body"))


def loose_lines(head: Column, body: Column) -> Column:
    """Lines that preambles() reads."""
    return F.filter(body, lambda b: (b["page"] < P.PREAMBLE_PAGES) & (head.isNull() | (head["kind"] != "position")))


def _heads(cut: DataFrame, *kept: str) -> DataFrame:
    group = lambda pattern, k: F.regexp_extract("head.line", pattern, k)
    filled = F.concat_ws(".", group(P.PLACEHOLDER, 1), group(P.PLACEHOLDER, 2), F.lit("00"), group(P.PLACEHOLDER, 3))
    main, opened = F.col("parser") == MAIN, F.col("head.kind").isin("position", "open")
    oz, rest = F.when(main, group(P.POSITION, 1)).otherwise(filled), F.when(main, group(P.POSITION, 2)).otherwise(group(P.PLACEHOLDER, 4))
    return cut.select("doc_id", "parser", "seg", "body", "page_end", F.col("head.page").alias("page"), F.when(opened, oz).alias("oz"), F.when(opened, rest).alias("rest"), *kept)


def positions(found: DataFrame) -> DataFrame:
    """Positions of the main parser in order of appearance. found: read_positions()."""
    return found.where(F.col("parser") == MAIN).drop("parser")


def headings(cut: DataFrame) -> DataFrame:
    """(doc_id, oz, title, page): the last heading of each OZ wins."""
    heads = cut.where((F.col("parser") == MAIN) & (F.col("head.kind") == "heading")).select(
        "doc_id", F.regexp_extract("head.line", P.HEADING, 1).alias("oz"),
        F.struct(F.col("head.page"), F.col("head.line_no")).alias("at"), X.strip(F.regexp_extract("head.line", P.HEADING, 2)).alias("title"),
    )
    last = heads.groupBy("doc_id", "oz").agg(F.max_by(F.struct("title", F.col("at.page").alias("page")), "at").alias("h"))
    return last.select("doc_id", "oz", "h.title", "h.page")


def preambles(cut: DataFrame) -> DataFrame:
    """(doc_id, preamble): text outside positions on the first pages."""
    loose = cut.where((F.col("parser") == MAIN) & F.expr("head IS NULL OR head.kind <> 'position'")).select("doc_id", F.explode("body").alias("b"))
    early = loose.where(F.col("b.page") < P.PREAMBLE_PAGES).groupBy("doc_id").agg(F.sort_array(F.collect_list("b")).alias("all"))
    return early.select("doc_id", X.strip(F.array_join(F.transform("all", lambda r: r["line"]), "\n")).alias("preamble"))


def metadata(rows: DataFrame) -> DataFrame:
    """(doc_id, client, bidder, project): the first line of each kind, noise or not."""
    fields = {"client": "Auftraggeber ", "bidder": "Bieter ", "project": "Projekt "}
    line, at = F.col("line"), F.struct(*_ORDER)
    first = [F.min_by(F.when(line.startswith(p), X.strip(F.substr(line, F.lit(len(p) + 1)))), F.when(line.startswith(p), at)).alias(x) for x, p in fields.items()]
    return rows.where(X.starts_with_any(line, list(fields.values()))).groupBy("doc_id").agg(*first)


def prefixes(rows: DataFrame) -> DataFrame:
    """(doc_id, oz, level, seq, page): what each position asks of the three levels above it."""
    levels = F.array(*[F.struct(X.oz_prefix(F.col("oz"), k).alias("oz"), F.lit(k).alias("level")) for k in (1, 2, 3)])
    return rows.select("doc_id", "seq", F.col("page_from").alias("page"), F.explode(levels).alias("n")).select("doc_id", "n.oz", "n.level", "seq", "page")


def hierarchy(found: DataFrame, named: DataFrame) -> DataFrame:
    """Nodes above the positions ``found``; title and page from headings ``named``, else empty and the first position's page."""
    first = prefixes(found).groupBy("doc_id", "oz", "level").agg(F.min(F.struct("seq", "page")).alias("first"))
    joined = first.join(named.withColumnRenamed("page", "heading_page"), ["doc_id", "oz"], "left")
    return joined.select(
        "doc_id", "oz", F.when(F.col("level") > 1, X.oz_prefix(F.col("oz"), F.col("level") - 1)).alias("parent_oz"), "level",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("heading_page", "first.page").alias("page"),
        X.oz_key(F.col("oz")).alias("oz_key"), F.col("first.seq").alias("first_seq"),
    )


def documents(texts: DataFrame, rows: DataFrame, cut: DataFrame) -> DataFrame:
    """One row a document."""
    out = texts.select("doc_id", "source").join(metadata(rows), "doc_id", "left").join(preambles(cut), "doc_id", "left")
    text = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return out.select("doc_id", text("source"), text("project"), text("client"), text("bidder"), F.lit("EUR").alias("currency"), text("preamble"))


def in_tree_order(rows: DataFrame) -> DataFrame:
    """Adds at: where a position comes when the tree, in order of appearance, is walked."""
    firsts = [F.min("seq").over(Window.partitionBy("doc_id", X.oz_prefix(F.col("oz"), k))).alias(f"_{k}") for k in (1, 2, 3)]
    return rows.select("*", *firsts).withColumn("at", F.struct("_1", "_2", "_3", "seq")).drop("_1", "_2", "_3")


def first_warnings(found: DataFrame) -> DataFrame:
    """Warnings of the raw parser (stage 1): repeated OZ, incomplete price lines, deviating prices."""
    walked = in_tree_order(found)
    nth = F.row_number().over(Window.partitionBy("doc_id", "oz").orderBy("at"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    diff = F.abs(F.col("quantity") * F.col("unit_price") - F.col("total_price"))
    oz = F.col("oz")
    made = F.array(
        F.when(nth > 1, F.struct(F.lit(0).alias("k"), F.lit("dup_oz").alias("code"), message("dup_oz", oz).alias("message"))),
        F.when(
            ~X.is_omitted_strictly(F.col("short_text"), F.col("long_text")) & (F.col("quantity").isNull() | F.col("unit_price").isNull()),
            F.struct(F.lit(1).alias("k"), F.lit("incomplete").alias("code"), message("incomplete", oz).alias("message")),
        ),
        F.when(diff > F.lit(N.TOLERANCE).cast("decimal(3,2)"), F.struct(F.lit(2).alias("k"), F.lit("deviation").alias("code"), message("deviation", oz, a=diff.cast("string")).alias("message"))),
    )
    out = walked.select("doc_id", "oz", place.alias("place"), made.alias("made")).select("doc_id", "oz", "place", F.explode("made").alias("w"))
    return out.where("w IS NOT NULL").select("doc_id", F.lit(1).alias("stage"), (F.col("place") * 3 + F.col("w.k")).alias("ordinal"), "w.code", "oz", "w.message")
