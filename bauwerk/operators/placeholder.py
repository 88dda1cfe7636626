"""Positions under a placeholder level, AA.BB.__.DDD, and the numeric order of the tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bauwerk.functions import patterns as P
from bauwerk.functions import text as X
from bauwerk.functions.spread import deal

from . import parse


def kind(line: Column) -> Column:
    """noise, open, close or text: placeholder lines open a segment, and it ends at these, at sums and at other numbered lines."""
    return (
        F.when(X.is_placeholder_noise(line), "noise").when(line.rlike(P.PLACEHOLDER), "open")
        .when(line.rlike(P.PLACEHOLDER_SUM) | line.rlike(P.PLACEHOLDER_END), "close").otherwise("text")
    )


kind.marks = {
    "noise": "|".join(["$", *map(re.escape, P.PLACEHOLDER_NOISE_PREFIXES)]), "open": parse.in_lines(P.PLACEHOLDER),
    "close": f"{parse.in_lines(P.PLACEHOLDER_SUM)}|{parse.in_lines(P.PLACEHOLDER_END)}",
}


def recovered(found: DataFrame) -> DataFrame:
    """Placeholder positions as AA.BB.00.DDD, those with a quantity, a unit price or a text. found: parse.read_positions()."""
    filled = F.col("quantity").isNotNull() | F.col("unit_price").isNotNull() | ~X.is_blank(F.col("short_text")) | ~X.is_blank(F.col("long_text"))
    return found.where((F.col("parser") == parse.PLACEHOLDER) & filled).drop("parser")


def loose_lines(head: Column, body: Column) -> Column:
    """Lines that placeholder_headings() reads."""
    return F.filter(body, lambda b: b["line"].rlike(P.PLACEHOLDER_HEADING))


def placeholder_headings(cut: DataFrame) -> DataFrame:
    """Headings of the second level that stand outside of placeholder positions or end in .06; the last one wins."""
    line = F.col("b.line")
    loose = cut.where(F.col("parser") == parse.PLACEHOLDER).select("doc_id", F.coalesce(F.col("head.kind") == "open", F.lit(False)).alias("open"), F.explode("body").alias("b")).where(line.rlike(P.PLACEHOLDER_HEADING))
    oz = F.regexp_extract(line, P.PLACEHOLDER_HEADING, 1)
    kept = loose.where(oz.endswith(".06") | ~F.col("open")).select("doc_id", oz.alias("oz"), "b", X.strip(F.regexp_extract(line, P.PLACEHOLDER_HEADING, 2)).alias("title"))
    last = kept.groupBy("doc_id", "oz").agg(F.max_by(F.struct("title", F.col("b.page").alias("page")), "b").alias("h"))
    return last.select("doc_id", "oz", "h.title", "h.page")


def merge_positions(main: DataFrame, extra: DataFrame) -> DataFrame:
    """main and those of extra whose OZ is new, each OZ once, in order of appearance; extra ones follow all others."""
    fresh = extra.join(main.select("doc_id", "oz").distinct(), ["doc_id", "oz"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "oz").orderBy("seq"))
    fresh = fresh.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    both = main.withColumn("_part", F.lit(0)).unionByName(fresh.withColumn("_part", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_part", "seq"))
    both = deal(both, "doc_id")
    return both.withColumn("seq", place).drop("_part")


def merge_nodes(main: DataFrame, merged: DataFrame, headings: DataFrame, main_count: DataFrame) -> DataFrame:
    """Nodes after recovery: those of main, with empty titles filled where a recovered position passes, and new ones.

    merged: merge_positions(); main_count: (doc_id, n), the number of positions of the main parser.
    """
    late = merged.join(main_count, "doc_id", "left").where(F.col("seq") > F.coalesce("n", F.lit(0))).drop("n")
    asked = parse.hierarchy(late, headings).select("doc_id", "oz", "level", "parent_oz", F.col("title").alias("new_title"), F.col("page").alias("new_page"), "oz_key", F.col("first_seq").alias("new_seq"))
    titled = headings.select("doc_id", "oz", F.lit(True).alias("has"))
    asked = asked.join(titled, ["doc_id", "oz"], "left")
    both = main.drop("level", "parent_oz", "oz_key").join(asked, ["doc_id", "oz"], "full")
    fill = F.col("title").isNull() | ((F.col("title") == "") & F.coalesce("has", F.lit(False)))
    level = F.size(F.split("oz", "[.]"))
    return both.select(
        "doc_id", "oz", F.when(level > 1, X.oz_prefix(F.col("oz"), level - 1)).alias("parent_oz"), level.alias("level"),
        F.when(fill, F.col("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(fill, F.col("new_page")).otherwise(F.col("page")).alias("page"),
        X.oz_key(F.col("oz")).alias("oz_key"), F.coalesce("first_seq", "new_seq").alias("first_seq"),
    )


def sort_positions(rows: DataFrame) -> DataFrame:
    """seq anew by numeric OZ; positions with equal OZ keep their order."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("oz_key", "seq")))
