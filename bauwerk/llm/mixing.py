"""Operator 1: mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import ranked, running
from .shared import WORD, documents, materialise

#: Rows of one cell and cells of one block, on average; a cell is what one window group sorts.
CELL_ROWS = 512
BLOCK_CELLS = 256
#: Random offsets that a source may choose from.
DRAWS = 16


def word_count(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(stats: DataFrame, weights: list[int], share: float, at_most: float) -> DataFrame:
    """Targets of the sources in stats(source, n_rows, source_size): adds target and offset.

    Sources get the weights in code point order, null last, over and over. They share ``share`` of all sizes;
    none gets more than ``at_most`` times its own size, and what is over goes to the others by weight
    until none is above. That is the water level L with sum(min(cap, weight * L)) = total: after sorting
    by cap / weight, the capped sources are a prefix, found by running sums. One row per source takes part, and these are
    numbered and summed up by ranges, so there may be as many sources as documents.
    """
    if share > at_most:
        raise ValueError("share of all sizes can't be above at_most")
    name = [F.col("source").isNull().asc(), F.col("source").asc()]
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked(stats, [], name).withColumn("weight", F.element_at(table, (F.col("place") % len(weights) + 1).cast("int")))
    weighted = weighted.select("source", "source_size", "n_rows", "weight", (F.col("source_size") * F.lit(float(at_most))).alias("cap"))
    summed = running(weighted.withColumn("level", F.col("cap") / F.col("weight")), [F.col("level").asc(), *name], {"cap_run": "cap", "weight_run": "weight"})
    whole = summed.agg(F.sum("weight").alias("weights"), (F.sum("source_size") * F.lit(float(share))).alias("total")).first()  # two numbers
    fill = (F.lit(whole["total"]) - F.col("cap_run") + F.col("cap")) / (F.lit(whole["weights"]) - F.col("weight_run") + F.col("weight"))
    # The first source whose fill is not above its own level sets the water; later fills are not above it.
    water = summed.select(fill.alias("fill"), "level").where("fill <= level").agg(F.max("fill").alias("water")).first()["water"]
    target = F.col("cap") if water is None else F.least("cap", F.col("weight") * F.lit(water))
    return summed.select("source", "source_size", "n_rows", target.alias("target"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, k1, k2): whole rows, and two hashes of all their columns. Rows that agree in both are the same."""
    others = [x for x in docs.columns if x not in ("doc_id", "text", "source")]
    rest = F.to_json(F.struct(*[F.col(f"`{x}`") for x in others])) if others else F.lit("")
    return docs.select(
        F.struct("*").alias("row"), F.xxhash64("doc_id", "source", "text", rest).alias("k1"), F.xxhash64(F.lit(7), "doc_id", "source", "text", rest).alias("k2")
    )


def _dealt(docs: DataFrame, weights: tuple[int, ...], share: float, at_most: float, seed: int) -> DataFrame:
    """Chunks of equal rows with their places in the source's order: doc_id, source, size, k1, k2, rows, source_size, target,
    each (copies that a row expects), first (rows before the chunk) and offset."""
    row = F.col("row")
    sized = (
        _keyed(docs).select(row["doc_id"].alias("doc_id"), row["source"].alias("source"), word_count(row["text"]).alias("size"), "k1", "k2")
        .groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count("*").alias("times"))
        .withColumn("class", F.floor(F.log1p("size") * 16).cast("int"))
        # A row that is there very often is dealt out in chunks, each with a cell of its own.
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("times") - 1) / CELL_ROWS).cast("long"))))
        .withColumn("rows", F.least(F.lit(CELL_ROWS).cast("long"), F.col("times") - F.col("chunk") * CELL_ROWS)).drop("times")
    )
    sized = materialise(sized)
    groups = sized.groupBy("source", "class").agg(F.sum("rows").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("words"))
    stats = groups.groupBy("source").agg(F.sum("n").alias("n_rows"), F.sum("words").alias("source_size"))
    targets = source_targets(stats, list(weights), share, at_most).select(F.col("source").alias("of"), "source_size", "target")
    spread = groups.select(F.col("source").alias("s"), F.col("class").alias("c"), F.ceil(F.col("n") / CELL_ROWS).cast("long").alias("cells"))
    placed = sized.join(spread, F.expr("source <=> s AND class = c")).withColumn("cell", F.pmod(F.xxhash64("k2", "k1", "chunk"), "cells"))
    key = ["source", "class", "block", "cell"]
    placed = placed.withColumn("block", F.floor(F.col("cell") / BLOCK_CELLS)).drop("s", "c", "cells")
    cells = placed.groupBy(*key).agg(F.sum("rows").alias("rows"))
    blocks = cells.groupBy(*key[:3]).agg(F.sum("rows").alias("rows"))
    before = lambda w: F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    blocks = blocks.select(*key[:3], before(Window.partitionBy("source").orderBy("class", "block")).alias("b0"))
    blocks = blocks.join(targets, F.expr("source <=> of")).drop("of")
    cells = cells.select(*key, before(Window.partitionBy(*key[:3]).orderBy("cell")).alias("c0"))
    same = lambda a, b, names: F.expr(" AND ".join(f"{a}.{x} <=> {b}.{x}" for x in names))
    starts = cells.alias("c").join(blocks.alias("b"), same("c", "b", key[:3])).select(
        *[F.col(f"c.{x}") for x in key], (F.col("b0") + F.col("c0")).alias("start"), "source_size", "target"
    )
    spots = placed.alias("d").join(starts.alias("s"), same("d", "s", key)).select("d.*", "start", "source_size", "target")
    inside = before(Window.partitionBy(*key).orderBy("size", "doc_id", "k1", "k2", "chunk"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    spots = materialise(spots.select("doc_id", "source", "size", "k1", "k2", "rows", "source_size", "target", each.alias("each"), (F.col("start") + inside).alias("first")))
    # Of DRAWS random offsets a source takes the one that brings its words nearest to its target.
    offsets = [F.pmod(F.xxhash64(F.lit(seed + i), "source"), F.lit(1 << 20)) / (1 << 20) for i in range(DRAWS)]
    taken = [F.sum(F.col("size") * _crossings(o)).alias(f"t{i}") for i, o in enumerate(offsets)]
    off = spots.groupBy("source", "target").agg(*taken)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("miss"), F.lit(i).alias("draw"), o.alias("offset")) for i, o in enumerate(offsets)]))
    off = off.select(F.col("source").alias("of"), best["offset"].alias("offset"))
    return spots.join(off, F.expr("source <=> of")).drop("of")


def _crossings(offset: Column) -> Column:
    """Integers that the summed-up copies of a chunk's rows cross."""
    upto = lambda rank: F.floor(rank * F.col("each") + offset)
    return upto(F.col("first") + F.col("rows")) - upto(F.col("first"))


def mix_copies(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    at_most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """Copies of each row that a mix to the target weights takes, by systematic sampling.

    Returns docs' doc_id, source, size, source_size, target and copies. Within a source every row expects
    target / source_size copies. Expected copies are summed up along the order (size class, hash block, hash cell,
    size, row key), one random offset per source is added, and a row is emitted once for each integer that its
    interval crosses. Sorting by size keeps the words taken near the target, and so does the choice of the offset: the best
    of DRAWS.

    The prefix is exact and split: rows per cell, cells per block and blocks per source are counted, summed
    up level by level, and only rows of one cell (about CELL_ROWS) are ever sorted together, so a source with a third
    of all rows is no hot group. Equal rows are counted first, and dealt to cells in chunks of CELL_ROWS, so a row that
    is repeated without end is none either. Offsets come from a hash of seed and source: reruns agree.

    Rows: a null or empty text has size 0 and takes no words. A null source is a source of its own, after all others.
    Rows repeated in docs each take part; which of some equal rows gets a copy more is without effect on the result. An
    empty table gives an empty result. Columns other than doc_id, text and source only tell rows apart.
    """
    dealt = _dealt(docs, weights, share, at_most, seed)
    each = dealt.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).withColumn("rank", F.col("first") + F.col("nth"))
    upto = lambda r: F.floor(r * F.col("each") + F.col("offset"))
    return each.select(
        "doc_id", "source", "size", "source_size", "target", F.least(upto(F.col("rank")) - upto(F.col("rank") - 1), F.lit(int(-(-at_most // 1)))).cast("long").alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, at_most: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixed table: docs' rows and columns, whatever their names and types, each row as often as mix_copies takes it.

    Of rows that are equal in all columns one goes on, as often as all of them are taken together.
    """
    picked = _dealt(docs, weights, share, at_most, seed).withColumn("copies", _crossings(F.col("offset"))).where("copies > 0")
    picked = picked.groupBy(F.col("k1").alias("p1"), F.col("k2").alias("p2")).agg(F.sum("copies").alias("copies"))
    first = Window.partitionBy("k1", "k2").orderBy("k1")
    rows = _keyed(docs).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    rows = rows.join(picked, F.expr("k1 = p1 AND k2 = p2"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / CELL_ROWS).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CELL_ROWS).cast("long"), F.col("copies") - F.col("part") * CELL_ROWS))))
    return rows.select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of the whole table: what the mix takes of it."""
    return mix_copies(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source"
    )
