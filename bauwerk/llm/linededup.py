"""Operator 3: line dedup over windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialise

WINDOW = 3
#: What counts as blank at the ends of a line.
BLANKS = " \t\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(size: int) -> str:
    """Per start of a window: its position and two hashes, each over hashes of its lines by another seed; windows of blank
    lines only are left out."""
    at, again = (", ".join(f"{h}[i + {k}]" for k in range(size)) for h in "hg")
    blank = " AND ".join(f"z[i + {k}]" for k in range(size))
    return (
        f"CASE WHEN size(h) >= {size} THEN filter(transform(sequence(0, size(h) - {size}), i -> "
        f"IF({blank}, NULL, struct(i AS pos, xxhash64({at}) AS w1, xxhash64(7, {again}) AS w2))), x -> x IS NOT NULL) END"
    )


def later_occurrences(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Positions of windows that occurred before, per row key: (_k1, _k2, starts array<int>)."""
    keyed = docs.where("text IS NOT NULL").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("_k2"),
        F.transform(lines_of(F.col("text")), lambda x: F.trim(x, F.lit(BLANKS))).alias("ls"),
    )
    keyed = keyed.where(F.size("ls") >= size).select(
        "doc_id", "_k1", "_k2", F.transform("ls", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("ls", lambda x: F.xxhash64(F.lit(7), x)).alias("g"), F.transform("ls", lambda x: x == "").alias("z")
    )
    rows = keyed.select("doc_id", "_k1", "_k2", F.explode(F.expr(_windows(size))).alias("w")).select(
        F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2", F.col("w.pos").alias("pos")).alias("at"),
        F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"),
    )
    rows = materialise(rows)
    # Copies of one row have one place, so count places, not rows: max > min tells that there are two at least.
    firsts = rows.groupBy("w1", "w2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    later = rows.join(firsts, ["w1", "w2"]).where("at > first")
    return later.groupBy("at._k1", "at._k2").agg(F.collect_set("at.pos").alias("starts"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents without the passages that stood in an earlier document or earlier in the same one.

    Every ``size`` consecutive lines are a window; lines compare without blanks at their ends, and windows of blank
    lines only don't count. A window's first occurrence is the one with the smallest (doc_id, row hash,
    position), null ids last; all others are covered. Covered windows of a document are merged, and each line
    in one of them is removed; other lines stay as they are, in order. Returns docs' columns with the new text, and
    n_lines and n_removed (names that docs has already are kept and these two then left out).

    A null text stays null with 0 lines; an empty text has one line. Texts of fewer than ``size`` lines stay whole.
    Rows that repeat an earlier row's doc_id and text are the same document and get the same result. An empty table gives
    an empty one. Columns keep their values, whatever their names and types.
    Frequent passages: occurrences are counted by a partially aggregated groupBy and joined back by a join
    that AQE can split, so no window's occurrences meet in one task; a document's own positions do.
    """
    found = later_occurrences(docs, size).select(F.col("_k1").alias("f1"), F.col("_k2").alias("f2"), "starts")
    names = docs.columns
    row = F.col("row")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("d2"))
    joined = keyed.join(found, F.expr("d1 = f1 AND d2 = f2"), "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1)))))
    joined = joined.select("row", lines_of(row["text"]).alias("lines"), F.coalesce(F.array_sort(covered), F.array().cast("array<int>")).alias("gone"))
    # Kept stretches lie between covered ones: slices, so that work stays linear in the lines of a document.
    joined = joined.withColumn("edges", F.expr("concat(array(-1), gone, array(size(lines)))"))
    kept = F.expr(
        "flatten(filter(transform(sequence(0, size(edges) - 2), i -> "
        "slice(lines, edges[i] + 2, edges[i + 1] - edges[i] - 1)), x -> size(x) > 0))"
    )
    text = F.when(F.size("gone") == 0, row["text"]).otherwise(F.array_join(kept, "\n"))
    extra = {"n_lines": F.when(row["text"].isNull(), 0).otherwise(F.size("lines")), "n_removed": F.size("gone")}
    return joined.select(
        *[(text if x == "text" else row.getField(x)).alias(x) for x in names],
        *[c.cast("long").alias(x) for x, c in extra.items() if x not in names],
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup and its numbers of lines and removed lines."""
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


OP3_SQL = """
WITH line AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), win AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS a,
    lead(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1) OVER w AS b,
    lead(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 2) OVER w AS c
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
  FROM win WHERE c IS NOT NULL AND NOT (a = '' AND b = '' AND c = '')
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), done AS (
  SELECT line.doc_id, string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY line.pos) AS text,
    count(*) AS n_lines, count(gone.pos) AS n_removed
  FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.pos = gone.pos GROUP BY line.doc_id
)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM done
UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL
"""
