"""Decimal expressions. Rounding is half-even throughout, so bround and never round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

CENT = "decimal(18,2)"
TOLERANCE = "0.02"


def german_decimal(c: Column, scale: int = 2) -> Column:
    """1.234,50 as a decimal; null where it is none."""
    plain = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast(f"decimal(18,{scale})")


def german(c: Column, scale: int = 2) -> Column:
    """A decimal of that scale as 1.234,50. Usual ones are put together from their digits, as format_number takes several times that."""
    text = F.replace(c.cast("string"), F.lit("."), F.lit(","))
    whole = F.length(text) - scale - 1
    split = F.concat(F.substr(text, F.lit(1), whole - 3), F.lit("."), F.substr(text, whole - 2))
    return F.when((c >= 0) & (whole <= 3), text).when((c >= 0) & (whole <= 6), split).otherwise(F.translate(F.format_number(c.cast("double"), scale), ",.", ".,"))


def padded(c: Column, width: int) -> Column:
    """A whole number with zeros before it, if it has fewer digits."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def money(c: Column) -> Column:
    return F.bround(c, 2).cast("decimal(38,2)")


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(TOLERANCE).cast("decimal(3,2)")


def plain(c: Column) -> Column:
    """A decimal's text without zeros at the end of its fraction."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"([.][0-9]*?)0+$", "$1"), r"[.]$", "")


def decimal_text(c: Column) -> Column:
    return plain(F.bround(c, 2))


def last_amount(line: Column) -> Column:
    """The last amount of money in a line."""
    found = F.try_element_at(F.regexp_extract_all(line, F.lit(P.AMOUNT), F.lit(0)), F.lit(-1))
    return german_decimal(F.regexp_replace(found, r"(?U)\s*(?:€|EUR)\z", ""))


def expected_total(quantity: Column, unit_price: Column, total_price: Column) -> Column:
    return F.coalesce(money(total_price), money(quantity * unit_price))
