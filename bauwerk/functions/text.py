"""Text expressions: Column in, Column out, all of them inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Unicode white space, as a class for trimming.
_SPACE = r"(?U)^\s+|\s+\z"


def normalize(c: Column) -> Column:
    """White space, no-break spaces included, to single blanks; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends; SQL's trim knows blanks only."""
    return F.regexp_replace(c, _SPACE, "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def pages(c: Column) -> Column:
    return F.split(c, "\f", -1)


def text_lines(c: Column) -> Column:
    """Lines without their ends; a last line end opens no further line."""
    return without_last_end(F.split(c, "\r?\n", -1))


def without_last_end(cut: Column) -> Column:
    """Lines without the empty one after a last line end."""
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return any_of([c.startswith(p) for p in prefixes])


def contains_any(c: Column, phrases: list[str]) -> Column:
    return any_of([c.contains(p) for p in phrases])


def _either(phrases: list[str]) -> str:
    """One pattern for plain phrases: a test of each would work out what it looks at anew."""
    return "|".join(re.escape(p) for p in phrases)


def is_noise(line: Column) -> Column:
    """Page furniture of the main parser."""
    return (line == "") | line.rlike(P.FOOTER) | starts_with_any(line, P.NOISE_PREFIXES)


def is_placeholder_noise(line: Column) -> Column:
    """Page furniture of the placeholder parser, whose list is another."""
    return (line == "") | starts_with_any(line, P.PLACEHOLDER_NOISE_PREFIXES)


def is_layout_noise(c: Column) -> Column:
    return strip(c).isin([*P.CONTINUATIONS, P.OPTIONAL]) | c.startswith(P.LAYOUT_NOISE_PREFIX)


def is_price_line(c: Column) -> Column:
    return c.contains("€") | F.lower(c).contains(P.PRICE_ONLY.lower()) | c.rlike(P.LAYOUT_PRICE.replace("^", r"^\s*"))


def is_reference_text(c: Column) -> Column:
    return F.lower(c).rlike(rf"(?U)^\s*(?:{_either(P.REFERENCE_PREFIXES)})")


def is_short_text_candidate(c: Column) -> Column:
    return ~is_blank(c) & ~is_reference_text(c) & ~is_price_line(c) & ~is_layout_noise(c)


def is_sum_artifact(c: Column) -> Column:
    return F.lower(c).rlike(rf"(?U)^\s*summe|{_either(P.SUM_PHRASES)}")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_omitted(short: Column, long: Column) -> Column:
    """Some line says that the position is omitted; case of A-Z doesn't matter, that of umlauts does."""
    every = F.concat(text_lines(F.coalesce(short, F.lit(""))), text_lines(F.coalesce(long, F.lit(""))))
    return F.exists(every, lambda x: (F.length(x) >= len(P.OMITTED)) & (ascii_lower(strip(x)) == ascii_lower(F.lit(P.OMITTED))))


def is_omitted_strictly(short: Column, long: Column) -> Column:
    """The first validation's narrower test: the short text as a whole, or a line of the long text as it is."""
    return (short == P.OMITTED) | F.exists(text_lines(long), lambda x: x == P.OMITTED)


def joined(short: Column, long: Column) -> Column:
    """Short and long text without blank ends, those that are empty left out."""
    return F.concat_ws("\n", F.nullif(strip(short), F.lit("")), F.nullif(strip(long), F.lit("")))


def clean_title(c: Column) -> Column:
    """Without amounts at the end, however many there are."""
    bare = strip(c)
    return F.when(bare.rlike(P.TRAILING_TOTALS), strip(F.regexp_replace(bare, P.TRAILING_TOTALS, ""))).otherwise(bare)


def tail(c: Column) -> Column:
    """The last TAIL characters, lower-cased, without white space at the end."""
    return F.regexp_replace(F.lower(F.right(c, F.lit(P.TAIL))), r"(?U)\s+\z", "")


def attribute(attrs: Column, name: str) -> Column:
    """Value of the first name="..." or else name='...'; null where there is none. By places of quotes, as a pattern takes several times that:
    where the first name=" isn't closed, no other one is."""

    def quoted(quote: str) -> tuple[Column, Column]:
        given = F.instr(attrs, f"{name}={quote}")
        rest = F.substr(attrs, given + len(name) + 2)
        return given > 0, F.when(F.contains(rest, F.lit(quote)), F.substring_index(rest, quote, 1))

    (has_double, double), (has_single, single) = quoted('"'), quoted("'")
    return F.when(has_double, double).when(has_single, single)


def number_attribute(attrs: Column, name: str, default: int | None = 0) -> Column:
    value = F.expr("try_cast(null as int)") if default is None else F.lit(default)
    return F.coalesce(number(attribute(attrs, name)), value)


def number(found: Column) -> Column:
    """A whole number as it is written in an attribute; null where it isn't one."""
    return F.when(found.rlike(r"^[+-]?[0-9]{1,10}\z"), found.try_cast("int"))


_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def unescape(c: Column) -> Column:
    """XML's named entities and numeric ones; a text with any other & stays as it is."""
    parts = F.split(F.regexp_replace(c, r"(&#?[A-Za-z0-9]+;)", "\u0000$1\u0000"), "\u0000", -1)

    def one(x: Column) -> Column:
        out = F.when(x.rlike(r"^&#[xX][0-9A-Fa-f]{1,6};\z"), _char(F.conv(F.regexp_extract(x, r"^&#[xX]([0-9A-Fa-f]+);\z", 1), 16, 10)))
        out = out.when(x.rlike(r"^&#[0-9]{1,7};\z"), _char(F.regexp_extract(x, r"^&#([0-9]+);\z", 1)))
        for entity, char in _ENTITIES.items():
            out = out.when(x == entity, F.lit(char))
        return out.otherwise(x)

    wrong = F.exists(parts, lambda x: x.contains("&") & ~x.rlike(r"^&(?:lt|gt|quot|apos|amp|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});\z"))
    return F.when(~c.contains("&") | wrong, c).otherwise(F.array_join(F.transform(parts, one), ""))


def _char(code: Column) -> Column:
    """The character of a code point; char() ends at 255, so build its UTF-8 bytes."""
    n = code.try_cast("int")
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    low = lambda shift: F.lit(128) + F.shiftright(n, shift).bitwiseAND(63)
    utf8 = (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(F.lit(0xC0) + F.shiftright(n, 6)), byte(low(0))))
        .when(n < 0x10000, F.concat(byte(F.lit(0xE0) + F.shiftright(n, 12)), byte(low(6)), byte(low(0))))
        .otherwise(F.concat(byte(F.lit(0xF0) + F.shiftright(n, 18)), byte(low(12)), byte(low(6)), byte(low(0))))
    )
    return F.decode(F.unhex(utf8), "UTF-8")


def bare(body: Column) -> Column:
    """A layout fragment without tags and with plain blanks."""
    return F.replace(F.regexp_replace(body, "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" "))


def fragment_text(body: Column) -> Column:
    """Text of a layout fragment: tags gone, entities resolved."""
    return unescape(bare(body))


def escape(c: Column) -> Column:
    """For XML text and attributes."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def oz_key(oz: Column) -> Column:
    """Numbers of an OZ, to sort by; parts that are no numbers come last."""
    parts = F.split(oz, "[.]", -1)
    odd = F.transform(parts, lambda x: F.coalesce(F.when(x.rlike("^[+]?[0-9]+\\z"), x.try_cast("bigint")), F.lit(4294967295)))
    return F.when(oz.rlike(r"^[0-9]{1,9}(?:[.][0-9]{1,9})*\z"), parts.cast("array<bigint>")).otherwise(odd)


def oz_prefix(oz: Column, parts: int | Column) -> Column:
    return F.call_function("substring_index", oz, F.lit("."), F.lit(parts) if isinstance(parts, int) else parts)


def last_part(oz: Column) -> Column:
    return F.element_at(F.split(oz, "[.]", -1), -1)
