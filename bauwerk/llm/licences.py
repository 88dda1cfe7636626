"""Operator 11: licence scans. An Aho-Corasick automaton finds phrases and identifier tags in a text's words; a shunting-yard
parser reads the and/or/with expressions that follow a tag or that join notices."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import arrow_type
from .shared import documents

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: How much a licence asks of who uses the text: nothing but a notice, the same terms for changes, the same terms for all that is made
#: with it, or no use without leave.
PERMISSIVE, WEAK, STRONG, RESTRICTED = range(4)

# Families of licences, by the beginning of their public identifiers, and what they ask.
FAMILIES = {
    "mit": PERMISSIVE, "apache": PERMISSIVE, "bsd": PERMISSIVE, "isc": PERMISSIVE, "zlib": PERMISSIVE, "bsl": PERMISSIVE,
    "unlicense": PERMISSIVE, "cc0": PERMISSIVE, "wtfpl": PERMISSIVE, "psf": PERMISSIVE, "python": PERMISSIVE, "postgresql": PERMISSIVE,
    "artistic": PERMISSIVE, "ncsa": PERMISSIVE, "ofl": PERMISSIVE, "cc-by": PERMISSIVE, "odc-by": PERMISSIVE, "pddl": PERMISSIVE,
    "lgpl": WEAK, "mpl": WEAK, "epl": WEAK, "cddl": WEAK, "eupl": WEAK, "ms-pl": PERMISSIVE, "ms-rl": WEAK,
    "gpl": STRONG, "agpl": STRONG, "cc-by-sa": STRONG, "odbl": STRONG, "gfdl": STRONG, "osl": STRONG,
    "cc-by-nc": RESTRICTED, "cc-by-nd": RESTRICTED, "cc-by-nc-sa": RESTRICTED, "cc-by-nc-nd": RESTRICTED, "sspl": RESTRICTED,
    "busl": RESTRICTED, "elastic": RESTRICTED, "reserved": RESTRICTED, "public-domain": PERMISSIVE,
}

# Words of notices, and the family that each names.
NOTICES = {
    "mit license": "mit", "mit licence": "mit", "permission is hereby granted free of charge": "mit",
    "apache license": "apache", "apache licence": "apache", "apache 2 0": "apache",
    "bsd license": "bsd", "bsd licence": "bsd", "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl", "the unlicense": "unlicense", "artistic license": "artistic",
    "open font license": "ofl", "python software foundation license": "psf", "mozilla public license": "mpl", "eclipse public license": "epl",
    "european union public licence": "eupl", "common development and distribution license": "cddl", "lesser general public license": "lgpl",
    "library general public license": "lgpl", "affero general public license": "agpl", "general public licence": "gpl", "gnu gpl": "gpl",
    "gnu lgpl": "lgpl", "gnu agpl": "agpl", "free documentation license": "gfdl", "open database license": "odbl",
    "server side public license": "sspl", "business source license": "busl", "elastic license": "elastic",
    "cc0": "cc0", "cc zero": "cc0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa", "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "dedicated to the public domain": "public-domain", "released into the public domain": "public-domain", "in the public domain": "public-domain",
}

# Tags that an expression follows; the first two name nothing else, so that unknown identifiers count there.
TAGS = ["spdx license identifier", "license expression", "license", "licence"]
SURE_TAGS = TAGS[:2]
# Words that say that what follows is granted.
GRANTS = ["licensed under", "licenced under", "released under", "distributed under", "available under", "published under", "under the terms of"]
# Words between notices of one expression.
CONNECTIVES, FILLERS = ["and", "or", "with"], ["a", "an", "the", "either", "both", "gnu", "license", "licence", "version", "v2", "v3", "later", "clause", "exception"]

#: Words back from a notice in which a grant makes it surer; words between two notices that an expression may join.
GRANT_WORDS, JOIN_WORDS = 6, 8
#: How sure a label is by where it comes from: an expression after a tag, a notice that is granted, one that stands alone.
SURENESS = {"tag": 0.98, "granted": 0.95, "notice": 0.8}
UNKNOWN = "other"

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_AFTER_TAG = re.compile(r"""["']?[ \t]*[:=][ \t]*["'\[]*""")
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9]+(?:[.+-]+[A-Za-z0-9]+)*\+?))")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


class Found(NamedTuple):
    """A place in a text: kind is base, notice or tag; words from 0, characters end-exclusive."""

    kind: str
    label: str
    word: int
    n_words: int
    start: int
    end: int


class Expression(NamedTuple):
    """text in plain form; labels of all licences in it; duty of the least demanding choice; word where it begins."""

    text: str
    labels: list[str]
    duty: int
    word: int


def automaton() -> ahocorasick.Automaton:
    """Finds phrases between blanks; a phrase's value is all that it stands for."""
    meanings: dict[str, list[tuple[str, str]]] = {}
    for kind, table in (("base", BASE), ("notice", BASE | NOTICES), ("tag", dict.fromkeys(TAGS, "")), ("grant", dict.fromkeys(GRANTS, ""))):
        for phrase, label in table.items():
            meanings.setdefault(phrase, []).append((kind, label))
    made = ahocorasick.Automaton()
    for phrase, what in meanings.items():
        made.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, what, phrase))
    made.make_automaton()
    return made


def family(identifier: str) -> str | None:
    """The family of a licence identifier: without its version and what follows; null if it isn't known."""
    low = identifier.lower().rstrip("+")
    if low in ("0bsd", "x11"):
        return "bsd" if low == "0bsd" else "mit"
    if low.startswith("cc0"):
        return "cc0"
    low = re.sub(r"(?:-?v?[0-9]+(?:[.][0-9]+)*(?:-.*)?|-only|-or-later|-license)$", "", low)
    return low if low in FAMILIES else None


def tokens(text: str, at: int) -> list[str]:
    """Tokens of the longest whole expression that begins here; none if there is none."""
    out, depth, operand, whole = [], 0, True, 0
    while m := _TOKEN.match(text, at):
        mark, name = m.groups()
        operator = (name or "").lower() in _STRENGTH
        if mark == "(" and operand:
            depth += 1
        elif mark == ")" and not operand and depth:
            depth -= 1
        elif name and operator and not operand:
            operand = True
        elif name and not operator and operand:
            operand = False
        else:
            break
        out.append(mark or name)
        at = m.end()
        if not operand and not depth:
            whole = len(out)
    return out[:whole]


def postfix(parts: list[str]) -> list[str]:
    """Shunting yard: with before and before or, each from the left."""
    out, waiting = [], []
    for part in parts:
        if (strength := _STRENGTH.get(part.lower())) is not None:
            while waiting and _STRENGTH.get(waiting[-1], 0) >= strength:
                out.append(waiting.pop())
            waiting.append(part.lower())
        elif part == "(":
            waiting.append(part)
        elif part == ")":
            while (top := waiting.pop()) != "(":
                out.append(top)
        else:
            out.append(part)
    return out + waiting[::-1]


def evaluate(order: list[str], word: int = 0) -> Expression:
    """What an expression in postfix order asks: of and the most demanding part, of or the least; an exception after with makes
    same terms for all that is made with a work the same terms for changes. Unknown licences ask for leave."""
    stack: list[tuple[str, int, frozenset[str], int]] = []  # text, strength of its weakest operator, labels, duty
    for part in order:
        if part not in _STRENGTH:
            known = family(part)
            stack.append((part, 4, frozenset([known or UNKNOWN]), FAMILIES.get(known, RESTRICTED)))
            continue
        right, left = stack.pop(), stack.pop()
        strength = _STRENGTH[part]
        texts = [x[0] if x[1] >= strength else f"({x[0]})" for x in (left, right)]
        if part == "with":
            labels, duty = left[2], WEAK if left[3] == STRONG else left[3]
        else:
            labels, duty = left[2] | right[2], (max if part == "and" else min)(left[3], right[3])
        stack.append((f" {part.upper()} ".join(texts), strength, labels, duty))
    text, _, labels, duty = stack.pop()
    return Expression(text, sorted(labels), duty, word)


def _joined(notices: list[Found], words: list[bytes]) -> Iterator[Expression]:
    """Expressions of notices that and, or or with joins."""
    chain: list[str] = []
    for k, one in enumerate(notices):
        chain = chain or [one.label]
        link = None
        if k + 1 < len(notices):
            between = [w.decode(errors="replace") for w in words[one.word + one.n_words : min(notices[k + 1].word, one.word + one.n_words + JOIN_WORDS + 1)]]
            if len(between) <= JOIN_WORDS and all(w in CONNECTIVES or w in FILLERS or w.isdigit() for w in between):
                link = next((w for w in reversed(between) if w in CONNECTIVES), None)
        if link:
            chain += [link, notices[k + 1].label]
        elif len(chain) > 1:
            yield evaluate(postfix(chain), notices[k - len(chain) // 2].word)
            chain = []
        else:
            chain = []


class Scan(NamedTuple):
    n_words: int
    places: list[Found]  # of base phrases
    found: list[Found]  # of the method
    expressions: list[Expression]
    sure: dict[str, float]  # by label

    @property
    def score(self) -> float:
        return 1.0 - math.prod(1.0 - p for p in self.sure.values())


def scan_text(data: bytes, phrases: ahocorasick.Automaton) -> Scan:
    """Everything about licences in a text in UTF-8."""
    words = data.translate(_LETTERS).split()
    line = f" {b' '.join(words).decode()} "
    hits, at, seen = [], 0, 0
    for last, (length, n, what, phrase) in phrases.iter(line):
        start = last - length + 1
        word = seen + line.count(" ", at, start) if start >= at else seen - line.count(" ", start, at)
        at, seen = start, word
        hits.append((word, n, what, phrase))
    if not hits:
        return Scan(len(words), [], [], [], {})
    text = data.decode()
    spans = [m.span() for m in _WORD.finditer(text)]
    placed = lambda kind, label, word, n: Found(kind, label, word, n, spans[word][0], spans[word + n - 1][1])
    of = lambda kind: sorted((word, -n, label) for word, n, what, _ in hits for k, label in what if k == kind)
    base = [placed("base", label, word, -n) for word, n, label in of("base")]
    notices, reach = [], 0
    for word, n, label in of("notice"):  # those within a longer one say nothing more
        if word - n > reach:
            notices.append(placed("notice", label, word, -n))
            reach = word - n
    expressions, tagged = [], []
    for word, n, phrase in sorted((w, n, p) for w, n, what, p in hits if any(k == "tag" for k, _ in what)):
        after = _AFTER_TAG.match(text, spans[word + n - 1][1])
        parts = tokens(text, after.end()) if after else []
        if not parts:
            continue
        made = evaluate(postfix(parts), word)
        if UNKNOWN in made.labels and phrase not in SURE_TAGS:
            continue
        expressions.append(made)
        tagged += [placed("tag", label, word, n) for label in made.labels]
    grants = [word + n for word, n, what, _ in hits if any(k == "grant" for k, _ in what)]
    sure: dict[str, float] = {}
    k = 0
    for one in notices:
        while k + 1 < len(grants) and grants[k + 1] <= one.word:
            k += 1
        near = bool(grants) and 0 <= one.word - grants[k] <= GRANT_WORDS
        sure[one.label] = max(sure.get(one.label, 0.0), SURENESS["granted" if near else "notice"])
    for one in tagged:
        sure[one.label] = SURENESS["tag"]
    expressions += _joined(notices, words)
    return Scan(len(words), base, sorted(notices + tagged, key=lambda f: (f.word, f.kind, f.label)), sorted(expressions, key=lambda e: (e.word, e.text)), sure)


_FOUND = pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_EXPRESSION = pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("duty", pa.int32()), ("word", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found, expressions) of every row.

    n_base counts all places of the base phrases, also overlapping ones; first_word and last_word are where the first and last
    begin, null without any. labels has base_labels and what notices and tags name; of notices one within a longer
    one doesn't count. After a tag the longest whole expression is read, up to the first token that doesn't fit; the identifiers'
    families are labels, ``other`` where a sure tag has an unknown one; other tags with unknown identifiers are prose.
    score is the chance that a label is right, labels taken as independent. found lists places, expressions the parsed ones with
    their duty. Ties (phrases at one place): the longer first, then by label.

    Null and empty texts have no words, no labels ('') and score 0. Texts are scanned whole, every row by itself, in one pass
    without shuffle; repeated rows give a row each. An empty table gives an empty one. Other columns don't matter.
    """
    key = docs.schema["doc_id"].dataType
    key_arrow = arrow_type(key)
    schema = (
        f"doc_id {key.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "found array<struct<kind: string, label: string, word: long, n_words: long, start: long, end: long>>, expressions array<struct<text: string, labels: array<string>, duty: int, word: long>>"
    )
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found", "expressions"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_FOUND), pa.list_(_EXPRESSION)]

    def run(batches):
        phrases = automaton()
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                s = scan_text(cell.as_py() or b"", phrases)
                marked = {f.label for f in s.places}
                rows.append((
                    s.n_words, len(s.places), s.places[0].word if s.places else None, s.places[-1].word if s.places else None, ",".join(sorted(marked)), ",".join(sorted(marked | set(s.sure))), s.score,
                    [f._asdict() for f in s.places + s.found], [e._asdict() for e in s.expressions],
                ))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_arrow), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=names)

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base phrases and licence labels."""
    return scan(documents(spark, sf_dir)).drop("found", "expressions")
