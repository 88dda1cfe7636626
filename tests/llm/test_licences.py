import re

import pytest

from bauwerk.llm import licences as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORDS.findall((text or "").translate(LOWER))
    at = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", " \n", "CC BY cc by", "cc  by-cc\nby", "ccby cc", "All Rights Reserved all-rights_reserved", "GENERAL public LICENSE",
    "Licensed under CC BY-NC 4.0.", "é cc by é", "cc by" * 3, "the GNU Lesser General Public License all rights reserved", "x " * 50_000 + "all rights reserved", "İ cc by   cc by",
]


def test_base_columns_against_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", "y"), (None, "cc by", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, found string").repartition(3)
    got = L.scan(docs).collect()
    assert len(got) == len(rows)
    expected = sorted(map(str, [(i, *brute(t)) for i, t, *_ in rows]))
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got])) == expected
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels)
    assert L.scan(docs.where("false")).count() == 0


def one(text):
    return L.scan_text(text.encode(), L.automaton())


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", {"mit"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND LicenseRef-x\n", {"mit", "apache", "other"}),
        ('"license": "BSD-3-Clause",', {"bsd"}),
        ("license: see below", set()),
        ("the license of the driver", set()),
        ("GNU Affero General Public License", {"agpl"}),
    ],
)
def test_labels_of_the_method(text, labels):
    assert set(one(text).sure) == labels


def test_places_are_those_of_the_text():
    text = "É – Licensed under  CC-BY (nc)."
    (found,) = one(text).found
    assert text[found.start : found.end] == "CC-BY (nc" and found.word == 4  # the dash is no ASCII, so a word


@pytest.mark.parametrize(
    "text, order",
    [
        ("MIT", ["MIT"]),
        ("A or B and C with D", ["A", "B", "C", "D", "with", "and", "or"]),
        ("(A or B) and C", ["A", "B", "or", "C", "and"]),
        ("A and B and C", ["A", "B", "and", "C", "and"]),
        ("A or", ["A"]),
        ("A and (B or C", ["A"]),
        ("((A)) */", ["A"]),
        ("or A", []),
        (")", []),
        ("A B", ["A"]),
        ("GPL-2.0+ WITH Classpath-exception-2.0, and more", ["GPL-2.0+", "Classpath-exception-2.0", "with"]),
    ],
)
def test_shunting_yard(text, order):
    assert L.postfix(L.tokens(text, 0)) == order


def test_expressions_say_what_they_ask():
    duty = lambda text: L.evaluate(L.postfix(L.tokens(text, 0)))
    assert duty("MIT OR GPL-3.0-only").duty == L.PERMISSIVE
    assert duty("MIT AND GPL-3.0-only").duty == L.STRONG
    assert duty("GPL-2.0-only WITH Classpath-exception-2.0").duty == L.WEAK
    assert duty("(MIT or foo) and cc-by-nc-4.0").duty == L.RESTRICTED
    assert duty("(a or mit) and (b)").text == "(a OR mit) AND b"
    deep = "(" * 2_000 + "MIT" + ")" * 2_000
    assert duty(deep).labels == ["mit"]


def test_notices_that_are_joined():
    (made,) = one("under the terms of the Apache License, Version 2.0 or the MIT License, and nothing else").expressions
    assert (made.text, made.labels, made.duty) == ("apache OR mit", ["apache", "mit"], L.PERMISSIVE)
    assert one("the MIT license. Some other text that is long or the Apache License").expressions == []


def test_families():
    names = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "LGPL-2.1+", "BSD-2-Clause", "CC-BY-SA-4.0", "CC0-1.0", "0BSD", "AGPL-3.0", "foo-1.0", "MPL-2.0-no-copyleft-exception"]
    assert [L.family(x) for x in names] == ["mit", "apache", "gpl", "lgpl", "bsd", "cc-by-sa", "cc0", "bsd", "agpl", None, "mpl"]
