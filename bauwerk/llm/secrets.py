"""Operator 6: secret scans by token efficiency, beside fixed patterns."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import Vocabulary, load_vocabulary
from .shared import documents

#: The base patterns with the group that counts and its least length, in the order that ranks kinds.
BASE = {
    "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: The kind that the token-efficiency test adds.
ADDED = "random"
KINDS = [*BASE, ADDED]

#: Least length of a key.
LEAST = 16
#: Runs that may be a key: no blanks, none of the marks that end one. A full stop ends a run, so the parts of a dotted
#: string are runs of their own. An @ ends a run, too: what counts there is said by PASSWORD.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}(?![A-Za-z0-9+/_=-])" % LEAST)
#: What stands before a run that an @ follows, if the run is a password or token of an address (name:run@host, scheme://run@host)
#: and not the name of a mailbox.
PASSWORD = re.compile(r"(?<![A-Za-z])(?!(?i:mailto|mail|e-mail|email|xmpp|sip|sips):\Z)[^\s:@]*:\Z")
#: What is no key by the way it goes on after its first part: host names in small letters, file names, mail addresses.
NAMED = re.compile(
    r"(?:[a-z0-9-]+(?:\.[a-z0-9-]+){0,8}\.(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|dev|app|cloud|example|test|local|internal|invalid)(?![A-Za-z0-9+_=-]|\.[A-Za-z0-9])"
    r"|[A-Za-z0-9+_=-]+(?:\.[A-Za-z0-9_-]+){0,8}\.(?:pdf|txt|csv|tsv|json|xml|ya?ml|html?|md|docx?|xlsx?|pptx?|jpe?g|png|gif|svg|webp|mp[34]|js|mjs|css|map|py|java|sh|sql|log|parquet|zip|gz|tar|whl|jar|exe|dll|so|bin)(?![A-Za-z0-9+_=-]|\.[A-Za-z0-9])"
    r"|[A-Za-z0-9+_=-]+(?:\.[A-Za-z0-9+_-]+){1,8}@)"
)
#: Known digests and identifiers, which are random without being secret: hex digests of the usual lengths, UUIDs,
#: plain numbers, and names joined by marks from short parts of letters or digits alone.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"
    r"|[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|[0-9_+/=-]+|(?:[A-Za-z]{1,15}|[0-9]+)(?:[_/=+-]+(?:[A-Za-z]{1,15}|[0-9]+))*[_/=+-]*)\Z"
)
#: At most so many characters a token: prose has about four, random strings of base64 or hex about two or less.
RATIO = 2.3
#: Runs without a digit must change between capital and small letters so often, and have fewer characters a token: long
#: words of rare languages have few characters a token, too, but they are of one case.
CHANGES, LETTERS_RATIO = 4, 2.0
_CHANGE = re.compile(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches, leftmost and non-overlapping within a kind."""
    return [(m.start(), m.end(), kind) for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if len(m.group(group)) >= least]


def is_random(run: str, vocabulary: Vocabulary, ratio: float, changes: int = CHANGES) -> bool:
    """Few characters a token, letters, digits or many changes of case, and no known form."""
    if not re.search(r"[A-Za-z]", run) or KNOWN.match(run):
        return False
    if not re.search(r"[0-9]", run):
        if len(_CHANGE.findall(run)) < changes:
            return False
        ratio = min(ratio, LETTERS_RATIO)
    return len(run) <= ratio * sum(len(vocabulary.encode_piece(piece.encode())) for piece in vocabulary.split(run))


def random_spans(text: str, vocabulary: Vocabulary, ratio: float = RATIO, changes: int = CHANGES) -> list[tuple[int, int, str]]:
    """Runs with few characters a token. A run needs letters, digits or many changes of case, and no known form.

    After a full stop, plain names up to a slash (the rest of a host name, folders) don't count to the run, and a last
    part that begins a host or file name (NAMED) doesn't either. Where a run with slashes isn't random as a whole, as paths
    aren't, its parts are tested. A run right before an @ counts where PASSWORD fits what is before it; otherwise it names a mailbox.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if text[end : end + 1] == "@":
            if not PASSWORD.search(text[max(0, start - 80) : start]):
                continue
            while start < end and text[start] == "/":
                start += 1
        if text[end : end + 1] == ".":
            last = max(start, text.rfind("/", start, end) + 1)
            if NAMED.match(text, last):
                end = max(start, last - 1)
        if text[start - 1 : start] == ".":
            while (cut := text.find("/", start, end)) >= 0 and (cut == start or KNOWN.match(text[start:cut])):
                start = cut + 1
        if end - start < LEAST:
            continue
        if is_random(text[start:end], vocabulary, ratio, changes):
            found.append((start, end, ADDED))
            continue
        for part in text[start:end].split("/") if "/" in text[start:end] else []:
            if len(part) >= LEAST and is_random(part, vocabulary, ratio, changes):
                found.append((start, start + len(part), ADDED))
            start += len(part) + 1
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, vocabulary: Vocabulary | None = None, ratio: float = RATIO, changes: int = CHANGES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found) of every row.

    spans joins kind:start:end of all spans by start, then kind; offsets are code points, ends exclusive. Spans of the
    token-efficiency test that lie inside a base span are left out, as that secret is reported already. found is the
    same as an array of (kind, start, end). A null text counts as empty: no spans. Every row is scanned by itself, in
    one pass without shuffle; repeated rows give a row each; texts are scanned whole; other columns don't matter. Where kinds
    begin at one place, the order of KINDS decides. An empty table gives an empty result. Letters alone count with ``changes``
    changes of case; 0 also takes keys of one case, and then rare long words with them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())
    key = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {key}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind: string, start: int, end: int>>"
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            counts, digests, spans, found = [[], [], []], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = [s for s in random_spans(text, shared.value, ratio, changes) if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
                for at, kind in zip(counts, BASE):
                    at.append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(found, pa.list_(struct))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return scan(documents(spark, sf_dir)).drop("found")
