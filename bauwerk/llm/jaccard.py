"""Operator 2: n-gram Jaccard join with prefix filters under several global token orders.

Plan, in one scan of the texts:

1. Each text becomes a set of hashed shingles. Each block of documents sends out the sets that differ, packed:
   tokens by bucket, with the number of their set in a list of names that the row brings along, so the big shuffle
   takes about eight bytes a shingle, and copies inside a block travel once.
2. A bucket counts in how many different sets each of its tokens occurs. Tokens of one set only can't be shared:
   they stay there. Shared ones go back to their sets, with their frequency class.
3. Order the tokens of a set by frequency, ties by hash. Two sets of Jaccard similarity t or more share a token in
   their first n - ceil(t n) + 1 tokens, and behind the first one they share, both have room left for the overlap that
   t asks for. Tokens of one set come first, so most sets have no shared token in their prefix and leave here. The
   order of ties is free: one order serves for candidates, further orders, with other hashes, are intersected with
   it, pair by pair, before tokens are looked at and the overlap is counted.
4. Links are only needed as far as they join components. Of each token's members the one whose tokens are most frequent,
   which is what near copies have in common, is the pivot that all others are held against. A token whose members
   are one component then is done. Where some are outside of the largest component, these, and only these, are held
   against the others, in bands of set sizes that can link. So a group of near copies costs a few candidates a member, and
   the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import arrow_type
from .shared import components, documents, materialise, partitions_for

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
ORDERS = 3
#: Characters of a block and words whose hashes a task remembers: with a bucket, what bounds its memory.
BLOCK_CHARS, REMEMBERED = 8_000_000, 300_000
#: Pivot rounds at most before what is left is compared outright, and how many of these comparisons a row may be worth
#: before another round is taken instead. Neither changes the result.
ROUNDS = 4
PAIRS_PER_ROW = 8
#: Bytes that are kept of a token's hash.
TOKEN = 6

_MIX = np.uint64(0x9E3779B97F4A7C15)
_squeeze = zstandard.ZstdCompressor(level=1)
_unsqueeze = zstandard.ZstdDecompressor()


def _scramble(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on all of them."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` word hashes, sorted; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = (h ^ words[i : n - k + 1 + i]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(_scramble(h))


#: Kinds of rows: a document, a set, tokens with their sets, tokens that go back to their sets.
DOC, SET, TOKENS, SHARED = 0, 1, 2, 3
#: check: of a document the hash of its text, of a set a second name. a to d: packed tokens, sets, set names and classes.
ROWS = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType())]
    + [T.StructField(x, T.LongType()) for x in ("set", "n", "check")]
    + [T.StructField(x, T.BinaryType()) for x in "abcd"]
)
ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _text_hash(text: bytes) -> int:
    """Spark's xxhash64 of a text."""
    return _signed(xxhash.xxh64_intdigest(text, seed=42))


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _squeeze.compress(planes.tobytes())


def _unpack(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(_unsqueeze.decompress(blob), np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return full.view("<u8").ravel()


def _incidence(tokens: np.ndarray, sets: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Packed tokens, and their sets as numbers into a list of names."""
    names, number = np.unique(sets, return_inverse=True)
    return _pack(tokens, TOKEN), _pack(number, 4), names.astype("<i8").tobytes()


def _members(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _unpack(a, TOKEN), np.frombuffer(c, "<i8")[_unpack(b, 4)]


def _batches(rows: list[tuple], key_type: pa.DataType, names: list[str]):
    for at in range(0, len(rows), 500):
        part = list(zip(*rows[at : at + 500]))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(part, [*ARROW, key_type])], names=names)


def _by(to: np.ndarray) -> list[np.ndarray]:
    """Places of equal values of ``to``, each in the order in which they stand."""
    order = np.argsort(to, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []


def _scan(docs: DataFrame, buckets: int, size: int, seed: int) -> DataFrame:
    """Documents, sets and packed tokens of all texts."""
    schema = T.StructType([*ROWS.fields, T.StructField("key", docs.schema[0].dataType)])
    key_type = arrow_type(docs.schema[0].dataType)

    def run(batches):
        cache: dict[bytes, int] = {}
        digest = xxhash.xxh3_64_intdigest
        held, names, seen, chars = [], [], {}, 0

        def flush():
            number = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
            tokens = np.concatenate(held)
            held.clear()
            tokens &= np.uint64((1 << 8 * TOKEN) - 1)
            order = np.argsort(tokens)
            tokens, number = tokens[order], number[order]
            bucket = (_scramble(tokens) % np.uint64(buckets)).astype(np.int32)
            sets = np.array(names, np.int64)
            return [(int(bucket[part[0]]), TOKENS, None, len(part), None, *_incidence(tokens[part], sets[number[part]]), None, None) for part in _by(bucket)]

        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                words = text.lower().split()
                if len(cache) > REMEMBERED:
                    cache.clear()
                known = cache.get
                hashes = np.fromiter([known(w) or cache.setdefault(w, digest(w)) for w in words], np.uint64, len(words))
                tokens = shingle_hashes(hashes, size)
                n = len(tokens)
                name = check = None
                if n:
                    both = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed=seed)
                    name, check = _signed(both >> 64), _signed(both & ((1 << 64) - 1))
                rows.append((int(digest(repr(key).encode()) % buckets), DOC, name, n, _text_hash(text), None, None, None, None, key))
                if n and seen.get(name) != check:
                    rows.append((name % buckets, SET, name, n, check, None, None, None, None, None))
                    if name not in seen:
                        held.append(tokens)
                        names.append(name)
                        chars += len(text)
                    seen[name] = check
                    if chars >= BLOCK_CHARS:
                        yield from _batches(flush(), key_type, schema.names)
                        names.clear(), seen.clear()
                        chars = 0
            yield from _batches(rows, key_type, schema.names)
        if held:
            yield from _batches(flush(), key_type, schema.names)

    return docs.mapInArrow(run, schema)


def _count(batches, buckets: int, key_type: pa.DataType, names: list[str]):
    """Tokens that more than one set has, back to these sets. Other rows pass through."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        if (kinds != TOKENS).any():
            yield batch.filter(pa.array(kinds != TOKENS))
        for i in np.flatnonzero(kinds == TOKENS).tolist():
            held.setdefault(batch.column(0)[i].as_py(), []).append(_members(*[batch.column(k)[i].as_py() for k in (5, 6, 7)]))
    for bucket in list(held):
        parts = held.pop(bucket)
        every, owners = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        # An eighth of the hashes at a time: what sorting takes is small beside the bucket itself.
        for slice_ in range(8):
            some = (every >> np.uint64(8 * TOKEN - 3)) == np.uint64(slice_)
            tokens, sets = every[some], owners[some]
            order = np.lexsort((sets, tokens))
            tokens, sets = tokens[order], sets[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
            tokens, sets = tokens[new], sets[new]
            if not len(tokens):
                continue
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            counts = np.diff(np.r_[starts, len(tokens)])
            df = np.repeat(counts, counts)
            keep = df > 1
            tokens, sets, df = tokens[keep], sets[keep], df[keep]
            # Frequency classes of an eighth of a power of two: finer ones don't order any better.
            classes = np.minimum(255, np.floor(np.log2(df) * 8)).astype(np.uint8)
            to = sets % buckets
            rows = [(int(to[part[0]]), SHARED, None, len(part), None, *_incidence(tokens[part], sets[part]), classes[part].tobytes(), None) for part in _by(to)]
            yield from _batches(rows, key_type, names)


SETS = T.StructType(
    [T.StructField("kind", T.IntegerType())]
    + [T.StructField(x, T.LongType()) for x in ("set", "n", "check", "rank")]
    + [T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("others", T.ArrayType(T.ArrayType(T.LongType())))]
)
_LONGS = pa.list_(pa.int64())
_SETS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), _LONGS, _LONGS, pa.list_(_LONGS)]
#: Two different sets of one name, which asks for other names.
CLASH = 4


def _set_batches(rows, key_type):
    for at in range(0, len(rows), 200):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 200]), [*_SETS, key_type])], names=[*SETS.names, "key"])


def _collect_sets(batches, percent: int, orders: int, key_type: pa.DataType):
    """Documents, and the sets that have shared tokens in their prefix: these tokens and the prefix in each order."""
    known: dict[int, tuple[int, int]] = {}
    tokens, sets, classes, clashes = [], [], [], []
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        docs = batch.filter(pa.array(kinds == DOC))
        if n := docs.num_rows:
            arrays = [pa.array([DOC] * n, pa.int32()), docs.column(2), docs.column(3), docs.column(4), *[pa.nulls(n, t) for t in _SETS[4:]], docs.column(9)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*SETS.names, "key"])
        own = batch.filter(pa.array(kinds == SET))
        for name, n, check in zip(*[own.column(k).to_pylist() for k in (2, 3, 4)]):
            if known.setdefault(name, (n, check)) != (n, check):
                clashes.append((CLASH, name, n, check, None, None, None, None, None))
        for i in np.flatnonzero(kinds == SHARED).tolist():
            got = _members(*[batch.column(k)[i].as_py() for k in (5, 6, 7)])
            tokens.append(got[0])
            sets.append(got[1])
            classes.append(np.frombuffer(batch.column(8)[i].as_py(), np.uint8))
    yield from _set_batches(clashes, key_type)
    if not tokens:
        return
    tokens, sets, classes = np.concatenate(tokens), np.concatenate(sets), np.concatenate(classes)
    order = np.argsort(sets, kind="stable")
    tokens, sets, classes = tokens[order], sets[order], classes[order]
    starts = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]])
    rows = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sets)]):
        name = int(sets[a])
        n, check = known[name]
        # One token more than the bound asks for makes up for two tokens of a set that agree in what is kept of them.
        prefix = n - -(-percent * n // 100) + 2 - (n - (b - a))
        if prefix <= 0:
            continue
        own = tokens[a:b]
        first, *others = [own[np.lexsort((_scramble(own + np.uint64(k << 50)), classes[a:b]))][:prefix].astype(np.int64) for k in range(orders)]
        rows.append((SET, name, n, check, int(classes[a:b].sum(dtype=np.int64)) * 1000 // n, own.astype(np.int64), first, others, None))
        if len(rows) == 200:
            yield from _set_batches(rows, key_type)
            rows = []
    yield from _set_batches(rows, key_type)


def shingle_sets(docs: DataFrame, size: int, percent: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """(key, set, n, text_hash) of all documents and (set, n, rank, tokens, prefix, others) of sets that may link, as written tables."""
    buckets = partitions_for(docs)
    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("text"))
    key = rows.schema[0]
    key_type = arrow_type(key.dataType)
    schema = T.StructType([*ROWS.fields, T.StructField("key", key.dataType)])
    names = schema.names
    seed = 0
    while True:
        counted = _scan(rows, buckets, size, seed).repartitionById(buckets, "bucket").mapInArrow(lambda b: _count(b, buckets, key_type, names), schema)
        whole = counted.repartitionById(buckets, "bucket").mapInArrow(
            lambda b: _collect_sets(b, percent, orders, key_type), T.StructType([*SETS.fields, T.StructField("key", key.dataType)])
        )
        table = materialise(whole)
        if table.where(f"kind = {CLASH}").isEmpty():
            break
        seed += 1  # two sets of one 64-bit name but of different second names: name all sets anew
    return table.where(f"kind = {DOC}").selectExpr("key", "set", "n", "check AS text_hash"), table.where(f"kind = {SET}").drop("kind", "key", "check")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """Those of pairs(a, b) that link. The prefixes under all orders must meet before tokens are joined and counted."""
    side = lambda x, *columns: sets.select(*[F.col(c).alias(f"{x}_{c}") for c in ("set", *columns)])
    both = pairs
    if orders > 1:
        both = both.join(side("b", "others"), F.expr("b = b_set")).join(side("a", "others"), F.expr("a = a_set"))
        for k in range(orders - 1):
            both = both.where(F.arrays_overlap(F.col("a_others")[k], F.col("b_others")[k]))
        both = both.select("a", "b")
    both = both.join(side("b", "n", "tokens"), F.expr("b = b_set")).join(side("a", "n", "tokens"), F.expr("a = a_set"))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(common * 100 >= (F.col("a_n") + F.col("b_n") - common) * percent).select("a", "b")


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(set, n, rank, pos, token) of the tokens that several sets have in their prefixes, one token for each group of sets.

    Near copies share dozens of prefix tokens, and these have the same members: tokens whose number of members and sums of
    two member hashes agree ask for the same pairs, so the one that comes first in the order is enough. pos is the
    token's place among all tokens of the set.
    """
    place = F.col("n") - F.size("tokens")  # tokens of one set only come before
    tokens = sets.select("set", "n", "rank", place.alias("alone"), F.posexplode("prefix").alias("at", "token"))
    tokens = tokens.select("set", "n", "rank", (F.col("alone") + F.col("at")).alias("pos"), "token")
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "set").cast("decimal(20,0)"))
    members = tokens.groupBy("token").agg(F.count("*").alias("m"), wide(1).alias("h1"), wide(2).alias("h2"), F.sum("pos").alias("pos")).where("m > 1")
    chosen = members.groupBy("m", "h1", "h2").agg(F.min_by("token", F.struct("pos", "token")).alias("token")).select("token")
    return materialise(tokens.join(chosen, "token", "left_semi"))


def link_sets(sets: DataFrame, percent: int, orders: int, rounds: int = ROUNDS, worth: int = PAIRS_PER_ROW) -> DataFrame:
    """Components (node, component) of the sets that link with another."""
    # Behind the first common token both have room for the overlap that links: n - pos tokens, and one for those that agree.
    fits = f"(least(n - pos, p.n - p.pos) + 1) * {100 + percent} >= (n + p.n) * {percent} AND least(n, p.n) * 100 >= greatest(n, p.n) * {percent}"
    tokens = candidate_groups(sets)
    labels = edges = before = None
    for turn in range(rounds + 1):
        named = tokens if labels is None else tokens.join(labels, F.expr("set = node"), "left")
        named = named.select("set", "n", "rank", "pos", "token", (F.col("set") if labels is None else F.coalesce("component", "set")).alias("comp"))
        # First the most central of all members; later the most central one of any component.
        best = F.struct((F.col("rank") if turn == 0 else F.xxhash64(F.lit(turn), "comp")).alias("by"), "rank", "set", "n", "pos", "comp")
        # The shorter of two sets that link has no more than a share of its tokens before the first common one.
        short = F.expr(f"(n - pos + 1) * {100 + percent} >= 2 * n * {percent}")
        groups = named.groupBy("token", "comp").agg(F.count("*").alias("m"), F.max(best).alias("p"), F.max(short).alias("short"))
        groups = groups.groupBy("token").agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("main"), F.max("p").alias("p"), F.count("*").alias("comps"), F.max("short").alias("short"))
        groups = materialise(groups.where("comps > 1 AND short"))
        left = groups.agg(F.sum("m").alias("rows"), F.sum((F.col("m") - F.col("main.m")) * F.col("m")).alias("pairs")).first()
        if not left["rows"]:
            break
        # Pivots pay while they shrink what is left; then what is outside of a token's largest component meets the others.
        last = turn == rounds or left["pairs"] <= worth * left["rows"] or (before is not None and worth > 0 and left["pairs"] > 0.7 * before)
        before = left["pairs"]
        open_ = named.join(groups.select("token", "p", F.col("main.comp").alias("main")), "token")
        pairs = _outside(open_, percent) if last else open_.where("comp <> p.comp")
        pairs = materialise(pairs.where(fits).select(F.least("set", "p.set").alias("a"), F.greatest("set", "p.set").alias("b")).distinct())
        found = verified(pairs, sets, percent, orders)
        edges = materialise(found if edges is None else edges.unionByName(found))
        labels = materialise(components(edges))
        if last:
            break
        tokens = tokens.join(groups.select("token"), "token", "left_semi")
    return labels if labels is not None else sets.selectExpr("set AS node", "set AS component").limit(0)


def _outside(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of a token outside of its main component, each with those of other components as p, in the bands of sizes that
    can link: sets that link lie in one band or in neighbouring ones. Two rows outside of it meet once."""
    band = F.floor(F.ln("n") / F.ln(F.lit(100.0 / percent)) if percent < 100 else F.col("n")).cast("long")
    first = rows.where("comp <> main").select("token", "set", "n", "pos", "comp", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    second = rows.select("token", F.struct("set", "n", "pos", "comp").alias("p"), (F.col("comp") == F.col("main")).alias("inside"), band.alias("band"))
    return first.join(second, ["token", "band"]).where("comp <> p.comp AND (inside OR set < p.set)")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """Each row of docs with its number of shingles and its component of links.

    Words are runs of anything but space and TAB..CR, A-Z lower-cased; a set holds the hashes of all runs of
    ``size`` words, or of all words where these are fewer. Rows link when 100 * intersection >= percent * union.
    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, null ids last), text_hash and
    leader (true for one row of each component, by doc_id and text; rows that repeat both are leaders together).

    Components are those of all links, but not all links are found: pairs of one component are skipped, so neither the
    links between its members nor their number can be had from here.

    A null, empty or blank text has no shingles and links with nothing. Rows with one doc_id and different texts
    are different documents. An empty table gives an empty result. Other columns don't matter.
    Sets are named by 64 bits and told apart by 64 more; should a name be given twice, all sets get others. Tokens are compared
    by 48 bits: two documents of 500 shingles are mistaken for closer than they are about once in 10^9 pairs that come
    to verification.
    """
    every, sets = shingle_sets(docs, size, percent, orders)
    labels = link_sets(sets, percent, orders)
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("text_hash"))
    classes = every.where("set IS NOT NULL").groupBy("set").agg(F.min(first).alias("least"))
    classes = classes.join(labels, F.expr("set = node"), "left").select("set", "least", F.coalesce("component", "set").alias("comp"))
    classes = materialise(classes)
    leads = classes.groupBy("comp").agg(F.min("least").alias("lead"))
    classes = classes.join(leads, "comp").select(F.col("set").alias("_set"), "lead")
    out = every.join(classes, F.expr("set = _set"), "left")
    lead = F.coalesce(F.col("lead"), first)
    return out.select(
        F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), lead["key"].alias("component_id"), "text_hash",
        (first == lead).alias("leader"),
    )


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Of rows that repeat doc_id and text one stays.

    Rows keep all columns, whatever their names and types. Texts of no shingles stay. Repeated rows are thinned out in each
    task before the shuffle.
    """
    kept = near_duplicates(docs, **parameters).where("leader").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    first = Window.partitionBy("text_hash", "doc_id").orderBy("text_hash")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return rows.join(kept, F.expr("text_hash = hash AND doc_id <=> id"), "left_semi").select("row.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and its component."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM word
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d LEFT JOIN size s ON d.doc_id = s.doc_id JOIN least l ON d.doc_id = l.doc_id
"""
