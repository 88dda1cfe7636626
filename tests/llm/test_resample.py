import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bauwerk.llm import resample as R
from bauwerk.llm.blocks import Block
from bauwerk.llm.ranks import ranked
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = WORDS.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, longest, buckets, percent, least, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t, longest)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for key, text in rows:
        words, found = grams(text, longest)
        weight = sum(gain(bucket(g)) for g in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(str, map(tuple, out)))


def rows_of(n, seed=0):
    rng = random.Random(seed)
    words = ["a", "b", "Ä", "cc", "DDD", "e1", "ﬀ", *[f"w{i}" for i in range(30)]]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 19, 20, 60]))) for _ in range(n)]
    rows = [(i, t if i % 3 else texts[0]) for i, t in enumerate(texts)]  # a third are copies
    return rows + [(n, None), (n + 1, ""), (n + 2, "-.!"), (n + 3, "b a " * 30_000), rows[1], rows[1], (None, texts[2])], ["A b cc", "w1 w2 w3 e1", None, ""]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (2, 64, 50), (3, 7, 100), (4, 1000, 0)])
def test_against_brute_force(spark, longest, buckets, percent):
    rows, target = rows_of(300)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, weight int, place string").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(docs, bench, longest, buckets, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(str, map(tuple, got))) == brute(rows, target, longest, buckets, percent, 20, 2024)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, "a b c " * 10) for i in range(20)], "doc_id long, text string")
    assert R.resample(none, some).count() == 0
    assert R.resample(some, none, percent=50).where("rank IS NOT NULL").count() == 10


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 3, 5):
        ids = rng.integers(0, 4, 200).astype(np.int32)
        order, shared = R.suffix_array(ids, depth)
        cut = [tuple(ids[i : i + depth]) for i in order]
        assert sorted(order) == list(range(200)) and cut == sorted(cut)
        for a, b, n in zip(cut, cut[1:], shared[1:]):
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_each_ngram_is_hashed_once():
    block = Block(0, [b"a", b"b"], np.array([0, 1, 0, 1, 0, 1], np.int32), [4, 0, 2], [1, 2, 3], [False] * 3)
    made = R.Grams(block, 2, 1000)
    assert [len(made.runs(n)[1]) for n in (1, 2)] == [2, 2]  # a, b; "a b", "b a"
    assert made.numbers().tolist() == [7, 0, 3] and made.counts().sum() == 10


def test_ranks_of_one_hot_group(spark):
    rows = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.lit("b")).otherwise(F.lit("a")).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = ranked(rows.repartition(5), ["g"], [F.col("v").asc(), F.col("id").asc()]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    assert sum(map(len, groups.values())) == 3_000
    for part in groups.values():
        part.sort(key=lambda r: (r.v, r.id))
        assert [r.place for r in part] == list(range(len(part))) and {r.size for r in part} == {len(part)}
