import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bauwerk.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place string, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(nodes):
    """(root, siblings of each node, level by level)."""
    at, sides = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for who, i in enumerate(at):
            run = runs[i // 16]
            sides[who].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            at[who] = i // 16
        nodes = [h(*r) for r in runs]
    return nodes[0], sides


def brute(rows):
    """Rows of the query, as a list to sort."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        part = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[s] = (part, *climb([leaf(r) for r in part]))
    root, over = climb([made[s][1] for s in names])
    out = []
    for k, s in enumerate(names):
        part, subroot, sides = made[s]
        for r, mine in zip(part, sides):
            steps = mine + over[k]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if bad else leaf(r)
            for left, right in steps:
                node = h(left, node, right)
            out.append((r[0], leaf(r), subroot, root, h(*[a + b for a, b in steps]), node, node == root))
    return out


def rows_of(n, sources, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # A third of all rows is of one source.
        source = rng.choice([None, "", "Zß", "b", *[f"s{k}" for k in range(sources)]]) if rng.random() > 0.33 else "hot"
        out.append((i, source, rng.choice([None, "de"]), rng.choice([None, i]), rng.choice([None, "", f"Text {i} ÄA", "x" * 5_000 + "A"]), "p", "t"))
    return out + [out[0], (None, "b", None, None, None, "p", "t"), (None, "b", None, None, "T", "p", "t")]


def query(docs, **more):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claim = F.when(F.col("doc_id").isNotNull() & (M.id_crc() % 5 == 0), M.leaf(text=lower))
    out = M.manifest(docs, claim, **more).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(str, map(tuple, out.collect())))


@pytest.mark.parametrize("n, sources", [(1, 1), (40, 3), (700, 40)])
def test_against_brute_force(spark, n, sources):
    rows = rows_of(n, sources)
    assert query(spark.createDataFrame(rows, SCHEMA).repartition(5), proofs=False) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("top", [300, 30, 5])
def test_rounds_in_the_cluster_give_the_same(spark, top):
    """Small blocks and a small top: rounds of leaves, and of sources, of which there are more than the driver may hold."""
    rows = rows_of(1_500, 60)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert query(docs, proofs=False, top=top, levels=1) == sorted(map(str, brute(rows)))


def test_one_block_and_more(spark):
    rows = [(i, "s", "x", 1, f"A{i}", "p", "t") for i in range(4_096 + 20)]
    assert query(spark.createDataFrame(rows, SCHEMA)) == sorted(map(str, brute(rows)))
    assert query(spark.createDataFrame(rows[:4_096], SCHEMA)) == sorted(map(str, brute(rows[:4_096])))


def test_proofs_hold_and_tell_changes(spark):
    docs = spark.createDataFrame(rows_of(90, 4), SCHEMA)
    got = M.manifest(docs).collect()
    assert len(got) == 93 and all(r.verified for r in got)
    for r in got:
        steps = M.unpack(r.proof)
        assert M.fold(r.leaf, steps) == r.root and h(*[a + b for a, b in steps]) == r.proof_sha256
        assert M.fold(h("other"), steps) != r.root


def test_empty_and_single(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = M.manifest(spark.createDataFrame([(7, None, None, None, None, "p", "t")], SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root == h("1:7", "-", "-", "-", "-") and r.proof == "" and r.proof_sha256 == h("")
