"""Operator 13: a Merkle manifest of a table, a tree for each source and one over the sources.

Blocks of leaves are reduced in the cluster, round by round, until so few nodes are left that the driver builds the rest, the top
tree. The top tree is broadcast; tasks read a node's way to the root (its suffix path) from it and finish the proofs and folds of the block's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import arrow_type
from .ranks import ranked
from .shared import documents, id_crc, materialise

#: Consecutive nodes that become one.
RUN = 16
#: Levels of a block, so 4,096 nodes: what a task holds at once.
LEVELS = 3
#: Most nodes of the top tree, about 150 bytes each at the driver and in the broadcast.
TOP = 32_768
#: Length of a digest.
_HEX = 64

LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(**instead: Column) -> Column:
    """A row's digest: of each column its length in bytes, a colon and the value, or - for null. instead: other values for columns."""

    def field(name: str) -> Column:
        c = instead.get(name, F.col(name)).cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.sha2(F.concat(*[field(name) for name in LEAF_COLUMNS]), 256)


class Tree:
    """Levels of nodes above some consecutive ones. size: nodes of the whole level that these belong to; beyond a block they are one
    block of it, which ends after ``levels`` levels."""

    def __init__(self, nodes: list[str], size: int | None = None, levels: int = LEVELS):
        whole = size is None
        size = len(nodes) if whole else size
        self.levels, self.runs = [nodes], []
        while size > 1 and (whole or len(self.runs) < levels):
            runs = ["".join(self.levels[-1][i : i + RUN]) for i in range(0, len(self.levels[-1]), RUN)]
            self.runs.append(runs)
            self.levels.append([digest(r) for r in runs])
            size = -(-size // RUN)
        self.root = self.levels[-1][0]

    def steps(self, at: int) -> list[tuple[str, str]]:
        """Level by level, the siblings left and right of the node on the way up."""
        out = []
        for runs in self.runs:
            at, k = divmod(at, RUN)
            out.append((runs[at][: _HEX * k], runs[at][_HEX * (k + 1) :]))
        return out


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in steps:
        node = digest(f"{left}{node}{right}")
    return node


def pack(steps: list[tuple[str, str]]) -> str:
    return "|".join(f"{left}/{right}" for left, right in steps)


def unpack(path: str) -> list[tuple[str, str]]:
    return [tuple(step.split("/")) for step in path.split("|")] if path else []


class Top:
    """The top tree: of each source the nodes that are left, and the tree over the sources' roots."""

    def __init__(self, nodes: list[tuple[str | None, str]]):
        """nodes: (tree, digest) in order of trees, null first and by bytes, and of places."""
        groups: dict[str | None, list[str]] = {}
        for name, node in nodes:
            groups.setdefault(name, []).append(node)
        self.trees = {name: (i, Tree(part)) for i, (name, part) in enumerate(groups.items())}
        self.over = Tree([t.root for _, t in self.trees.values()]) if self.trees else None
        self.root = self.over.root if self.over else None

    def way(self, name: str | None, place: int) -> tuple[str, list[tuple[str, str]]]:
        """(root of the node's own tree, steps from the node to the root of all)."""
        number, tree = self.trees[name]
        return tree.root, tree.steps(place) + self.over.steps(number)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, dict[str, list]]]:
    """(tree, block, columns) of rows that come sorted by tree, block, kind and place."""
    key, held = None, None
    for batch in batches:
        names = batch.schema.names
        rows = batch.to_pydict()
        keys = list(zip(rows["tree"], rows["block"]))
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            if keys[lo] != key:
                if held:
                    yield *key, held
                key, held = keys[lo], {n: [] for n in names}
            for n in names:
                held[n] += rows[n][lo:hi]
            lo = hi
    if held:
        yield *key, held


def _block(levels: int) -> Column:
    return F.floor(F.col("place") / RUN**levels).cast("long").alias("block")


def _by_block(nodes: DataFrame) -> DataFrame:
    """Rows of a block next to each other, in order; a suffix path (kind 0) before the nodes."""
    kinds = ["kind"] if "kind" in nodes.columns else []
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", *kinds, "place")


_NODES = "tree string, place long, size long, node string"


def reduced(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, place, size, node) of the blocks of nodes (tree, place, size, node)."""

    def run(batches):
        rows = [(tree, block, -(-b["size"][0] // RUN**levels), Tree(b["node"], b["size"][0], levels).root) for tree, block, b in _blocks(batches)]
        names = ["tree", "place", "size", "node"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return _by_block(nodes.select("tree", _block(levels), "place", "size", "node")).mapInArrow(run, _NODES)


def _top(nodes: DataFrame) -> Top:
    """Built at the driver, of at most TOP nodes."""
    return Top([(r["tree"], r["node"]) for r in sorted(nodes.collect(), key=lambda r: (r["tree"] is not None, (r["tree"] or "").encode(), r["place"]))])


_PATHS = "tree string, place long, own string, path string"


def _listed(nodes: DataFrame, way: Callable[[str | None, int], tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """(tree, place, own, path) of the nodes that the broadcast top tree was built from."""

    def run(batches):
        for batch in batches:
            rows = [(t, p, *way(t, p)) for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([pack(r[3]) for r in rows], pa.string())], names=["tree", "place", "own", "path"])

    return nodes.select("tree", "place").mapInArrow(run, _PATHS)


def _met(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Nodes of a level and, before those of each block, the block's suffix path."""
    names = [f for f in nodes.schema if f.name not in ("tree", "place")]
    above = paths.select("tree", F.col("place").alias("block"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("place"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in names], "own", "path")
    void = F.lit(None).cast("string")
    return above.unionByName(nodes.select("tree", _block(levels), F.lit(1).alias("kind"), "place", *[f.name for f in names], void.alias("own"), void.alias("path")))


def _split(block: dict[str, list]) -> tuple[str, list[tuple[str, str]], dict[str, list]]:
    """(own root, suffix path, rows) of a block of _met()."""
    if block["kind"][0] != 0:
        raise RuntimeError("a block without its path: the table changed while it was read")
    return block["own"][0], unpack(block["path"][0]), {n: v[1:] for n, v in block.items()}


def _descend(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Paths of nodes (tree, place, size, node), from paths of their blocks."""

    def run(batches):
        for tree, _, block in _blocks(batches):
            own, suffix, rows = _split(block)
            made = Tree(rows["node"], rows["size"][0], levels)
            n = len(rows["node"])
            yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.string()), pa.array(rows["place"], pa.int64()), pa.array([own] * n, pa.string()), pa.array([pack(made.steps(p % RUN**levels) + suffix) for p in rows["place"]], pa.string())], names=["tree", "place", "own", "path"])

    return _by_block(_met(nodes, paths, levels)).mapInArrow(run, _PATHS)


def manifest(docs: DataFrame, claim: Column | None = None, proofs: bool = True, top: int = TOP, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of every row of docs.

    A leaf is the digest of LEAF_COLUMNS (leaf()). Within a source leaves stand by doc_id, nulls first, equal ids by leaf; every
    RUN consecutive nodes become one until one is left, the source's subroot; subroots, null source first and then by bytes, give
    the root in the same way. proof lists the siblings on the way from leaf to root, level by level as left/right, levels
    joined by |; proof_sha256 is the digest of the siblings alone. folded_root is what claim, an expression over docs for
    another leaf, leads to with the row's proof; where claim is null or not given, it is the row's own leaf.

    Null and empty values differ; texts are digested whole. Equal rows have equal leaves and stand next to each other; each has
    its own proof. A table of one row has its leaf as root, and no siblings. An empty table gives an empty one. Columns besides LEAF_COLUMNS don't matter.
    proofs=False leaves out proof, which takes a kilobyte a level; levels is what a block spans, top bounds the nodes that the driver holds: beyond
    it further rounds, and the tree over the sources, run in the cluster, with the same rows.
    """
    key = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.col("source").cast("string").alias("tree"), leaf().alias("node"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    leaves = materialise(ranked(rows, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("node").asc()]))
    rounds = [leaves.select("tree", "place", "size", "node")]
    while True:
        rounds.append(nodes := materialise(reduced(rounds[-1], levels)))
        if few := nodes.count() <= top:
            break
        if nodes.where("size > 1").isEmpty():  # more sources than the driver may hold
            break
    spark = docs.sparkSession
    if few:
        built = _top(nodes)
        root, paths = built.root, None
    else:
        over = [materialise(ranked(nodes.select("tree", "node"), [], [F.col("tree").asc_nulls_first()])).withColumnRenamed("tree", "name").withColumn("tree", F.lit(None).cast("string"))]
        while over[-1].count() > top:
            over.append(materialise(reduced(over[-1], levels)))
        built = _top(over[-1])
        root = built.root
    shared = spark.sparkContext.broadcast(built)
    way = lambda tree, place: shared.value.way(tree, place)
    if not few:
        paths = _listed(over[-1], way)
        for level in reversed(over[:-1]):
            paths = _descend(level.select("tree", "place", "size", "node"), paths, levels)
        named = over[0].select(F.col("name"), F.col("place").alias("number"), F.col("node").alias("own"))
        paths = materialise(named.join(paths.select("place", "path"), F.col("number") == F.col("place")).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "own", "path"))
    elif len(rounds) > 2:
        paths = _listed(nodes, way)
    for level in reversed(rounds[1:-1]):
        paths = materialise(_descend(level, paths, levels))
    told = paths is not None
    cells = leaves.select("tree", "place", "size", "node", "doc_id", "claim")
    text = pa.string()
    names = ["doc_id", "leaf", "subroot", "root", *(["proof"] if proofs else []), "proof_sha256", "folded_root"]
    key_arrow = arrow_type(key)

    def run(batches):
        for tree, block, part in _blocks(batches):
            if told:
                own, suffix, held = _split(part)
            else:
                (own, suffix), held = way(tree, block), part
            made = Tree(held["node"], held["size"][0], levels)
            rest = "".join(left + right for left, right in suffix)
            proof, hashed, ends = [], [], []
            for place, node, other in zip(held["place"], held["node"], held["claim"]):
                steps = made.steps(place % RUN**levels)
                hashed.append(digest("".join(left + right for left, right in steps) + rest))
                ends.append(fold(fold(node if other is None else other, steps), suffix))
                if proofs:
                    proof.append(pack(steps + suffix))
            n = len(ends)
            columns = [pa.array(held["doc_id"], key_arrow), pa.array(held["node"], text), pa.array([own] * n, text), pa.array([root] * n, text), *([pa.array(proof, text)] if proofs else []), pa.array(hashed, text), pa.array(ends, text)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{n} {key.simpleString() if n == 'doc_id' else 'string'}" for n in names)
    done = _by_block(_met(cells, paths, levels) if told else cells.withColumn("block", _block(levels))).mapInArrow(run, schema)
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Rows whose copies are tampered with in the query: those whose id's checksum this divides.
TAMPERED = 5


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether its copy, in every fifth one with small letters only, still verifies."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claim = F.when(F.col("doc_id").isNotNull() & (id_crc() % TAMPERED == 0), leaf(text=lower))
    return manifest(documents(spark, sf_dir), claim, proofs=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(leaf_levels: int = 8, source_levels: int = 8) -> str:
    """The query in SQL: as many levels as asked for, so up to RUN**leaf_levels rows a source; levels above a root change nothing."""
    text = lambda t: ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in [*LEAF_COLUMNS[:-1], t])
    crc = (
        "list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT), lambda c, b: "
        "list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), 4294967295)"
    )
    parts = [
        f"made AS (SELECT doc_id, source, sha256(concat({text('text')})) AS leaf, sha256(concat({text('low')})) AS bad FROM "
        f"(SELECT *, CASE WHEN xor({crc}, 4294967295) % {TAMPERED} = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM documents))",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM made)",
    ]

    def climb(name: str, start: str, levels: int) -> None:
        """Tables name0..: nodes of each level by (tree, pos), and up0..: for each node of the level the siblings beside it."""
        parts.append(f"{name}0 AS ({start})")
        for k in range(levels):
            run = f"PARTITION BY tree, pos // {RUN} ORDER BY pos"
            beside = lambda frame: f"coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN {frame}), '')"
            parts.append(f"{name}_up{k} AS (SELECT tree, pos, count(*) OVER (PARTITION BY tree) AS n, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT tree, pos // {RUN} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY tree, pos // {RUN})")

    climb("a", "SELECT source AS tree, pos, leaf AS node FROM leaves", leaf_levels)
    parts.append("subroots AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS number FROM a%d)" % leaf_levels)
    climb("b", "SELECT 0 AS tree, number AS pos, subroot AS node FROM subroots", source_levels)
    parts.append("f0 AS (SELECT doc_id, leaves.source, pos, leaf, bad AS node, '' AS beside, subroot, number FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source)")
    step = 0
    for name, tree, place, levels in (("a", "f.source", "f.pos", leaf_levels), ("b", "0", "f.number", source_levels)):
        for k in range(levels):
            parts.append(
                f"f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN u.n > 1 THEN sha256(concat(u.l, f.node, u.r)) ELSE f.node END AS node, CASE WHEN u.n > 1 THEN concat(f.beside, u.l, u.r) ELSE f.beside END AS beside) "
                f"FROM f{step} f JOIN {name}_up{k} u ON u.tree IS NOT DISTINCT FROM {tree} AND u.pos = {place} // {RUN**k})"
            )
            step += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{step}, (SELECT node AS root FROM b{source_levels})"


OP13_SQL = _sql(5, 3)
