import numpy as np
import pytest

from bauwerk.llm import neardup, postings

SCHEMA = "vec_id long, embedding array<float>, label int, n long, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA)


def clusters(rng, n, d, copies):
    base = rng.standard_normal((n, d))
    out = [base]
    for k in range(copies):
        out.append(base[: n // 3] + rng.standard_normal((n // 3, d)) * 0.05)
    return np.concatenate(out).astype(np.float32)


ODD = [(90001, None, 1), (90002, [0.0] * 16, 1), (90003, [float("nan")] + [1.0] * 15, 1), (90004, [None] + [1.0] * 15, 1), (90005, [], 1), (90006, [1.0] * 3, 1), (90007, [float("inf")] * 16, 1)]


@pytest.mark.parametrize("cell", [512, 20])
def test_near_duplicates_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "CHUNK", 64)
    rng = np.random.default_rng(4)
    x = clusters(rng, 240, 16, 3)
    labels = rng.integers(0, 3, len(x))
    labels[240:] = np.tile(labels[:80], 3)
    rows = [(i + 1, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, labels))]
    rows += [(5000 + i, x[0].tolist(), int(labels[0])) for i in range(150)] + [(6000, (x[0] * 2).tolist(), int(labels[0]))]
    plain = [r for r in rows]
    rows += ODD + [(7000, x[0].tolist(), None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    ids = np.array([r[0] for r in plain])
    u = np.array([r[1] for r in plain], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in plain])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    want = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp)}
    want |= {i: (0, i, True) for i in [*[r[0] for r in ODD], 7000]}
    assert got == want


def test_near_duplicates_of_an_empty_table(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert [tuple(r) for r in neardup.near_duplicates(table(spark, ODD[:1])).collect()] == [(90001, 0, 90001, True)]


def test_plan_grows_slowly():
    k, tables = neardup.plan(10**9, 0.93, 0.999)
    assert 10 < k < 25 and tables < 10**5
    assert neardup.plan(100, 0.93, 0.999) == (0, 1)


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def run(spark, rows, k=20):
    vectors = table(spark, rows)
    got = {}
    for r in sorted(postings.nearest(vectors, vectors.where("vec_id % 20 = 0"), k).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(postings, "SHARD", 200)
    rng = np.random.default_rng(9)
    x = clusters(rng, 1500, 16, 4) * rng.random((3500, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(10000 + i, x[20].tolist(), 0) for i in range(500)]
    want, got = brute(rows, 20), run(spark, rows + ODD)
    assert want.keys() == got.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    score = {(q, i): s for q in want for i, s in want[q]}
    for q in got:
        assert len(got[q]) == 20
        assert [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q])
        for i, s in got[q]:
            assert score.get((q, i), s) == pytest.approx(s, rel=1e-12)


def test_recall_beside_very_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(postings, "LIST", 100)
    rng = np.random.default_rng(12)
    x = clusters(rng, 1500, 16, 2)
    x[7] *= 1000
    x[11] *= 90
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want, got = brute(rows, 20), run(spark, rows)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(({7, 11} & {i for i, _ in want[q]}) <= {i for i, _ in got[q]} for q in want)


def test_best_of_many_parts():
    rng = np.random.default_rng(2)
    best, k = postings.Best(3), 3
    x, q = rng.integers(-3, 4, (300, 5)).astype(float), rng.integers(-3, 4, (40, 5)).astype(float)
    for at in range(0, 300, 30):
        best.compare(np.arange(40), q, np.arange(at, at + 30) % 250, x[at : at + 30])
        if at % 90 == 0:
            best.reduce()
    found = list(zip(*best.reduce()))
    for i in range(40):
        scores = {}
        for j in range(300):
            if j % 250 != i:
                scores[j % 250] = max(scores.get(j % 250, -99), x[j] @ q[i])
        assert [(int(b), c) for a, b, c in found if a == i] == sorted(scores.items(), key=lambda t: (-t[1], t[0]))[:3]


def test_few_vectors(spark):
    rows = [(20, [1.0, 0.0], 0), (40, [0.5, 0.5], 0), (3, [1.0, 0.0], 0)]
    assert run(spark, rows) == {20: [(3, 1.0), (40, 0.5)], 40: [(3, 0.5), (20, 0.5)]}
    assert run(spark, rows[:1]) == {}
    assert run(spark, [(20, None, 0)]) == {} == run(spark, [])


def mixed(rng):
    """Vectors of 16, 8 and 3 components, with near copies in each length."""
    x = [clusters(rng, n, d, 1) for n, d in ((240, 16), (90, 8), (6, 3))]
    return [(i + 1, v.tolist(), i % 2) for i, v in enumerate(v for part in x for v in [*part, *part[:2]])]


def test_near_duplicates_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 40)
    rows = mixed(np.random.default_rng(8))
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(table(spark, rows)).collect()}
    want = {}
    for d in (16, 8, 3):
        some = [r for r in rows if len(r[1]) == d]
        u = np.array([r[1] for r in some], float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        lab = np.array([r[2] for r in some])
        link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
        want |= {r[0]: int(n) - 1 for r, n in zip(some, link.sum(axis=1))}
        assert any(want[r[0]] for r in some)
    assert got == want


def test_nearest_of_every_length(spark):
    rows = [(20 * i if len(v) == 3 else i, v, lab) for i, v, lab in mixed(np.random.default_rng(8))]
    short = {i for i, v, _ in rows if len(v) == 3}
    got, want = run(spark, rows, 5), {}
    for d in (16, 8, 3):
        want |= brute([r for r in rows if len(r[1]) == d], 5)
    assert {q: len(found) for q, found in got.items()} == {q: len(found) for q, found in want.items()}
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in short)


def test_planted_links_around_the_threshold(spark):
    """6,000 vectors of one label, more than a cell holds, with pairs planted at cosines from 0.90 to 0.99."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((6_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 3_000, 2):
        cosine = rng.uniform(0.90, 0.99)
        side = rng.standard_normal(32)
        side -= (side @ x[i]) * x[i]
        x[i + 1] = cosine * x[i] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(table(spark, rows)).collect()}
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    found = sum(got[i] for i in range(len(u)))
    assert all(got[i] <= want[i] for i in range(len(u))) and found >= 0.995 * want.sum() and want.sum() > 1_500


def test_fit_holds_blocks_of_distances(monkeypatch):
    # All distances to 512 centroids would be 134 MB, the products of all 500 queries 131 MB.
    import tracemalloc

    x = np.random.default_rng(6).standard_normal((32_768, 8))
    tracemalloc.start()
    index = postings.fit(x, 10 * len(x))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 64e6
    some = x[:1_500]
    at, where = index.places(some)
    monkeypatch.setattr(postings, "BLOCK", 10_000)
    whole = index.places(some)
    assert set(zip(at.tolist(), where.tolist())) == set(zip(whole[0].tolist(), whole[1].tolist()))
