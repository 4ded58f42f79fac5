import numpy as np
import pytest

from chronolex.llm import neighbours as N


def brute(rows, k):
    out = {}
    for key, space, v in rows:
        if not usable(v):
            continue
        a = np.array(v, np.float32).astype(float)
        sims = []
        for other, sp, w in rows:
            if other != key and sp == space and usable(w):
                b = np.array(w, np.float32).astype(float)
                sims.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), other))
        out[key] = [o for _, o in sorted(sims)[:k]]
    return out


def usable(v):
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def make(n, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(1, n // 15), 8))
    return [(i, "ab"[i % 3 == 0], (centres[i % len(centres)] + 0.1 * r.standard_normal(8)).astype(np.float32).tolist()) for i in range(n)]


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, space string, vec array<float>, neighbour string")
    got = {}
    for r in sorted(N.nearest(df, dim=8, k=k, **options).collect(), key=lambda r: (r.key, r.position)):
        got.setdefault(r.key, []).append(r.neighbour)
    return got


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_POINTS", 64)
    rows = make(900)
    want, got = brute(rows, 10), run(spark, rows)
    assert got.keys() == want.keys()
    hits = sum(len(set(want[k]) & set(got[k])) for k in want)
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_copies_ties_and_dirt(spark):
    rows = make(60, 1)
    rows += [(100 + i, "a", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(40)]  # more copies than a list holds
    rows += [(200, "a", None), (201, "a", [0.0] * 8), (202, "a", [1.0]), (203, "a", [float("nan")] * 8), (204, "a", [None] * 8)]
    rows += [(300, None, [1.0] * 8), (301, None, [2.0] * 8), (302, "alone", [1.0] * 8)]
    assert run(spark, rows) == {k: v for k, v in brute(rows, 10).items() if v}


def test_rescaled_copies_tie_by_key(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal(8)
    keys = r.permutation(np.arange(1000, 1050)).tolist()  # more points of one direction than a query keeps
    rows = make(60, 1) + [(key, "a", (v * scale).astype(np.float32).tolist()) for key, scale in zip(keys, r.uniform(0.5, 2, 50))]
    assert len({tuple(x[2]) for x in rows}) == len(rows)
    assert run(spark, rows) == brute(rows, 10)


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("m", [2, 6, 9])
def test_quantile(m):
    draws = (np.random.default_rng(0).standard_normal((200_000, m)) ** 2).sum(axis=1)
    assert (draws <= N.chi_square_quantile(0.9, m)).mean() == pytest.approx(0.9, abs=0.005)


def test_many_spaces(spark):
    r = np.random.default_rng(7)
    v = r.standard_normal((4000, 8)).astype(np.float32)
    rows = [(i, f"s{i % 2000}", x.tolist()) for i, x in enumerate(v)]
    assert run(spark, rows) == {i: [(i + 2000) % 4000] for i in range(4000)}


def test_a_small_sample_keeps_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_POINTS", 64)
    monkeypatch.setattr(N, "SAMPLE_TOTAL", 200)  # of 900 rows, so cells hold more points
    rows = make(900, 3)
    want, got = brute(rows, 10), run(spark, rows)
    assert sum(len(set(want[k]) & set(got[k])) for k in want) >= 0.99 * sum(map(len, want.values()))


def test_boxes_never_hide_a_point():
    r = np.random.default_rng(2)
    p, lo = r.standard_normal((50, 5)), r.standard_normal((30, 5))
    hi = lo + r.random((30, 5))
    gaps = N.box_gaps(p.min(axis=0), p.max(axis=0), lo, hi)
    assert (gaps <= N.box_distance(p, lo, hi).min(axis=0) + 1e-6).all()


@pytest.mark.parametrize(("path", "uri"), [("/a/b", "file:///a/b"), ("file:/a", "file:///a"), ("file:///a", "file:///a"), ("s3a://b/k", "s3://b/k"), ("hdfs://n:9/x", "hdfs://n:9/x"), ("dbfs:/x/y", "file:///dbfs/x/y"), ("gs://b/k", "gs://b/k")])
def test_addresses_of_the_index(path, uri):
    assert N.index_uri(path) == uri


def test_many_large_spaces(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_POINTS", 2)  # 300 spaces of more than one cell
    v = np.random.default_rng(8).standard_normal((1200, 8)).astype(np.float32)
    rows = [(i, f"s{i % 300}" if i % 300 else None, x.tolist()) for i, x in enumerate(v)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_few_leaves_hold_the_neighbours():
    r = np.random.default_rng(4)
    p, off = r.standard_normal((20_000, 10)).astype(np.float32), 0.28
    nodes = N.grow(p, 256)
    leaf = N.descend(nodes, p)
    q = p[:400]
    who, where = N.likely_leaves(nodes, 256, q, np.full(len(q), 1 / off), 0.01)
    near = np.zeros((len(q), 256), bool)
    near[who, where] = True
    truth = np.stack([N.descend(nodes, q + off * r.standard_normal(q.shape).astype(np.float32)) for _ in range(50)], axis=1)
    assert np.take_along_axis(near, truth, axis=1).mean() >= 0.985
    lo, hi = (np.stack([f(p[leaf == i], axis=0) for i in range(256)]) for f in (np.min, np.max))
    within = N.box_distance(q, lo, hi) <= N.chi_square_quantile(0.98, 10) * off**2
    assert near.sum() < 0.5 * within.sum()
