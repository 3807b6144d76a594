"""Clustering against plain rounds in Python's integers."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import kmeans

ROWS = "vec_id long, embedding array<float>, cluster string, id int, x string"


def plain(rows, k=8, rounds=10, seed=3, dim=64):
    """Rows of (id, cluster, distance, cluster inertia, inertia, centroid): every vector against every centroid, every round."""
    kept = [(i, [max(-kmeans.MOST, min(kmeans.MOST, math.floor(1024 * float(np.float32(c))))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assigned = lambda: [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = assigned()
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, at) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assigned()
    d = [far(v, centroids[c]) for (_, v), c in zip(kept, at)]
    return [(i, c, x, sum(y for y, e in zip(d, at) if e == c), sum(d), centroids[c]) for (i, _), c, x in zip(kept, at, d)]


def vectors(n, dim=64, spread=0.05, seed=1):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(5, dim))
    return [(i, [float(np.float32(c)) for c in middles[i % 5] + spread * draw.normal(size=dim)]) for i in range(n)]


def run(spark, rows, **given_):
    table = spark.createDataFrame([(i, v, "c", 9, "y") for i, v in rows], ROWS).repartition(3)
    return [tuple(r) for r in kmeans.cluster(table, **given_).collect()]


def test_clusters(spark):
    rows = vectors(300)
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one vector that holds a third of all rows
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, [0.0] * 64)]  # repeated rows, null ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [1.0] * 63), (2005, [math.nan] + [1.0] * 63), (2006, [math.inf] * 64)]
    rows += [(2007, [1e30] * 64), (2008, [-1e30] * 64), (2009, [-0.0004] * 64)]
    said = []
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(run(spark, rows, said=said), key=key) == sorted(plain(rows), key=key)
    assert said[0] == 507 and sum(said[1:]) < 507 * len(said[1:])  # bounds spare vectors


def test_few_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    some = vectors(3)
    assert sorted(run(spark, some)) == sorted(plain(some))
    same = [(i, [0.5] * 64) for i in range(12)]  # all centroids equal: the first takes all
    assert sorted(run(spark, same)) == sorted(plain(same)) and {r[1] for r in run(spark, same)} == {0}
    small = [(i, [float(i % 3), float(i % 5)]) for i in range(30)]
    assert sorted(run(spark, small, k=2, rounds=3, dim=2)) == sorted(plain(small, 2, 3, dim=2))
    assert sorted(run(spark, small, k=1, rounds=0, dim=2)) == sorted(plain(small, 1, 0, dim=2))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=3, max_size=40), st.integers(1, 5))
def test_bounds_never_decide_wrongly(points, k):
    """Rounds by bounds give what full scans give, ties included, on a grid full of ties."""
    x = np.array(points, dtype=np.int64)
    c = x[:k].copy()
    before, at = None, None
    for _ in range(6):
        now = kmeans.Round(c, before)
        if at is None:
            at, upper, lower = kmeans.scan(x, c)
        else:
            at, upper, lower, _ = now.assign(x, at, upper, lower)
        assert at.tolist() == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
        before, c = c, np.array([x[at == j].sum(axis=0) // (at == j).sum() if (at == j).any() else c[j] for j in range(len(c))])


def test_large_components_are_exact():
    x = np.array([[kmeans.MOST, -kmeans.MOST], [kmeans.MOST - 1, 0]], dtype=np.int64)
    assert kmeans.squared(x, x[::-1]).tolist() == [[1 + kmeans.MOST**2, 0], [0, 1 + kmeans.MOST**2]]


def test_rounds_shuffle_nothing(spark):
    """Vectors and bounds are bucketed alike."""
    store = kmeans.Store(spark, 3)
    a, b = (spark.table(store.put(spark.range(20).selectExpr("id AS block", f"id * {k} AS v{k}"))) for k in (2, 3))
    plan = a.join(b.hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    for name in list(store.paths):
        store.drop(name)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillmesh_")]
