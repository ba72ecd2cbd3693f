import hashlib
import math

import duckdb
import numpy as np
import pytest

from civicflow.llm import queries, shallot


def slow(rows, k=16, rounds=3, scale=64, size=64):
    """Every distance, in Python integers."""
    whole = [(i, x) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    kept = [(i, tuple(math.floor(scale * float(v)) if abs(v) < 1e300 else int(v) * scale for v in x)) for i, x in whole]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cents = [x for _, x in order[:k]]
    if not cents:
        return []

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    last = [(i, *nearest(x)) for i, x in kept]
    total = sum(d for _, d, _ in last)
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, j, fits(d), fits(sum(e for _, e, c in last if c == j)), fits(total), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for i, d, j in last), key=repr)


def found(spark, rows, kind="double", **more):
    made = spark.createDataFrame([(i, x, 1, 2, 0.5) for i, x in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance int, upper double")
    return sorted(map(tuple, shallot.summary(*shallot.cluster_vectors(made.repartition(3), **more)).collect()), key=repr)


def vectors(n, seed=0, centres=20, spread=0.2):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 64))
    return [(i, (c[i % centres] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(400)
    assert found(spark, rows) == slow(rows)


def test_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    grid = [(i, rng.integers(0, 2, 64).astype(float).tolist()) for i in range(60)]  # equal distances abound
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [None] + [1.0] * 63), (104, [math.nan] + [0.0] * 63), (105, [math.inf] + [0.0] * 63),
           (None, [0.25] * 64), (7, grid[7][1]), (7, [0.5] * 64), (106, [-0.001] * 64), (107, [0.0] * 64)]
    rows = grid + odd + [(200, [1.0, 0.0] * 32)] * 80
    assert found(spark, rows) == slow(rows)


def test_few_vectors(spark):
    rows = vectors(3)
    assert found(spark, rows) == slow(rows)
    assert found(spark, rows[:1]) == slow(rows[:1])
    assert found(spark, []) == []
    assert found(spark, [(None, [1.0] * 64)]) == []


def test_large_components_stay_exact(spark):
    rows = vectors(40) + [(50 + i, [(-1) ** i * 1e20 * (i + 1), 3e6 + i] + [0.1] * 62) for i in range(6)] + [(70, [1e200] + [0.0] * 63), (71, [-1.7e308] * 64)]
    assert found(spark, rows) == slow(rows)


@pytest.mark.parametrize("seed", range(4))
def test_search_skips_and_stays_exact(seed):
    """Rounds on the driver: same answers as all distances, with fewer of them."""
    x = shallot.integers(np.array([v for _, v in vectors(3000, seed, 40, 0.3)]), 64)
    rng = np.random.default_rng(seed)
    rows, before = x[rng.choice(len(x), 40, replace=False)].tolist(), None
    n = len(x)
    state = [np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n)]
    spent = 0
    for _ in range(8):
        cents = shallot.Centroids(rows, before)
        *state, distance, computed = shallot.assign(cents, x, *state, exact=False)
        every = ((x[:, None, :] - cents.x[None]) ** 2).sum(axis=2)
        assert (state[0] == every.argmin(axis=1)).all()
        ordered = np.sort(every, axis=1)
        assert (state[2] >= np.sqrt(ordered[:, 0]) * (1 - 1e-8)).all()
        assert (state[3] <= np.sqrt(ordered[:, 1]) * (1 + 1e-8)).all()
        spent += computed
        before = rows
        rows = [(x[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum())).tolist() if (state[0] == c).any() else rows[c] for c in range(40)]
    assert spent < 0.5 * 8 * n * 40


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    made = queries.QUERIES["op12_shallot_clusters"](spark, sf)
    want = con.sql(f"SELECT {', '.join(made.columns)} FROM ({shallot.SQL})").fetchall()
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
