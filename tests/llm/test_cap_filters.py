import numpy as np
import pytest
from conftest import SF_SMALL

from civicflow.llm import cap_filters as cf
from civicflow.llm import queries


def brute(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    return near.sum(axis=1), label


def run(spark, x, kind="float"):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(4)
    got = sorted(cf.near_duplicates(df).collect(), key=lambda r: r.vec_id)
    return np.array([r.n_links for r in got]), np.array([r.component_id for r in got])


@pytest.mark.parametrize("tile", [256, 8])
def test_clusters_and_chance(spark, monkeypatch, tile):
    monkeypatch.setattr(cf, "TILE", tile)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 64))
    x = np.concatenate([centre[rng.integers(0, 12, 500)] + 0.15 * rng.standard_normal((500, 64)), rng.standard_normal((300, 64)),
                        np.repeat(rng.standard_normal((3, 64)), [40, 2, 1], axis=0)]).astype(np.float32)
    links, components = run(spark, x)
    want_links, want = brute(x.astype(float))
    found = links.sum() / want_links.sum()
    assert found >= 0.999 and (links <= want_links).all()
    assert (components == want).mean() >= 0.999


def test_recall_at_the_limit():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((2000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = cf.ProductCode(64, 50)
    a, b = code.decode(x), code.decode(0.95 * x + (1 - 0.95**2) ** 0.5 * z)
    assert a.shape == (2000, cf.ROTATIONS * cf.LIST)
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= 0.998


@pytest.mark.parametrize("n", [1_000_000, 10_000_000])
def test_recall_is_kept_at_larger_sizes(n):
    rng = np.random.default_rng(4)
    x, z = rng.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = cf.ProductCode(64, cf.directions(n))
    a, b = code.decode(x), code.decode(0.95 * x + (1 - 0.95**2) ** 0.5 * z)
    shared = np.array([len(np.intersect1d(u, v)) for u, v in zip(a, b, strict=True)])
    print(n, code.per_block, code.listed, (shared == 0).sum(), shared.mean())
    assert (shared > 0).mean() >= 0.9995 and shared.mean() >= 15


def test_decoding_lists_the_largest_products():
    code = cf.ProductCode(8, 5)
    x = np.random.default_rng(5).standard_normal((20, 8))
    rotation, lists = code.codes[0]
    turned = x @ rotation
    every = sum(np.ix_(*[np.arange(5)] * 4)[j] * 0 + (turned[:, code.blocks[j]] @ lists[j].T).reshape(20, *[5 if k == j else 1 for k in range(4)])
                for j in range(4)).reshape(20, -1)
    ranks = len(code.ranks)
    assert ranks < 625
    best = np.sort(every, axis=1)[:, -cf.LIST:]
    total = 0
    for j, (block, own) in enumerate(zip(code.blocks, lists, strict=True)):
        total = total + np.take_along_axis(-np.sort(-(turned[:, block] @ own.T), axis=1), np.broadcast_to(code.ranks[:, j], (20, ranks)), 1)
    assert np.allclose(np.sort(total, axis=1)[:, -cf.LIST:], best)


def test_query(spark):
    got = sorted(queries.op2_spherical_cap_dedup(spark, SF_SMALL).collect(), key=lambda r: r.vec_id)
    rows = sorted(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    links, component = brute(np.array([r.embedding for r in rows], float))
    assert [r.n_links for r in got] == links.tolist()
    assert [r.component_id for r in got] == [rows[c].vec_id for c in component]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]),
            (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0, 0.0]), (11, [1e300, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in cf.near_duplicates(df.withColumn("id", df.vec_id * 0)).collect()),
                 key=lambda r: (r[0] is None, r[0]))
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
                   (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 3, 1, False), (None, 0, None, True)]
    assert cf.near_duplicates(df.where("false")).count() == 0
