"""Exact neighbours through cells, with far fewer pairs on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicflow.operators import models


def frames(spark, x, g, rows):
    data = [(i, float(g[i]), int(1000 - i), float(i % 3), x[i].tolist()) for i in range(len(x))]
    train = spark.createDataFrame(data, "n long, g double, key long, y double, x array<double>").repartition(4)
    q = spark.createDataFrame([(i, float(gg), v.tolist()) for i, gg, v in rows], "_row long, g double, x array<double>").repartition(3)
    return q, train


def slow(x, g, rows, k, others):
    out = {}
    for i, gg, v in rows:
        far = sorted((float(((x[j] - v) ** 2).sum()), 1000 - j, j) for j in range(len(x)) if g[j] == gg and not (others and i == j))
        if far:
            out[i] = [f[1:] for f in far[:k]]
    return out


def found(spark, q, train, k, others=False, counter=None):
    return {r["_row"]: [(n["key"], n["n"]) for n in r["near"]] for r in models.nearest(q, train, k, others, counter).collect()}


def clustered(n, centres, d=16, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d)) * 20
    return c[np.arange(n) % centres] + rng.normal(size=(n, d))


@pytest.mark.parametrize("others", [False, True])
def test_cells_equal_all_pairs(spark, monkeypatch, others):
    monkeypatch.setattr(models, "CELL", 40)
    monkeypatch.setattr(models, "BLOCK", 60)
    x = np.round(clustered(900, 12), 1)
    x[300:420] = x[300]  # one vector many times: a cell of several blocks
    g = np.array([0] * 850 + [1] * 50)
    rows = [(i, g[i], x[i]) for i in range(0, 900, 7)] + ([] if others else [(5000, 0, x[5] + 100), (5001, 7, x[5])])
    q, train = frames(spark, x, g, rows)
    assert found(spark, q, train, 5, others) == slow(x, g, rows, 5, others)


def test_pairs_grow_below_the_square(spark, monkeypatch):
    monkeypatch.setattr(models, "CELL", 64)
    spent = []
    for n in (1000, 4000):
        x = clustered(n, n // 50, seed=3)
        rows = [(i, 0, x[i]) for i in range(n)]
        q, train = frames(spark, x, np.zeros(n), rows)
        counter = spark.sparkContext.accumulator(0)
        out = found(spark, q, train, 5, others=True, counter=counter)
        spent.append(counter.value)
        some = rows[:: n // 20]
        want = slow(x, np.zeros(n), some, 5, True)
        assert {i: out[i] for i, *_ in some} == want
    assert spent[1] < 0.25 * 4000 ** 2 and spent[1] < 10 * spent[0]


def test_what_cant_be_compared_and_groups_without_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "CELL", 10)
    x = clustered(60, 3, d=4)
    g = np.zeros(60)
    rows = [(1, 0, x[1]), (2, 9, x[2]), (3, 0, np.array([np.nan] * 4))]
    q, train = frames(spark, x, g, rows)
    out = found(spark, q, train, 3)
    assert out[1] == slow(x, g, rows[:1], 3, False)[1] and 2 not in out
    assert models.nearest(q.where("_row = 2"), train, 3).count() == 0
    few = train.where("n < 2").withColumn("g", F.lit(0.0))
    assert len(found(spark, q.where("_row = 1"), few, 3)[1]) == 2
