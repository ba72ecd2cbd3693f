"""Exact quantiles by bisection over histograms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicflow.operators import profile

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def slow(values, p):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    at = p * (len(v) - 1)
    a, b = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
    return a if at == int(at) or a == b else a + (at - int(at)) * (b - a)


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-12 * max(abs(a), abs(b))


def check(spark, groups):
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    df = spark.createDataFrame(rows + [(k, None) for k in groups], "k string, x double").repartition(5)
    found = {r["k"]: r for r in profile.grouped_quantiles(df, ["k"], "x", PROBS).collect()}
    assert set(found) == {k for k, v in groups.items() if len(v)}
    for k, v in groups.items():
        if len(v):
            assert found[k]["n"] == len(v)
            for p, q in zip(PROBS, found[k]["quantiles"], strict=True):
                assert same(q, slow(list(map(float, v)), p)), (k, p, q)


def test_any_doubles(spark):
    rng = np.random.default_rng(5)
    wide = np.concatenate([10.0 ** rng.uniform(-300, 300, 400), -(10.0 ** rng.uniform(-300, 300, 400)), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]])
    check(spark, {"wide": wide, "normal": rng.normal(size=2000), "near": 1.0 + rng.integers(0, 3000, 1500) * 2.0 ** -52, "one": [7.5], "two": [1, 2],
                  None: [3, 3, 9], "equal": [4.25] * 50, "whole": rng.integers(-5, 5, 300), "empty": []})


def test_beside_infinity_and_nan(spark):
    inf, nan = math.inf, math.nan
    check(spark, {"inf": [1, 2, inf], "nan": [1, 2, nan], "both": [-inf, 1, 2, inf, nan], "infs": [inf, inf, -inf], "nans": [nan, nan]})
    df = spark.createDataFrame([(1.0,), (2.0,), (inf,)], "x double")
    assert profile.exact_quantiles(df, ["x"], [0.5]) == {"x": [2.0]}
    assert profile.NullImputer(["x"]).fit(df.union(spark.createDataFrame([(None,)], "x double"))).fill == {"x": 2.0}


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert profile.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}
    assert profile.measure_stats(df, "x", ["k"]).collect() == []
    assert tuple(profile.measure_stats(df, "x").first()) == (0, None, None, None, None, None, None)


@pytest.mark.parametrize("hot", ["a"])
def test_a_group_with_most_rows_is_no_task(spark, hot):
    """Between the counted values and the bins there is no exchange by group alone."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.lit("b")).otherwise(hot).alias("k"), F.rand(3).alias("x"))
    plans = []
    keep = profile.cut_lineage
    try:
        profile.cut_lineage = lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()), keep(d))[1]
        out = {r["k"]: r["quantiles"][0] for r in profile.grouped_quantiles(df, ["k"], "x", [0.5]).collect()}
    finally:
        profile.cut_lineage = keep
    assert set(out) == {"a", "b"}
    for plan in plans:
        # windows run over bins: right above each one's exchange is a final aggregate, never the values themselves
        assert "collect_list" not in plan and "sort_array" not in plan
        for line in plan.splitlines():
            assert "Window" not in line or "bin" in line
