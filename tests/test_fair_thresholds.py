"""K9: equal selection rates on any ties, by hulls and mixed thresholds."""

import hashlib
import math

import numpy as np
import pytest

from civicflow.operators import fairness

GRID = 100


def slow(rows):
    """Best grid rate and its accuracy from all chords of each group's points."""
    groups = {}
    for _, g, y, s in rows:
        groups.setdefault(g, []).append((y, None if s is None or math.isnan(s) else s))
    value = {}
    for g, own in groups.items():
        n = len(own)
        points = [(sum(s is not None and s >= t for _, s in own), sum((s is not None and s >= t) == (y == 1) for y, s in own))
                  for t in [math.inf, *sorted({s for _, s in own if s is not None}, reverse=True)]]
        for i in range(GRID + 1):
            x = i * n / GRID
            best = [a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) if b[0] > a[0] else a[1]
                    for a in points for b in points if a[0] <= x <= b[0] and (a[0] < b[0] or a[0] == x)]
            if best:
                value[g, i] = max(best)
    total = sum(map(len, groups.values()))
    acc = {i: round(sum(value[g, i] for g in groups) / total, 12) for i in range(GRID + 1) if all((g, i) in value for g in groups)}
    best = min(acc, key=lambda i: (-acc[i], i))
    return best, acc


def run(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, y int, s double").repartition(5)
    thresholds, curve = fairness.threshold_moving(df, "g", "y", "s", GRID)
    found = {r["g"]: r for r in thresholds.collect()}
    out = fairness.apply_thresholds(df, thresholds, "g", "s", "id").collect()
    best, acc = slow(rows)
    assert {round(r["rate"] * GRID): r["pooled_accuracy"] for r in curve.collect()} == pytest.approx(acc, abs=1e-11)
    assert set(found) == {r[1] for r in rows} and len(out) == len(rows)
    for g, r in found.items():
        own = [o for o in out if o["g"] == g]
        chosen = [o for o in own if o["p_adjusted"] == 1]
        assert abs(acc[round(r["best_rate"] * GRID)] - acc[best]) < 1e-11
        # the same rate everywhere, up to one row
        assert len(chosen) == r["selected"] and abs(len(chosen) - r["best_rate"] * len(own)) <= 0.5 and r["rows"] == len(own)
        assert all(o["s"] is not None and not math.isnan(o["s"]) for o in chosen)
        for o in own:
            if o["s"] is not None and r["high"] is not None and o["s"] >= r["high"]:
                assert o["p_adjusted"] == 1
            if o["p_adjusted"]:
                assert o["s"] >= r["low"]
    return found, {o["id"]: o["p_adjusted"] for o in out}


def test_many_scores_beside_two(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "a", int(rng.random() < 0.3 + 0.5 * s), float(s)) for i, s in enumerate(rng.random(100))]
    rows += [(1000 + i, "b", int(rng.random() < 0.5), float(i % 2)) for i in range(80)]
    found, _ = run(spark, rows)
    assert found["a"]["best_rate"] == found["b"]["best_rate"]


def test_nulls_and_hot_score(spark):
    rows = [(i, "a", i % 2, 0.5) for i in range(300)] + [(1000 + i, "b", 1, i / 7) for i in range(30)] + [(2000 + i, "b", 1, None) for i in range(10)]
    rows += [(3000 + i, None, int(i > 20), float(i)) for i in range(40)] + [(4000, "b", 0, float("nan"))]
    run(spark, rows)
    nobody = [(5000 + i, "c", 1, None) for i in range(5)]
    found, chosen = run(spark, rows + nobody)
    assert all(r["best_rate"] == 0 for r in found.values()) and not any(chosen.values())


def test_the_band_is_drawn_by_hash(spark):
    rows = [(i, "a", 1 if i < 50 else 0, 2.0 if i < 40 else 1.0) for i in range(100)] + [(200 + i, "b", int(i < 55), float(100 - i)) for i in range(100)]
    found, chosen = run(spark, rows)
    r = found["a"]
    band = sorted((i for i, g, _, s in rows if g == "a" and r["low"] <= s < (r["high"] or math.inf)), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    assert r["take"] > 0 and {i for i in band if chosen[i]} == set(band[:r["take"]])


def test_hull():
    points = [(0, 5, "z"), (1, 6, "a"), (2, 5, "b"), (3, 8, "c"), (4, 9, "d"), (6, 7, "e")]
    assert [p[2] for p in fairness.upper_hull(points)] == ["z", "d", "e"]
    assert fairness.upper_hull(points[:1]) == points[:1]
