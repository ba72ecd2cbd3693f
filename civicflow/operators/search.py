"""Random search of a booster by staged scores and successive halving.

A fit of the most trees that a learning rate and depth are tried with scores
every smaller number of trees, and every leaf regularisation, in one pass over
the held-out rows.  After each fold the better half of the points goes on to
the next, so that most fits are spent on the points that may win.

Spark's boosted trees have no penalty on leaves.  The stand-in for
``l2_leaf_reg`` shrinks a leaf's value by n / (n + l2), n its training rows, when
trees are scored; later trees of the sequence don't know of it.  Early stopping
looks at every ``patience`` trees and stops where that many more bring nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.operators import models
from civicflow.operators.stages import FEATURES, StateModel
from civicflow.session import cut_lineage

# The space of the champion's search.
GRID = {**models.GRID, "l2_leaf_reg": [1, 3, 5, 7, 9]}


class Forest:
    """Weighted trees as arrays, scored for many rows at once."""

    def __init__(self, trees: list[list[dict]], weights: Sequence[float]):
        self.trees, self.weights = [], list(weights)
        for nodes in trees:
            get = lambda name, nodes=nodes: np.array([n[name] for n in nodes])
            self.trees.append((get("left"), get("right"), np.maximum(get("feature"), 0), get("threshold").astype(float),
                               get("prediction").astype(float), get("rows").astype(float)))

    @classmethod
    def of(cls, model: GBTClassificationModel) -> Forest:
        return cls(models.node_table(model), model.treeWeights)

    def leaves(self, x: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Weight, value and training rows of each row's leaf, tree by tree."""
        every = np.arange(len(x))
        for (left, right, feature, threshold, value, rows), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            while (left[at] >= 0).any():
                low = x[every, feature[at]] <= threshold[at]
                at = np.where(left[at] < 0, at, np.where(low, left[at], right[at]))
            yield weight, value[at], rows[at]

    def margins(self, x: np.ndarray, stages: Sequence[int], l2s: Sequence[float]) -> np.ndarray:
        """``[stage, l2, row]``: the margin after so many trees."""
        out, total = np.zeros((len(stages), len(l2s), len(x))), np.zeros((len(l2s), len(x)))
        for t, (weight, value, rows) in enumerate(self.leaves(x), 1):
            total += weight * np.stack([value * rows / (rows + l2) for l2 in l2s])
            for i, s in enumerate(stages):
                if s == t:
                    out[i] = total
        return out

    def first(self, n: int) -> dict:
        names = ("left", "right", "feature", "threshold", "prediction", "rows")
        return {"weights": self.weights[:n], "trees": [[dict(zip(names, (float(v) for v in node), strict=True)) for node in zip(*tree, strict=True)] for tree in self.trees[:n]]}

    @classmethod
    def load(cls, state: dict) -> Forest:
        trees = [[{k: (int(v) if k in ("left", "right", "feature") else v) for k, v in node.items()} for node in tree] for tree in state["trees"]]
        return cls(trees, state["weights"])


def forests(model) -> list[Forest]:
    """One forest of a binary booster, one per class of a one-vs-rest one."""
    return [Forest.of(m) for m in model.models] if isinstance(model, OneVsRestModel) else [Forest.of(model)]


class BoostedTrees(StateModel):
    """The first trees of a booster with regularised leaves, as a model that saves."""

    def scores(self, x: Column) -> Column:
        v = self.values()
        own, l2, n = [Forest.load(f) for f in v["forests"]], v["l2"], len(v["forests"][0]["weights"])

        @F.pandas_udf("array<double>")
        def margins(xs: pd.Series) -> pd.Series:
            rows = np.vstack(xs.to_numpy()).astype(float)
            m = [f.margins(rows, [n], [l2])[0, 0] if n else np.zeros(len(rows)) for f in own]
            return pd.Series(list(np.column_stack(m if len(m) > 1 else [-m[0], m[0]])))
        return margins(x)


def boosted_trees(model, trees: int, l2: float, classes: Sequence[float]) -> BoostedTrees:
    return BoostedTrees(state=json.dumps({"classes": list(classes), "l2": l2, "forests": [f.first(trees) for f in forests(model)]}))


def staged_f1(model, rows: DataFrame, stages: Sequence[int], l2s: Sequence[float], label: str = "label") -> dict[tuple[int, float], float]:
    """Weighted F1 after each number of trees and for each regularisation, from one pass."""
    own = forests(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            m = np.stack([f.margins(x, stages, l2s) for f in own])
            p = m.argmax(axis=0) if len(own) > 1 else (m[0] > 0).astype(int)
            found = [(s, i, c, q, int(n)) for s in range(len(stages)) for i in range(len(l2s))
                     for (c, q), n in zip(*_pairs(y, p[s, i]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()), strict=True)],
                                             names=["s", "i", "y", "p", "n"])

    counts = rows.select(F.col(label).cast("double").alias("y"), vector_to_array(F.col(FEATURES)).alias("x")).mapInArrow(
        count, "s int, i int, y double, p double, n long").groupBy("s", "i", "y", "p").agg(F.sum("n").alias("n"))
    keyed = counts.withColumn("key", F.col("s") * len(l2s) + F.col("i"))
    return {(stages[r["key"] // len(l2s)], l2s[r["key"] % len(l2s)]): r["f1_weighted"]
            for r in models.metrics.summary_by(keyed, "key", "y", "p").collect()}  # a row per stage and l2


def _pairs(y: np.ndarray, p: np.ndarray) -> tuple[list[tuple[float, float]], np.ndarray]:
    pairs, n = np.unique(np.stack([y, p.astype(float)], axis=1), axis=0, return_counts=True)
    return [(float(a), float(b)) for a, b in pairs], n


def stopped(scores: dict[int, float], most: int) -> int:
    """Early stopping: the number of trees after which the next stage brings nothing."""
    stages = [s for s in sorted(scores) if s <= most]
    for a, b in zip(stages, stages[1:]):
        if scores[b] <= scores[a]:
            return a
    return stages[-1]


@dataclass
class Found:
    """The chosen ``point`` with its number of ``trees``, ``scores`` (F1 by fold) of every point, and how many fits it took."""

    point: dict
    trees: int
    fits: int
    scores: list[tuple[dict, list[float]]] = field(default_factory=list)


def search_booster(train: DataFrame, points: Sequence[dict], n_classes: int, label: str = "label", fold_col: str = "fold", patience: int = 10,
                   parallelism: int = 4, estimator: Callable | None = None) -> Found:
    """Successive halving of ``points`` (``learning_rate``, ``depth``, ``iterations``, ``l2_leaf_reg``) over the folds of ``train``."""
    data = cut_lineage(train.select(label, FEATURES, fold_col))
    folds = [r[0] for r in data.select(fold_col).distinct().orderBy(fold_col).collect()]
    make = estimator or (lambda rate, depth, n: GBTClassifier(labelCol=label, featuresCol=FEATURES, stepSize=rate, maxDepth=depth, maxIter=n, seed=42))
    if n_classes > 2 and estimator is None:
        make = lambda rate, depth, n: OneVsRest(classifier=GBTClassifier(stepSize=rate, maxDepth=depth, maxIter=n, seed=42), labelCol=label, featuresCol=FEATURES)
    alive, fits = list(range(len(points))), 0
    scores: dict[int, list[float]] = {i: [] for i in alive}
    trees: dict[int, list[int]] = {i: [] for i in alive}

    def run(fold: int, rate: float, depth: int, own: list[int]) -> dict[int, tuple[float, int]]:
        most = max(points[i]["iterations"] for i in own)
        model = make(rate, depth, most).fit(data.where(F.col(fold_col) != fold))
        stages = sorted({*range(patience, most + 1, patience), *(points[i]["iterations"] for i in own)})
        l2s = sorted({float(points[i]["l2_leaf_reg"]) for i in own})
        f1 = staged_f1(model, data.where(F.col(fold_col) == fold), stages, l2s, label)
        out = {}
        for i in own:
            l2 = float(points[i]["l2_leaf_reg"])
            n = stopped({s: f1[s, l2] for s in stages}, points[i]["iterations"])
            out[i] = (f1[n, l2], n)
        return out

    for number, fold in enumerate(folds):
        groups: dict[tuple, list[int]] = {}
        for i in alive:
            groups.setdefault((points[i]["learning_rate"], points[i]["depth"]), []).append(i)
        with ThreadPoolExecutor(parallelism) as pool:
            for found in pool.map(lambda g: run(fold, *g[0], g[1]), groups.items()):
                for i, (f1, n) in found.items():
                    scores[i].append(f1)
                    trees[i].append(n)
        fits += len(groups)
        mean = {i: sum(scores[i]) / len(scores[i]) for i in alive}
        if number < len(folds) - 1:
            alive = sorted(alive, key=lambda i: (-mean[i], i))[:max(1, -(-len(alive) // 2))]
    best = min(alive, key=lambda i: (-mean[i], i))
    return Found(points[best], int(np.median(trees[best])), fits, [(points[i], scores[i]) for i in range(len(points))])


def fit_found(found: Found, train: DataFrame, n_classes: int, label: str = "label") -> BoostedTrees:
    """The chosen booster on all rows."""
    make = GBTClassifier(labelCol=label, featuresCol=FEATURES, stepSize=found.point["learning_rate"], maxDepth=found.point["depth"], maxIter=found.trees, seed=42)
    if n_classes > 2:
        make = OneVsRest(classifier=make, labelCol=label, featuresCol=FEATURES)
    return boosted_trees(make.fit(train), found.trees, float(found.point["l2_leaf_reg"]), [float(c) for c in range(n_classes)])
