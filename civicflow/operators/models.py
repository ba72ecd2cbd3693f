"""Model training, tuning and prediction as Spark ML jobs.

Every variant is fitted by distributed code (tree histograms, treeAggregate
gradients, class moments added up from Arrow batches, neighbours in pairs of
blocks); the driver only ever holds model parameters.  A caller with very many
rows can first take the exact stratified draw of :mod:`civicflow.operators.split`.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Binarizer, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow.operators import metrics, scaling
from civicflow.operators.ranks import totals_before
from civicflow.operators.stages import FEATURES, Moments, Standardized, StateModel, Total, data_steps
from civicflow.session import cut_lineage


def with_features(df: DataFrame, columns: Sequence[str] | None = None, array_col: str | None = None) -> DataFrame:
    """Assemble numeric columns (or one array column) into the ML vector column."""
    if array_col:
        return df.withColumn(FEATURES, array_to_vector(F.col(array_col).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="keep").transform(df)


# ---------------------------------------------------------------- parameter sets (fixed values)

# Parameters of the variants.  Spark's trees have no minimum of
# rows to split a node and no minimum of hessian weight; the nearest are
# minInstancesPerNode (half the rows to split) and minInfoGain.
BOOSTED = {"xgboost": dict(maxIter=150, maxDepth=10, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                           minInstancesPerNode=3, minInfoGain=0.1),
           "catboost": dict(maxIter=50, maxDepth=4, stepSize=0.3),
           "gbc": dict(maxIter=5, maxDepth=2, stepSize=1.0, subsamplingRate=0.8, minInstancesPerNode=5)}
VARIANTS = ("xgboost", "dummy", "bernoulli_nb", "ada", "rf", "dt", "nb", "knn", "lda", "qda", "ridge", "mlp", "catboost", "gbc", "logreg")


def estimator(name: str, n_features: int, n_classes: int, label: str = "label", seed: int = 42,
              weight_col: str | None = None):
    """The variants that are Spark ML estimators, with their parameters."""
    weighted = {"weightCol": weight_col} if weight_col else {}
    common = dict(labelCol=label, featuresCol=FEATURES, **weighted)
    if name == "dt":
        return DecisionTreeClassifier(maxDepth=8, seed=seed, **common)
    if name == "rf":
        return RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **common)
    if name in BOOSTED:
        if n_classes <= 2:
            return GBTClassifier(seed=seed, **BOOSTED[name], **common)
        # one-vs-rest fits the k binary boosters concurrently
        return OneVsRest(classifier=GBTClassifier(seed=seed, **BOOSTED[name]), parallelism=min(n_classes, 4), **common)
    if name == "nb":
        return NaiveBayes(modelType="gaussian", **common)
    if name == "bernoulli_nb":
        return Pipeline(stages=[Binarizer(threshold=0.0, inputCol=FEATURES, outputCol="_bin"),
                                NaiveBayes(modelType="bernoulli", featuresCol="_bin", labelCol=label, **weighted)])
    if name == "mlp":
        if weight_col:
            raise ValueError("the perceptron takes no weights")
        return Pipeline(stages=[MinMaxScaler(inputCol=FEATURES, outputCol="_scaled"),
                                MultilayerPerceptronClassifier(layers=[n_features, 50, 25, n_classes], maxIter=200,
                                                               seed=seed, featuresCol="_scaled", labelCol=label)])
    if name == "logreg":
        return LogisticRegression(maxIter=100, **common)
    raise ValueError(f"unknown variant {name}")


# ---------------------------------------------------------------- own models

class MajorityModel(StateModel):
    """Predicts the label with the most (weighted) training rows, the smallest on ties."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(float(self.values()["value"])))


def fit_majority(df: DataFrame, label: str = "label", weight_col: str | None = None) -> MajorityModel:
    w = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    top = df.groupBy(label).agg(w.alias("w")).orderBy(F.desc("w"), F.asc(label)).first()
    if top is None:
        raise ValueError("no training rows")
    return MajorityModel(state=json.dumps({"value": top[0]}))


def class_moments(df: DataFrame, label: str, weight_col: str | None = None) -> list[tuple]:
    """``(class, weight, sum, sum of outer products)`` per class.

    Every Arrow batch is reduced to one row per class before anything is
    shuffled; the rows are added up by an aggregate.
    """
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = df.select(F.col(label).cast("double").alias("c"), w.alias("w"), vector_to_array(F.col(FEATURES)).alias("x"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
            out = [(float(k), float(w[c == k].sum()), (w[c == k] @ x[c == k]).tolist(),
                    ((x[c == k] * w[c == k, None]).T @ x[c == k]).ravel().tolist()) for k in np.unique(c)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=["c", "w", "s", "ss"])

    parts = rows.mapInArrow(reduce, "c double, w double, s array<double>, ss array<double>")
    found = (parts.select("c", "w", array_to_vector("s").alias("s"), array_to_vector("ss").alias("ss")).groupBy("c")
                  .agg(F.sum("w").alias("w"), Summarizer.sum(F.col("s")).alias("s"), Summarizer.sum(F.col("ss")).alias("ss"))
                  .orderBy("c").collect())  # a row per class
    d = len(found[0]["s"]) if found else 0
    return [(r["c"], r["w"], r["s"].toArray(), r["ss"].toArray().reshape(d, d)) for r in found]


def _linear(x: Column, weights: list[list[float]], offsets: list[float]) -> Column:
    products = [F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.lit(b)
                for w, b in zip(weights, offsets, strict=True)]
    return F.array(*products)


class LinearScores(StateModel):
    """One linear score per class."""

    def scores(self, x: Column) -> Column:
        v = self.values()
        return _linear(x, v["weights"], v["offsets"])


class QuadraticModel(StateModel):
    """Log density of each class with its own covariance.  d * d terms per
    class are too many for a column expression: Arrow batches, one einsum each."""

    def scores(self, x: Column) -> Column:
        params = [(np.array(m), np.array(i), float(o)) for m, i, o in self.values()["params"]]

        @F.pandas_udf("array<double>")
        def densities(xs: pd.Series) -> pd.Series:
            rows = np.vstack(xs.to_numpy()).astype(float)
            out = [o - 0.5 * np.einsum("ij,jk,ik->i", rows - m, i, rows - m) for m, i, o in params]
            return pd.Series(list(np.column_stack(out)))
        return densities(x)


def fit_discriminant(df: DataFrame, quadratic: bool = False, label: str = "label", weight_col: str | None = None,
                     reg: float = 1e-6) -> StateModel:
    """Linear (pooled covariance) or quadratic (per-class covariance) discriminant analysis."""
    found = class_moments(df, label, weight_col)
    total, d = sum(w for _, w, _, _ in found), len(found[0][2])
    scatter = [ss - np.outer(s, s) / w for _, w, s, ss in found]
    pooled = sum(scatter) / max(total - len(found), 1)
    classes, weights, offsets, params = [c for c, *_ in found], [], [], []
    for (_, w, s, _), own in zip(found, scatter, strict=True):
        mu = s / w
        cov = (own / max(w - 1, 1) if quadratic else pooled) + reg * np.eye(d)
        inv = np.linalg.inv(cov)
        if quadratic:
            params.append((mu.tolist(), inv.tolist(), float(np.log(w / total) - 0.5 * np.linalg.slogdet(cov)[1])))
        else:
            weights.append((inv @ mu).tolist())
            offsets.append(float(np.log(w / total) - 0.5 * mu @ inv @ mu))
    state = {"classes": classes, "params": params} if quadratic else {"classes": classes, "weights": weights, "offsets": offsets}
    return (QuadraticModel if quadratic else LinearScores)(state=json.dumps(state))


def fit_ridge(df: DataFrame, alpha: float = 1.0, label: str = "label", weight_col: str | None = None) -> LinearScores:
    """Per class a ridge regression with intercept on a +1/-1 target,
    min sum w (t - b - x.v)^2 + alpha |v|^2, all from one set of moments."""
    found = class_moments(df, label, weight_col)
    total, s = sum(w for _, w, _, _ in found), sum(s for *_, s, _ in found)
    gram = sum(ss for *_, ss in found) - np.outer(s, s) / total + alpha * np.eye(len(s))
    weights, offsets = [], []
    for _, w, own, _ in found:
        target = 2 * w - total  # sum of the target
        v = np.linalg.solve(gram, (2 * own - s) - s * target / total)
        weights.append(v.tolist())
        offsets.append(float(target / total - s @ v / total))
    return LinearScores(state=json.dumps({"classes": [c for c, *_ in found], "weights": weights, "offsets": offsets}))


class StumpVotes(StateModel):
    """Weighted votes of small trees; the confidence is the share of votes."""

    def scores(self, x: Column) -> Column:
        v = self.values()

        def leaf(tree, k: int) -> Column:
            if "class" in tree:
                return F.lit(1.0 if tree["class"] == k else 0.0)
            return F.when(x[tree["feature"]] <= tree["threshold"], leaf(tree["left"], k)).otherwise(leaf(tree["right"], k))
        return F.array(*[sum((F.lit(a) * leaf(t, k) for a, t in v["trees"]), F.lit(0.0)) for k in v["classes"]])

    def probabilities(self, raw: Column) -> Column:
        return F.transform(raw, lambda v: v / F.greatest(F.aggregate(raw, F.lit(0.0), lambda s, w: s + w), F.lit(1e-300)))


def node_table(model) -> list[list[dict]]:
    """The nodes of a tree or of each tree of an ensemble, by their ids, from what the model saves
    (as many rows as nodes): feature, threshold, children, prediction and rows."""
    from civicflow.sources import scratch_path
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # none in a thread
    path = scratch_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = rows.select("treeID", "nodeData.*") if "treeID" in rows.columns else rows.withColumn("treeID", F.lit(0))
    trees: dict[int, dict[int, dict]] = {}
    for r in rows.collect():
        split = r["split"]
        trees.setdefault(r["treeID"], {})[r["id"]] = {
            "left": r["leftChild"], "right": r["rightChild"], "prediction": float(r["prediction"]), "rows": float(r["rawCount"]),
            "feature": split["featureIndex"], "threshold": split["leftCategoriesOrThreshold"][0] if split["leftCategoriesOrThreshold"] else 0.0}
    return [[trees[t][i] for i in sorted(trees[t])] for t in sorted(trees)]


def tree_of(text: str) -> dict:
    """A fitted tree as nested dictionaries (continuous splits), from its debug string: no job, one line per node and branch."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]

    def node(at: int) -> tuple[dict, int]:
        if found := re.match(r"Predict: (\S+)$", lines[at]):
            return {"class": float(found[1])}, at + 1
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)$", lines[at]).groups()
        left, at = node(at + 1)
        right, at = node(at + 1)  # past the "Else"
        return {"feature": int(feature), "threshold": float(threshold), "left": left, "right": right}, at

    return node(0)[0]


def fit_ada(df: DataFrame, rounds: int = 5, depth: int = 1, label: str = "label", seed: int = 42,
            weight_col: str | None = None) -> StumpVotes:
    """SAMME boosting over weighted stumps; row weights are a column that
    is updated per round, and lineage is cut each round (reliable checkpoint)
    so a lost executor never replays earlier rounds."""
    classes = [float(r[0]) for r in df.select(label).distinct().orderBy(label).collect()]
    k = len(classes)
    now = df.select(label, FEATURES, (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("_w"))
    trees = []
    for m in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=depth, labelCol=label, featuresCol=FEATURES, weightCol="_w", seed=seed + m).fit(now)
        pred = tree.transform(now).withColumn("_miss", (F.col("prediction") != F.col(label)).cast("double"))
        err = pred.agg(F.sum(F.col("_w") * F.col("_miss")) / F.sum("_w")).first()[0]
        err = min(max(err, 1e-10), 1 - 1e-10)
        if k > 1 and err >= 1 - 1.0 / k and trees:
            break
        alpha = max(float(np.log((1 - err) / err) + np.log(k - 1)), 1e-10) if k > 1 else 1.0
        trees.append((alpha, tree_of(tree.toDebugString)))
        now = cut_lineage(pred.withColumn("_w", F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss"))).select(label, FEATURES, "_w"))
    return StumpVotes(state=json.dumps({"classes": classes, "trees": trees}))


#: Rows of a side in one comparison of :func:`nearest`.
BLOCK = 8192


def _closest(rows: np.ndarray, train: np.ndarray, k: int, differ: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, squared distance)`` of the ``k`` rows of ``train`` closest to each row, the first on ties.

    Inner products choose the candidates, with a margin for rounding; their
    distances are then sums of squared differences.  ``differ(i, j)`` is false
    for at most one pair of a row, which does not count.
    """
    own, step, out = (train ** 2).sum(axis=1), max(1, (1 << 21) // max(train.shape[1], 1)), []
    last = min(k + (differ is not None), len(train)) - 1
    for at in range(0, len(rows), 64):
        some = rows[at:at + 64]
        size = (some ** 2).sum(axis=1)
        about = size[:, None] + own[None, :] - 2 * (some @ train.T)
        limit = np.partition(about, last, axis=1)[:, last] + 1e-9 * (size + own.max())
        i, j = np.nonzero(~(about > limit[:, None]))  # what can't be compared stays in
        far = np.concatenate([((some[i[c:c + step]] - train[j[c:c + step]]) ** 2).sum(axis=1) for c in range(0, len(i), step)])
        if differ is not None:
            keep = differ(at + i, j)
            i, j, far = i[keep], j[keep], far[keep]
        order = np.lexsort((j, far, i))
        i, j, far = i[order], j[order], far[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((at + i[first], j[first], far[first]))
    i, j, far = (np.concatenate(v) for v in zip(*out, strict=True))
    return i, j, far


def _blocks(n: int, cores: int) -> int:
    return max(-(-n // BLOCK), min(-(-n // 256), cores), 1)


#: Rows of a cell of :func:`nearest` (on average), and cells that a task may know (their pivots and radii).
CELL, MOST_CELLS = 4096, 4096


def _kind(train: DataFrame) -> str:
    return train.schema["key"].dataType.simpleString()


def _vectors(table: pa.Table) -> np.ndarray:
    return table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _compare(k: int, others: bool, counter=None) -> Callable:
    """The ``k`` best of a block of training rows for each row of a block."""
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("key", "ascending"), ("n", "ascending")])
        row, n, i, j, far = left["_row"].to_numpy(), right["n"].to_numpy(), *[np.empty(0, np.int64)] * 2, np.empty(0)
        if len(left) and len(right):
            i, j, far = _closest(_vectors(left), _vectors(right), k, (lambda i, j: row[i] != n[j]) if others else None)
            if counter is not None:
                counter.add(len(left) * len(right))
        best = right.select(["key", "n", "y"]).take(pa.array(j, pa.int64()))
        return pa.Table.from_arrays([pa.array(row[i], pa.int64()), pa.array(far, pa.float64()), *best.columns], names=["_row", "far", *best.column_names])

    return compare


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("_row").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "key", "n", "y"))), 1, k).alias("near"))


def _by_blocks(rows: DataFrame, train: DataFrame, k: int, others: bool, n_rows: dict, n_train: dict, counter=None) -> DataFrame:
    """All pairs of blocks of a group, each in a task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = {g: (_blocks(n, cores), _blocks(n_train[g], 1)) for g, n in n_rows.items() if g in n_train}
    t, b = (F.create_map(*[F.lit(v) for g, s in sizes.items() for v in (float(g), s[at])])[F.col("g")] for at in (0, 1))
    parts = min(sum(x * y for x, y in sizes.values()), 100_000)

    def deal(side: DataFrame, number: str, own: str, n: Column, copied: str, m: Column) -> DataFrame:
        side = side.where(n.isNotNull()).withColumn(own, F.pmod(F.xxhash64(number), n).cast("int"))
        return side.withColumn(copied, F.explode(F.sequence(F.lit(0), m - 1))).repartition(parts, "g", "_t", "_b")

    pairs = deal(rows, "_row", "_t", t, "_b", b).groupBy("g", "_t", "_b").cogroup(deal(train, "n", "_b", b, "_t", t).groupBy("g", "_t", "_b"))
    return _best(pairs.applyInArrow(_compare(k, others, counter), f"_row long, far double, key {_kind(train)}, n long, y double"), k)


class Cells:
    """Pivots of the groups and, of the training rows nearest to each, how many there are and how near and far the pivot is."""

    def __init__(self, pivots: dict[float, np.ndarray]):
        self.pivots = pivots
        self.first = dict(zip(pivots, np.cumsum([0, *[len(p) for p in pivots.values()]])[:-1].tolist(), strict=True))
        total = sum(len(p) for p in pivots.values())
        self.count, self.least, self.most = np.zeros(total, np.int64), np.zeros(total), np.full(total, -np.inf)

    def distances(self, g: float, x: np.ndarray) -> np.ndarray:
        p = self.pivots[g]
        return np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in p], axis=1))

    def own(self, g: float) -> slice:
        return slice(self.first[g], self.first[g] + len(self.pivots[g]))

    def blocks(self) -> np.ndarray:
        """Blocks of each cell."""
        return np.maximum(-(-self.count // BLOCK), 1)

    def assign(self):
        """``cell, r``: the nearest pivot and its distance."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, x = batch.column(1).to_numpy(zero_copy_only=False), _vectors(pa.Table.from_batches([batch]))
                cell, r = np.zeros(len(g), np.int64), np.zeros(len(g))
                for own in np.unique(g):
                    at = np.flatnonzero(g == own)
                    d = self.distances(own, x[at])
                    cell[at], r[at] = d.argmin(axis=1) + self.first[own], d.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], names=[*batch.schema.names, "cell", "r"])

        return run

    def home(self, k: int):
        """``cell``: the nearest cell whose first block has more than ``k`` rows on average (-1: none)."""
        enough = self.count // self.blocks() > 2 * k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, x = batch.column(1).to_numpy(zero_copy_only=False), _vectors(pa.Table.from_batches([batch]))
                cell = np.full(len(g), -1, np.int64)
                for own in np.unique(g):
                    at, fit = np.flatnonzero(g == own), enough[self.own(own)]
                    if fit.any():
                        cell[at] = np.where(fit, self.distances(own, x[at]), np.inf).argmin(axis=1) + self.first[own]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        return run

    def visits(self):
        """``cells``: those that can hold a row within ``far`` (squared; null: all), by the triangle inequality."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                g, x = table["g"].to_numpy(), _vectors(table)
                within = np.sqrt(np.nan_to_num(table["far"].to_numpy(zero_copy_only=False).astype(float), nan=np.inf))
                cells: list[list[int]] = [[]] * len(g)
                for own in np.unique(g):
                    at, part = np.flatnonzero(g == own), self.own(own)
                    d = self.distances(own, x[at])
                    bound = np.maximum(d - self.most[part], self.least[part] - d) - 1e-9 * (d + np.abs(self.least[part]))
                    seen = ~(bound > within[at, None]) & (self.count[part] > 0)  # what can't be compared is visited
                    for i, row in zip(at, seen, strict=True):
                        cells[i] = (np.flatnonzero(row) + self.first[own]).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

        return run


def _by_cells(rows: DataFrame, train: DataFrame, k: int, others: bool, n_train: dict, n_rows: dict, counter=None) -> DataFrame:
    """Each row meets one block of its nearest cell first; the distance of its k-th best there is a bound, and only cells
    that can hold something within it are visited."""
    spark, kind = rows.sparkSession, _kind(train)
    groups = [g for g in n_rows if g in n_train]
    wanted = {g: max(1, min(-(-n_train[g] // CELL), MOST_CELLS // max(len(groups), 1))) for g in groups}
    rows, train = (side.where(F.col("g").isin([float(g) for g in groups])) for side in (rows, train))
    share = F.create_map(*[F.lit(v) for g in groups for v in (float(g), wanted[g] / n_train[g])])[F.col("g")]
    # any points will do as pivots: a bounded draw of the rows
    drawn = train.where(F.pmod(F.xxhash64("n"), F.lit(1 << 30)) / float(1 << 30) < share).select("g", "x").limit(4 * MOST_CELLS).collect()
    d = train.select(F.max(F.size("x"))).first()[0]
    cells = Cells({float(g): np.array([r["x"] for r in drawn if r["g"] == g] or [[0.0] * d], float) for g in groups})
    size = train.select("n", "g", "key", "y", "x")
    placed = cut_lineage(size.mapInArrow(cells.assign(), f"n long, g double, key {kind}, y double, x array<double>, cell long, r double"))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect():
        cells.count[r["cell"]], cells.least[r["cell"]], cells.most[r["cell"]] = r["n"], r["least"], r["most"]
    blocks = cells.blocks()
    table = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "cell long, blocks int")  # a row per cell
    placed = placed.join(F.broadcast(table), "cell").withColumn("block", F.pmod(F.xxhash64("n"), "blocks").cast("int")).drop("blocks", "r")

    def meet(own: DataFrame, theirs: DataFrame, copies: dict[tuple[int, int], int]) -> DataFrame:
        """Rows ``_row, x, cell, block`` with the training rows of that block; a block that many rows meet is copied."""
        many = spark.createDataFrame([(c, b, -(-n // BLOCK)) for (c, b), n in copies.items()], "cell long, block int, lots int")
        lot = lambda side: side.join(F.broadcast(many), ["cell", "block"])  # noqa: E731  a row per block that is visited, a few thousand
        left = lot(own).withColumn("lot", F.pmod(F.xxhash64("_row"), "lots").cast("int")).drop("lots")
        right = lot(theirs).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
        parts = max(1, min(sum(-(-n // BLOCK) for n in copies.values()), 100_000))
        left, right = (side.repartition(parts, "cell", "block", "lot").groupBy("cell", "block", "lot") for side in (left, right))
        return left.cogroup(right).applyInArrow(_compare(k, others, counter), f"_row long, far double, key {kind}, n long, y double")

    def counted(own: DataFrame) -> dict[tuple[int, int], int]:
        return {(r["cell"], r["block"]): r["n"] for r in own.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n")).collect()}

    at_home = cut_lineage(rows.select("_row", "g", "x").mapInArrow(cells.home(k), "_row long, g double, x array<double>, cell long"))
    first = at_home.where("cell >= 0").select("_row", "x", "cell", F.lit(0).alias("block"))
    copies = counted(first)
    empty = spark.createDataFrame([], f"_row long, far double, key {kind}, n long, y double")
    found = cut_lineage(meet(first, placed, copies)) if copies else empty
    bound = found.groupBy("_row").agg(F.when(F.count(F.lit(1)) >= k, F.max("far")).alias("far"))
    routed = cut_lineage(at_home.join(bound, "_row", "left").select("_row", "g", "x", "far", "cell").mapInArrow(
        cells.visits(), "_row long, g double, x array<double>, far double, cell long, cells array<long>"))
    each = routed.select("_row", "x", F.col("cell").alias("home"), F.explode("cells").alias("cell")).join(F.broadcast(table), "cell")
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("not (cell = home and block = 0)").select("_row", "x", "cell", "block")
    copies = counted(each)
    more = meet(each, placed, copies) if copies else empty
    return _best(found.unionByName(more), k)


def nearest(rows: DataFrame, train: DataFrame, k: int, others: bool = False, counter=None) -> DataFrame:
    """``_row`` and ``near``: the ``k`` rows of ``train`` of the same group nearest to each of
    ``rows``, as structs (far, key, n, y) in this order (``others``: without the row itself).

    ``rows`` has _row, g, x and ``train`` n, g, key, y, x; both are read several
    times.  Where a group has more than ``CELL`` training rows they are put into
    cells around pivots, and a row visits only the cells that can hold one of
    its k best (exact, by the triangle inequality); smaller groups are compared
    pair by pair.  Cells and groups are dealt into blocks by a hash of the row
    number, so one of any size is spread out.  ``counter`` adds up the pairs compared.
    """
    rows, train = rows.where("x is not null"), train.where("x is not null")
    n_rows, n_train = ({r[0]: r[1] for r in side.groupBy("g").count().collect()} for side in (rows, train))  # a row per group
    if not any(g in n_train for g in n_rows):
        return rows.select("_row", F.lit(None).cast(f"array<struct<far:double,key:{_kind(train)},n:bigint,y:double>>").alias("near")).limit(0)
    if max(n for g, n in n_train.items() if g in n_rows) > CELL:
        return _by_cells(rows, train, k, others, n_train, n_rows, counter)
    return _by_blocks(rows, train, k, others, n_rows, n_train, counter)


class _RowsWriter(DefaultParamsWriter):
    """Saves the training rows of a :class:`NeighbourVotes` beside its parameters."""

    def saveImpl(self, path: str) -> None:  # noqa: N802 - name of pyspark.ml
        super().saveImpl(path)
        self.sparkSession.read.parquet(self.instance.values()["rows"]).write.parquet(f"{path}/rows")


class _RowsReader(DefaultParamsReader):
    def load(self, path: str) -> "NeighbourVotes":
        model = super().load(path)
        return model._set(state=json.dumps(model.values() | {"rows": f"{path}/rows"}))


class NeighbourVotes(StateModel):
    """Votes of the ``k`` nearest training rows (Euclidean; ties: the row
    that comes first by key; equal votes: the smaller label).

    The training rows are a table in the shared folder, of any size; the state
    holds its path.  A row without features has no prediction.
    """

    def write(self) -> _RowsWriter:
        return _RowsWriter(self)

    @classmethod
    def read(cls) -> _RowsReader:
        return _RowsReader(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values()
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        train = df.sparkSession.read.parquet(v["rows"]).withColumn("g", F.lit(0.0))
        near = nearest(rows.select("_row", F.lit(0.0).alias("g"), vector_to_array(F.col(FEATURES)).alias("x")), train, v["k"])
        labels = F.array(*[F.lit(float(c)) for c in v["classes"]])
        votes = near.select("_row", F.transform(labels, lambda c: F.size(F.filter("near", lambda n: n["y"] == c)).cast("double")).alias("rawPrediction"))
        return self._labelled(rows.join(votes, "_row", "left").drop("_row"))

    probabilities = StumpVotes.probabilities


def _numbered(df: DataFrame, key: str, label: str, name: str) -> tuple[DataFrame, str]:
    """The rows with a label, written once with a number of their own: n, key, y, x; and their path."""
    from civicflow.sources import scratch_path
    path = scratch_path(df.sparkSession, name)
    (df.where(F.col(label).isNotNull())
       .select(F.monotonically_increasing_id().alias("n"), F.col(key).alias("key"), F.col(label).cast("double").alias("y"), vector_to_array(F.col(FEATURES)).alias("x"))
       .write.parquet(path))
    return df.sparkSession.read.parquet(path), path


def fit_neighbours(df: DataFrame, key: str, k: int = 5, label: str = "label") -> NeighbourVotes:
    """The rows with a label, written to the shared folder."""
    rows, path = _numbered(df, key, label, "neighbours")
    classes = [r[0] for r in rows.select("y").distinct().orderBy("y").collect()]
    if not classes:
        raise ValueError("no training rows")
    return NeighbourVotes(state=json.dumps({"classes": classes, "rows": path, "k": k}))


def oversample(df: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """H3: each class gets as many rows as the largest by points between a row
    and one of its ``k`` nearest rows of the class (``synthetic`` marks them).

    New points go round the class in the order of the key.  A row that has
    more than 10,000 of them has them made in several tasks.  Rows without a
    label are left out.
    """
    rows, _ = _numbered(df.withColumn(key, F.col(key).cast("long")), key, label, "oversample")
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}  # a row per class
    most = max(counts.values(), default=0)
    given = rows.select("key", "y", "x", F.lit(False).alias("synthetic"))
    small = {y: n for y, n in counts.items() if n < most}
    if small:
        size = F.create_map(*[F.lit(v) for y, n in small.items() for v in (y, n)])[F.col("y")]
        ranked = totals_before(rows.where(size.isNotNull()).select("n", "key", "y", F.lit(1).alias("_one")), "y", F.struct("key", "n"), "_one", "_rank")
        need = F.lit(most) - size
        base = ranked.withColumn("_made", F.floor(need / size).cast("long") + (F.col("_rank") < need % size).cast("long")).where("_made > 0")
        base = cut_lineage(base.join(rows.select("n", "x"), "n").select("n", "key", "y", "x", "_rank", "_made"))
        near = nearest(base.select(F.col("n").alias("_row"), F.col("y").alias("g"), "x"), rows.withColumn("g", F.col("y")), k, others=True)
        base = base.join(near.withColumnRenamed("_row", "n"), "n", "left")
        lots = base.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_made") - 1, F.lit(10_000).cast("long"))))
        each = lots.repartition("n", "_lot").withColumn(
            "_copy", F.explode(F.sequence(F.col("_lot"), F.least(F.col("_lot") + 10_000, F.col("_made")) - 1)))

        def draw(what: str) -> Column:
            return F.pmod(F.xxhash64(F.lit(f"{seed}:{what}"), "y", "_rank", "_copy"), F.lit(1 << 40)) / float(1 << 40)
        picked = each.select("key", "y", "x", draw("part").alias("_u"), F.coalesce(  # a class of one row has no other
            F.try_element_at("near", (F.floor(draw("near") * F.size("near")) + 1).cast("int"))["n"], F.col("n")).alias("_m"))
        partner = rows.select(F.col("n").alias("_m"), F.col("x").alias("_z"))
        made = picked.join(partner, "_m").select("key", "y", F.zip_with("x", "_z", lambda a, b: a + F.col("_u") * (b - a)).alias("x"), F.lit(True).alias("synthetic"))
        given = given.unionByName(made)
    return given.select(F.col("key").alias(key), F.col("y").alias(label), array_to_vector("x").alias(FEATURES), "synthetic")


# ---------------------------------------------------------------- fit / predict / leaderboard

def fit_variant(name: str, train: DataFrame, n_features: int, n_classes: int, label: str = "label",
                seed: int = 42, weight_col: str | None = None, key: str | None = None):
    if name == "dummy":
        return fit_majority(train, label, weight_col)
    if name in ("lda", "qda"):
        return fit_discriminant(train, name == "qda", label, weight_col)
    if name == "ridge":
        return fit_ridge(train, 1.0, label, weight_col)
    if name == "ada":
        return fit_ada(train, 5, 1, label, seed, weight_col)
    if name == "knn":
        if weight_col or not key:
            raise ValueError("the neighbour vote takes a key column and no weights")
        return fit_neighbours(train, key, 5, label)
    return estimator(name, n_features, n_classes, label, seed, weight_col).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    """Prediction column, plus confidence = the largest class
    probability.  Where a model has raw scores only (one-vs-rest boosters),
    they become probabilities by a softmax; a constant model has none."""
    out = model.transform(df)
    kinds = dict(out.dtypes)
    as_array = lambda c: F.col(c) if kinds[c].startswith("array") else vector_to_array(F.col(c))
    if "probability" in kinds:
        return out.withColumn("confidence", F.array_max(as_array("probability")))
    if "rawPrediction" in kinds:
        raw = as_array("rawPrediction")
        rest = F.aggregate(raw, F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max(raw)))
        return out.withColumn("confidence", 1 / rest)
    return out.withColumn("confidence", F.lit(None).cast("double"))


def class_scores(out: DataFrame, n_classes: int) -> DataFrame:
    """``_scores``: a score per class 0..n-1, for AUC; without any, 1 for the predicted class."""
    kinds = dict(out.dtypes)
    for c in ("probability", "rawPrediction"):
        if c in kinds:
            return out.withColumn("_scores", F.col(c) if kinds[c].startswith("array") else vector_to_array(F.col(c)))
    return out.withColumn("_scores", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == F.col("prediction")).cast("double")))


def train_many(names: Sequence[str], train: DataFrame, n_features: int, n_classes: int, label: str = "label",
               seed: int = 42, key: str | None = None, fit: Callable = fit_variant) -> dict[str, tuple[object, float, str | None]]:
    """``name -> (model, seconds, error)``; a variant that fails has its error and no model."""
    out: dict[str, tuple[object, float, str | None]] = {}
    for name in names:
        start = time.perf_counter()
        try:
            out[name] = (fit(name, train, n_features, n_classes, label, seed, key=key), time.perf_counter() - start, None)
        except Exception as e:  # noqa: BLE001 - becomes a row of the leaderboard
            out[name] = (None, time.perf_counter() - start, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}")
    return out


def leaderboard(fitted: dict[str, tuple[object, float, str | None]], test: DataFrame, n_classes: int, label: str = "label") -> DataFrame:
    """One row per variant (accuracy, AUC, precision, recall, F1,
    kappa, MCC, seconds or the error), best weighted F1 first.

    Predictions of all variants are written once; counts and AUC of all of
    them come from one pass each, with the model as key.
    """
    spark = test.sparkSession
    done = None
    for name, (model, _, error) in fitted.items():
        if error is None:
            rows = class_scores(predict(model, test), n_classes).select(
                F.lit(name).alias("model"), F.col(label).cast("double").alias("y"), F.col("prediction").cast("double").alias("p"),
                F.col("_scores").cast("array<double>").alias("_scores"))
            done = rows if done is None else done.unionByName(rows)
    info = spark.createDataFrame([(n, float(s), e) for n, (_, s, e) in fitted.items()], "model string, train_seconds double, error string")
    if done is None:
        return info
    done = cut_lineage(done)
    counts = done.groupBy("model", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    board = metrics.summary_by(counts, "model", "y", "p")
    long = done.select("model", "y", F.posexplode("_scores").alias("i", "s")).select(
        F.concat_ws(":", "model", "i").alias("cls"), (F.col("y") == F.col("i")).cast("int").alias("pos"), F.col("s").alias("score"))
    auc = metrics.auc_from_long(long, "cls", "pos", "score").where("auc is not null").groupBy(
        F.substring_index("cls", ":", 1).alias("model")).agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"))
    return info.join(board, "model", "left").join(auc, "model", "left").orderBy(F.desc_nulls_last("f1_weighted"), "model")


# ---------------------------------------------------------------- tuning

# The search space of the tuned boosters.
GRID = {"learning_rate": [0.01, 0.05, 0.1, 0.15, 0.2], "depth": [4, 6, 8, 10], "iterations": [50, 100, 200, 300]}


def draw_points(grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct random points of a grid (all, if it has fewer)."""
    names = list(grid)
    sizes = [len(grid[k]) for k in names]
    order = np.random.default_rng(seed).permutation(int(np.prod(sizes)))[:n]
    return [dict(zip(names, (grid[k][i] for k, i in zip(names, at, strict=True)), strict=True))
            for at in (np.unravel_index(int(o), sizes) for o in order)]


def boosted_grid(estimator_, points: list[dict]) -> list[dict]:
    """Grid points as parameter maps of a (one-vs-rest) booster."""
    inner = estimator_.getClassifier() if isinstance(estimator_, OneVsRest) else estimator_
    maps = []
    for p in points:
        own = {inner.stepSize: p["learning_rate"], inner.maxDepth: p["depth"], inner.maxIter: p["iterations"]}
        maps.append({estimator_.classifier: inner.copy(own)} if isinstance(estimator_, OneVsRest) else own)
    return maps


def cross_validate(estimator_, param_maps: list[dict], train: DataFrame, label: str = "label", fold_col: str = "fold", parallelism: int = 4):
    """Cross-validation on given stratified folds, weighted F1; the
    model's ``foldMetrics`` are the F1 of each fold and point."""
    data = cut_lineage(train.select(label, FEATURES, fold_col))  # read by every fold and point
    k = data.agg(F.max(fold_col)).first()[0] + 1
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    cv = CrossValidator(estimator=estimator_, estimatorParamMaps=param_maps, evaluator=evaluator, foldCol=fold_col, numFolds=int(k),
                        parallelism=parallelism, seed=42)
    return cv.fit(data)


class GaussianVotes(StateModel):
    """Log densities of independent Gaussians, which are linear in the features and their squares."""

    def scores(self, x: Column) -> Column:
        v = self.values()
        return _linear(F.concat(x, F.transform(x, lambda c: c * c)), v["weights"], v["offsets"])


def gaussian_of(classes: dict[float, Total], steps: list[StateModel], at: np.ndarray, smoothing: float = 1e-9) -> GaussianVotes:
    """The Gaussian variant on features that ``steps`` have normalised, from the sums of each class (before normalising)."""
    pick, total = np.arange(len(at)), sum(c.rows for c in classes.values())
    scale = steps[-1].values() if steps and isinstance(steps[-1], Standardized) else {"mean": np.zeros(len(at)), "sd": np.ones(len(at))}
    m, s = np.array(scale["mean"]), np.array(scale["sd"])
    flat = s == 0  # tells no class from another
    s = np.where(flat, 1.0, s)
    weights, offsets = [], []
    for c in classes.values():
        mu, v = np.where(flat, 0, (c.mean[at, pick] - m) / s), np.where(flat, 1, c.var[at, pick] / s ** 2 + smoothing)
        weights.append([*(mu / v).tolist(), *(-0.5 / v).tolist()])
        offsets.append(float(np.log(c.rows / total) - 0.5 * np.sum(np.log(v) + mu ** 2 / v)))
    return GaussianVotes(state=json.dumps({"classes": list(classes), "weights": weights, "offsets": offsets}))


def gaussian_folds(train: DataFrame, label: str = "label", fold_col: str = "fold", power: bool = False) -> dict[int, PipelineModel]:
    """For each fold, the data steps and the Gaussian variant fitted on all others.

    The moments of each (fold, class) are added up once for all folds; those of
    "all but this fold" are the others' put together, so nothing of a held-out
    row enters what is fitted.
    """
    moments = Moments.of(train.where(F.col(label).isNotNull()), [fold_col, label], scaling.DEFAULT_LAMBDAS if power else (1.0,))
    out = {}
    for fold in sorted({k[0] for k in moments.sums}):
        rest = lambda k, fold=fold: k[0] != fold
        total = moments.total(rest)
        steps = data_steps(moments, total, power)
        at = moments.best_lambdas(total) if power else np.zeros(total.mean.shape[1], int)
        classes = {c: moments.total(lambda k, c=c: rest(k) and k[1] == c) for c in sorted({k[1] for k in moments.sums if rest(k)})}
        out[int(fold)] = PipelineModel(stages=[*steps, gaussian_of(classes, steps, at)])
    return out


def prepared(train: DataFrame, key: str, label: str = "label", normalize: bool = True, power: bool = True, balance: bool = True,
             seed: int = 42) -> tuple[DataFrame, list[StateModel]]:
    """The rows that models are fitted on (classes made equal, then H2 and H1), written once, and the fitted steps."""
    rows = cut_lineage(oversample(train, key, label, seed=seed)) if balance else train
    if not (normalize or power):
        return rows, []
    moments = Moments.of(rows, [], scaling.DEFAULT_LAMBDAS if power else (1.0,))
    steps = data_steps(moments, moments.total(), power, normalize)
    return cut_lineage(PipelineModel(stages=steps).transform(rows)), steps


def cross_validate_variant(name: str, train: DataFrame, n_features: int, n_classes: int, key: str, label: str = "label",
                           fold_col: str = "fold", **steps: bool) -> DataFrame:
    """Accuracy and F1 of a variant in every fold (one row each); ``steps`` as in
    :func:`prepared` (default: none) are fitted on the other folds each time."""
    data = cut_lineage(train)
    k = data.agg(F.max(fold_col)).first()[0] + 1
    chosen = {"normalize": False, "power": False, "balance": False} | steps
    quick = gaussian_folds(data, label, fold_col, chosen["power"]) if name == "nb" and chosen["normalize"] and not chosen["balance"] else {}
    out = None
    for i in range(k):
        if i in quick:
            model = quick[i]
        else:
            rows, own = prepared(data.where(F.col(fold_col) != i), key, label, **chosen)
            model = PipelineModel(stages=[*own, fit_variant(name, rows, n_features, n_classes, label, key=key)])
        rows = predict(model, data.where(F.col(fold_col) == i)).select(F.lit(i).alias(fold_col), F.col(label).alias("y"), F.col("prediction").alias("p"))
        out = rows if out is None else out.unionByName(rows)
    counts = out.groupBy(fold_col, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    return metrics.summary_by(counts, fold_col, "y", "p").select(fold_col, "accuracy", "f1_weighted").orderBy(fold_col)


def tune_tree(train: DataFrame, label: str = "label", fold_col: str = "fold", depths=(2, 4, 6, 8, 10), parallelism: int = 4):
    """I18 on the depth of one tree."""
    dt = DecisionTreeClassifier(labelCol=label, featuresCol=FEATURES, seed=42)
    return cross_validate(dt, ParamGridBuilder().addGrid(dt.maxDepth, list(depths)).build(), train, label, fold_col, parallelism)


def keep_if_better(base_acc: float, tuned_acc: float) -> dict:
    """Keep the tuned model only if test accuracy improves."""
    return {"use_tuned": tuned_acc > base_acc,
            "improvement_pct": (tuned_acc - base_acc) / base_acc * 100.0 if base_acc else None}


#: Columns of a model's metadata; anything else that is given is kept as text.
METADATA = "model string, target string, features array<string>, n_features int, rows long, tuned boolean, accuracy double, saved_at timestamp, other map<string,string>"


def save_model(spark, model, path: str, meta: dict) -> None:
    """Persist a fitted model (in a pipeline, if it isn't one) plus a one-row
    metadata table: name, target, feature names and number, rows, tuned flag,
    accuracy, time."""
    stage = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    stage.write().overwrite().save(f"{path}/model")
    names = meta.get("features")
    names = [str(n) for n in names] if isinstance(names, (list, tuple)) else None
    known = {"model", "target", "features", "n_features", "rows", "tuned", "accuracy"}
    size = meta.get("n_features", len(names) if names is not None else meta.get("features"))
    row = (meta.get("model"), meta.get("target"), names, size, meta.get("rows"), meta.get("tuned"), meta.get("accuracy"),
           datetime.now(timezone.utc).replace(tzinfo=None), {k: str(v) for k, v in meta.items() if k not in known})
    spark.createDataFrame([row], METADATA).write.mode("overwrite").parquet(f"{path}/metadata")


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def accuracy_of(model, test: DataFrame, label: str = "label") -> float:
    """J2/J6 of one model."""
    return metrics.accuracy(predict(model, test).select(F.col(label).cast("double").alias("y"), "prediction"), "y", "prediction").first()["accuracy"]


def training_flow(train: DataFrame, test: DataFrame, n_features: int, n_classes: int, key: str, path: str, names: Sequence[str] = VARIANTS,
                  label: str = "label", min_pct: float = 1.5, tune: Callable | None = None, meta: dict | None = None,
                  feature_names: Sequence[str] | None = None, normalize: bool = False, power: bool = False, balance: bool = False) -> dict:
    """E8 class filter -> data steps (H3, H2, H1) -> train all -> evaluate ->
    save the champion with its steps -> tune it -> keep the tuned one only if
    better, and save it, too.

    The steps are fitted on the training rows, once for all variants.
    ``tune(name, model, train)`` gets the rows before the steps and returns a
    tuned model or None.
    """
    from civicflow.operators.categories import min_share_filter
    train, test = (cut_lineage(t) for t in min_share_filter(train, test, label, min_pct))
    rows, steps = prepared(train, key, label, normalize, power, balance)
    with_steps = lambda m: PipelineModel(stages=[*steps, m]) if steps else m
    fitted = {n: (m and with_steps(m), t, e) for n, (m, t, e) in train_many(names, rows, n_features, n_classes, label, key=key).items()}
    board = cut_lineage(leaderboard(fitted, test, n_classes, label))
    first = board.first()
    best, model = first["model"], fitted[first["model"]][0]
    info = {"model": best, "target": label, "features": list(feature_names or [f"x{i}" for i in range(n_features)]), "rows": train.count(), **(meta or {})}
    spark = train.sparkSession
    save_model(spark, model, f"{path}/champion", info | {"tuned": False, "accuracy": first["accuracy"]})
    tuned = tune(best, model, train) if tune else None
    decision = {"use_tuned": False, "improvement_pct": None}
    if tuned is not None:
        accuracy = accuracy_of(tuned, test, label)
        decision = keep_if_better(accuracy_of(model, test, label), accuracy)
        if decision["use_tuned"]:
            save_model(spark, tuned, f"{path}/tuned", info | {"tuned": True, "accuracy": accuracy})
    return {"leaderboard": board, "champion": best, "model": tuned if decision["use_tuned"] else model, **decision}
