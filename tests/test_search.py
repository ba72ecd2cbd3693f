"""Staged scores, halving, early stopping, weights, the perceptron."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.sql import functions as F

from civicflow.operators import models, search


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, int(i % 3), rng.normal(size=3).tolist()) for i in range(240)]
    df = spark.createDataFrame([(i, float(x[0] * x[1] > 0), float(i % 3), i // 3 % 3, x) for i, _, x in data], "id long, label double, three double, fold int, x array<double>")
    return models.with_features(df, array_col="x").cache()


def test_trees_give_what_the_booster_gives(rows):
    m = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.3, seed=1).fit(rows)
    own = search.boosted_trees(m, 6, 0.0, [0.0, 1.0]).transform(rows)
    both = own.join(m.transform(rows).select("id", F.col("rawPrediction").alias("raw"), F.col("prediction").alias("p")), "id")
    for r in both.collect():
        assert r["p"] == r["prediction"] and np.allclose(r["raw"].toArray(), r["rawPrediction"])


@pytest.mark.parametrize("l2", [0.0, 3.0])
def test_stages_of_one_fit(rows, l2):
    full = GBTClassifier(maxIter=8, maxDepth=2, seed=1).fit(rows)
    staged = search.staged_f1(full, rows, [2, 5, 8], [l2, 7.0])
    for n in (2, 5, 8):
        small = GBTClassifier(maxIter=n, maxDepth=2, seed=1).fit(rows)
        out = search.boosted_trees(small, n, l2, [0.0, 1.0]).transform(rows)
        want = models.metrics.summary_metrics(out.select("label", "prediction"), "label", "prediction").first()["f1_weighted"]
        assert staged[n, l2] == pytest.approx(want, abs=1e-12)


def test_three_classes(rows):
    data = rows.withColumn("y", F.col("three"))
    m = OneVsRest(classifier=GBTClassifier(maxIter=2, maxDepth=2, seed=1), labelCol="y").fit(data)
    out = search.boosted_trees(m, 2, 0.0, [0.0, 1.0, 2.0]).transform(data)
    assert [r[0] for r in out.orderBy("id").select("prediction").collect()] == [r[0] for r in m.transform(data).orderBy("id").select("prediction").collect()]


def test_halving_and_early_stopping(rows):
    assert search.stopped({5: 0.5, 10: 0.7, 15: 0.7, 20: 0.9}, 20) == 10 and search.stopped({5: 0.5, 10: 0.4}, 5) == 5
    points = [{"learning_rate": r, "depth": d, "iterations": n, "l2_leaf_reg": 1} for r, d, n in ((1e-6, 1, 2), (0.3, 3, 4), (0.3, 3, 8), (0.2, 2, 4))]
    found = search.search_booster(rows, points, 2, patience=4)
    assert [len(s) for _, s in found.scores].count(3) == 1 and sorted(len(s) for _, s in found.scores) == [1, 1, 2, 3]
    assert found.point in points[1:] and found.fits <= 6
    assert search.fit_found(found, rows, 2).transform(rows).where("label = prediction").count() > 180


def test_weights_change_a_booster_as_copies_do(rows):
    heavy = rows.withColumn("w", F.when(F.col("label") == 1, 20.0).otherwise(1.0))
    plain, weighted = (models.estimator("gbc", 3, 2, weight_col=w).fit(heavy) for w in (None, "w"))
    ones = [models.predict(m, heavy).where("prediction = 1").count() for m in (plain, weighted)]
    assert ones[1] > ones[0]


def test_perceptron_learns_what_is_not_linear(rows):
    m = models.fit_variant("mlp", rows, 3, 2)
    assert models.accuracy_of(m, rows) > 0.85 > models.accuracy_of(models.fit_variant("logreg", rows, 3, 2), rows)


def test_tree_from_its_text(rows):
    from pyspark.ml.classification import DecisionTreeClassifier
    m = DecisionTreeClassifier(maxDepth=4, seed=1).fit(rows)

    def nested(nodes, at=0):
        n = nodes[at]
        if n["left"] < 0:
            return {"class": n["prediction"]}
        return {"feature": n["feature"], "threshold": n["threshold"], "left": nested(nodes, n["left"]), "right": nested(nodes, n["right"])}
    assert models.tree_of(m.toDebugString) == nested(models.node_table(m)[0])
    assert models.tree_of(DecisionTreeClassifier(maxDepth=0).fit(rows).toDebugString).keys() == {"class"}
