"""Steps that save, and data steps that see the rows of the fit alone."""

import json
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from conftest import SF_SMALL
from civicflow.operators import categories, models, profile, scaling, stages
from civicflow.plans.catalog import scoring as cat


def vectors(spark, n=240, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = [(i, float(i % 3), int(i // 3 % 4), [float(v) for v in np.append(rng.normal(loc=shift + i % 3, size=2), [np.exp(rng.normal()), 5.0])]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label double, fold int, x array<double>")
    return models.with_features(df, array_col="x"), np.array([r[3] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def llf(x, lam):
    y = stages._psi(x, lam)
    return -len(x) / 2 * math.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_moments_equal_numpy(spark):
    df, x, y, fold = vectors(spark, shift=1000.0)
    m = stages.Moments.of(df, ["fold", "label"], scaling.DEFAULT_LAMBDAS)
    assert len(m.sums) == 12
    keep = (fold != 2) & (y == 1)
    _, n, _, mean, var = m.total(lambda k: k[0] != 2 and k[1] == 1)
    for i, lam in enumerate(scaling.DEFAULT_LAMBDAS):
        for d in range(4):
            own = stages._psi(x[keep, d], lam)
            assert n[d] == keep.sum() and mean[i, d] == pytest.approx(own.mean(), rel=1e-9) and var[i, d] == pytest.approx(own.var(), rel=1e-6, abs=1e-9)


def test_power_and_standard_steps(spark):
    df, x, _, _ = vectors(spark)
    fitted = Pipeline(stages=[stages.PowerTransform(), stages.Standardize()]).fit(df)
    out = np.array([r[0].toArray() for r in fitted.transform(df).orderBy("id").select("features").collect()])
    for d in range(3):
        lam = min(scaling.DEFAULT_LAMBDAS, key=lambda v: (-llf(x[:, d], v), v))
        own = stages._psi(x[:, d], lam)
        assert np.allclose(out[:, d], (own - own.mean()) / own.std(), atol=1e-9)
    assert not out[:, 3].any()  # no spread


def test_missing_values_count_nowhere(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    z = scaling.ZScore(["x"]).fit(df)
    assert z.stats == {"x": (2.0, 1.0)}
    got = [r[0] for r in z.transform(df).collect()]
    assert got[:2] == [-1.0, 1.0] and math.isnan(got[2]) and got[3] is None
    v = models.with_features(spark.createDataFrame([([1.0, float("nan")],), ([3.0, 4.0],)], "x array<double>"), array_col="x")
    state = stages.Standardize().fit(v).values()
    assert state == {"mean": [2.0, 4.0], "sd": [1.0, 0.0]}


def test_held_out_rows_change_nothing_that_is_fitted(spark):
    df, *_ = vectors(spark)
    wild = df.withColumn("features", F.when(F.col("fold") == 1, models.array_to_vector(F.array(*[F.lit(1e3 * i) for i in (9, -7, 5, 3)]))).otherwise(F.col("features")))
    for power in (False, True):
        a, b = models.gaussian_folds(df, power=power), models.gaussian_folds(wild, power=power)
        for s, t in zip(a[1].stages, b[1].stages, strict=True):
            for key, value in s.values().items():
                assert np.allclose(np.array(value), np.array(t.values()[key]), rtol=1e-12, atol=1e-12), (power, key)
        assert any(not np.allclose(np.array(v), np.array(b[0].stages[-1].values()[k])) for k, v in a[0].stages[-1].values().items())


def test_fold_by_subtraction_equals_a_fit_of_its_own(spark):
    df, *_ = vectors(spark)
    for fold, model in models.gaussian_folds(df, power=True).items():
        rest = df.where(F.col("fold") != fold)
        rows, steps = models.prepared(rest, "id", balance=False)
        for s, t in zip(model.stages, steps, strict=False):
            for key, value in s.values().items():
                assert np.allclose(value, t.values()[key], atol=1e-6)
        plain = models.fit_variant("nb", rows, 4, 3)
        test = df.where(F.col("fold") == fold)
        a = [r["prediction"] for r in model.transform(test).orderBy("id").collect()]
        b = [r["prediction"] for r in plain.transform(PipelineModel(stages=steps).transform(test)).orderBy("id").collect()]
        assert a == b


def test_classes_are_made_equal_inside_the_fold(spark):
    df, *_ = vectors(spark)
    thin = df.where("label <> 2 or id % 2 = 0")
    rows, steps = models.prepared(thin, "id")
    assert {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} == {0.0: 80, 1.0: 80, 2.0: 80}
    assert [type(s).__name__ for s in steps] == ["Powered", "Standardized"]
    inner = Pipeline(stages=[stages.Standardize(), models.estimator("dt", 4, 3)])
    assert stages.OverSampled(inner, "id").fit(thin).transform(df).count() == df.count()
    scores = models.cross_validate_variant("nb", thin, 4, 3, "id", normalize=True, power=True, balance=True).collect()
    assert len(scores) == 4 and all(0 <= r["accuracy"] <= 1 for r in scores)


def test_preparation_saves_and_loads(spark, tmp_path):
    found = cat._prepared(spark, SF_SMALL)
    found.pipeline.write().overwrite().save(str(tmp_path / "prep"))
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "3")
    loaded = PipelineModel.load(str(tmp_path / "prep"))
    again = loaded.transform(cat._raw_tickets(spark, SF_SMALL))
    assert again.columns == found.features.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, found.features.collect()))


def test_every_fitted_operator_is_a_stage_that_saves(spark, tmp_path):
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("holes"))
    for i, own in enumerate([categories.TopNBucketer("p_brand", 3), categories.TopNEncoder("p_brand", 3), categories.DenseCodes(["p_brand"]), categories.RareBucketer("p_brand", 5.0),
                             categories.IQRCapper(["size"]), profile.NullImputer(["holes"]), scaling.ZScore(["size"]), scaling.YeoJohnsonGrid(["size"])]):
        fitted = own.fit(p)
        stages.step_of(fitted).save(str(tmp_path / str(i)))
        back = stages.Step.load(str(tmp_path / str(i)))
        assert sorted(map(str, back.transform(p).collect())) == sorted(map(str, fitted.transform(p).collect())), type(own)


def test_unseen_values_can_end_the_job(spark):
    seen, other = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("c",)], "k string")
    assert categories.DenseCodes(["k"]).fit(seen).transform(other).first()[0] is None
    strict = categories.DenseCodes(["k"], unseen="error").fit(seen)
    assert strict.transform(seen).count() == 2
    with pytest.raises(Exception, match="k: unseen value c"):
        strict.transform(other).collect()


def test_metadata_has_columns(spark, tmp_path):
    df, *_ = vectors(spark)
    models.save_model(spark, models.fit_majority(df), str(tmp_path / "m"), {"model": "dummy", "target": "label", "features": ["a", "b"], "rows": 240, "tuned": False, "seed": 42})
    r = spark.read.parquet(str(tmp_path / "m/metadata")).first()
    assert (r["model"], r["target"], r["features"], r["n_features"], r["rows"], r["tuned"], r["other"]) == ("dummy", "label", ["a", "b"], 2, 240, False, {"seed": "42"})
    assert r["saved_at"] is not None


def test_json_state_round_trip():
    assert json.loads(stages.Standardized(state='{"mean": [1.0], "sd": [2.0]}').getOrDefault("state")) == {"mean": [1.0], "sd": [2.0]}
