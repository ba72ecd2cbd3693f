"""A1/B1/B3 raw CSV path, A11 model persistence."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from civicflow import sources
from civicflow.operators import models


def test_raw_csv_scan_parse_and_filter(spark, tmp_path):
    header = ",".join(f'"{c}"' for c in sources.RAW_TICKET_COLUMNS)
    lines = [header,
             '01/31/2023 10:15:00 PM,02/01/2023 01:00:00 AM,NYPD,Noise - Residential,Loud Music,Street/Sidewalk,10001,MANHATTAN,,x',
             '12/31/2021 11:59:59 PM,01/01/2022 12:00:00 AM,DSNY,Dirty,Trash,Street/Sidewalk,11201,BROOKLYN,,x',
             'garbage,02/01/2023 01:00:00 AM,DOT,Street Condition,Pothole,Street/Sidewalk,11375,QUEENS,,x',
             '06/15/2024 08:00:00 AM,06/15/2024 09:00:00 AM,DEP,,Water,Street/Sidewalk,10301,STATEN ISLAND,,x']
    p = tmp_path / "tickets.csv"
    p.write_text("\n".join(lines) + "\n")
    raw = sources.read_tickets_csv(spark, str(p))
    assert sources.preview(raw, 2).count() == 2
    t = sources.prepare_raw_tickets(raw).collect()
    # 2021 row is outside the years, the unparseable date and the null class are dropped
    assert [r["Agency"] for r in t] == ["NYPD"]
    assert t[0]["Created Date"].hour == 22 and t[0]["Closed Date"].day == 1


def test_model_save_and_load(spark, tmp_path):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").withColumn("label", F.col("label").cast("double"))
    e = models.with_features(e, array_col="embedding")
    m = models.estimator("dt", 64, 10).fit(e)
    from pyspark.ml import PipelineModel
    pm = PipelineModel(stages=[m])
    path = str(tmp_path / "model")
    models.save_model(spark, pm, path, {"features": 64, "target": "label", "tuned": False})
    back = models.load_pipeline(path)
    a = [r.prediction for r in pm.transform(e).orderBy("vec_id").collect()]
    b = [r.prediction for r in back.transform(e).orderBy("vec_id").collect()]
    assert a == b
    assert spark.read.parquet(f"{path}/metadata").count() == 1


def test_every_own_model_saves_loads_and_takes_weights(spark, tmp_path):
    import numpy as np
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").withColumn("label", (F.col("label") % 3).cast("double"))
    e = models.with_features(e, array_col="embedding").withColumn("w", 1.0 + F.col("vec_id") % 2)
    doubled = e.union(e.where("vec_id % 2 = 1"))
    for name in ("dummy", "lda", "qda", "ridge", "ada", "knn"):
        m = models.fit_variant(name, e, 64, 3, key="vec_id")
        models.save_model(spark, m, str(tmp_path / name), {"model": name})
        a, b = ([(r.prediction, r.confidence) for r in models.predict(x, e).orderBy("vec_id").collect()]
                for x in (m, models.load_pipeline(str(tmp_path / name))))
        assert a == b
        assert all(c is None or 0 < c <= 1 for _, c in a)
        if name in ("lda", "qda", "ridge"):
            # a row of weight 2 counts as two rows
            one, two = models.fit_variant(name, e, 64, 3, weight_col="w"), models.fit_variant(name, doubled, 64, 3)
            s1, s2 = ([r.rawPrediction for r in models.predict(x, e).orderBy("vec_id").collect()] for x in (one, two))
            assert np.allclose(s1, s2)


def test_ridge_equals_the_normal_equations(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 * rng.standard_normal(300) > 0.2).astype(float)
    df = models.with_features(spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "label double, x array<double>"), array_col="x")
    got = models.fit_ridge(df, alpha=2.0).values()
    t = 2 * y - 1
    xc = x - x.mean(axis=0)
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ (t - t.mean()))
    assert np.allclose(got["weights"][1], want) and np.isclose(got["offsets"][1], t.mean() - x.mean(axis=0) @ want)


def test_oversampled_points_lie_between_rows_of_their_class(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 10 == 0), [float(v) for v in rng.standard_normal(2) + 10 * (i % 10 == 0)]) for i in range(100)]
    df = models.with_features(spark.createDataFrame(rows, "id long, label double, x array<double>"), array_col="x")
    out = models.oversample(df, "id").collect()
    new = np.array([r.features.toArray() for r in out if r.synthetic])
    given = np.array([x for _, y, x in rows if y == 1])
    assert len(new) == 80 and (new >= given.min(axis=0)).all() and (new <= given.max(axis=0)).all()


def test_neighbours_in_many_blocks_equal_all_pairs(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(models, "BLOCK", 37)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 4)).round(1)
    x[::3] = x[0]  # a third of all rows are equal
    rows = [(i // 2, float(i % 5), [float(v) for v in x[i]]) for i in range(400)]
    df = models.with_features(spark.createDataFrame(rows, "id long, label double, x array<double>"), array_col="x")
    train, test = df.where("id < 150"), df.where("id >= 150")
    model = models.fit_neighbours(train, "id", 5)
    assert "rows" in model.values() and len(model.getOrDefault("state")) < 1000  # no rows on the driver
    got = sorted((r.id, r.label, tuple(r.x), r.confidence) for r in models.predict(model, test).collect())
    far = ((x[300:, None] - x[None, :300]) ** 2).sum(axis=2)
    want = []
    for i, d in enumerate(far):
        order = sorted(range(300), key=lambda j: (d[j], j // 2, j))[:5]
        votes = np.bincount([int(rows[j][1]) for j in order], minlength=5)
        want.append((rows[300 + i][0], rows[300 + i][1], tuple(rows[300 + i][2]), votes.max() / 5))
    assert len(got) == 100 and got == sorted(want)


def test_more_than_100000_rows_have_neighbours_and_samples(spark):
    df = spark.range(100_300).selectExpr("id", "cast(id % 400 < 3 as double) as label", "array(cast(id as double), cast(id % 7 as double)) as x")
    df = models.with_features(df, array_col="x")
    out = models.predict(models.fit_neighbours(df, "id", 1), df.where("id % 5000 = 1")).collect()
    assert len(out) == 21 and all(r.prediction == r.label for r in out)
    counts = {(r.label, r.synthetic): r["count"] for r in models.oversample(df, "id").groupBy("label", "synthetic").count().collect()}
    small = sum(i % 400 < 3 for i in range(100_300))
    assert counts == {(0.0, False): 100_300 - small, (1.0, False): small, (1.0, True): 100_300 - 2 * small}


def test_oversampled_partners_are_among_the_nearest(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(models, "BLOCK", 16)
    rows = [(i, 0.0 if i < 200 else 1.0 if i < 260 else 2.0, [float(i * i % 977), float(i % 13)]) for i in range(261)]
    df = models.with_features(spark.createDataFrame(rows, "id long, label double, x array<double>"), array_col="x")
    made = [r for r in models.oversample(df, "id", k=3).collect() if r.synthetic]
    assert sum(r.label == 1 for r in made) == 140 and sum(r.label == 2 for r in made) == 199
    assert sorted(np.bincount([r.id - 200 for r in made if r.label == 1], minlength=60)) == [2] * 40 + [3] * 20
    x = np.array([r[2] for r in rows])
    for r in made:
        own = [i for i in range(261) if rows[i][1] == r.label and i != r.id] or [r.id]
        near = sorted(own, key=lambda i: ((x[i] - x[r.id]) ** 2).sum())
        least = sorted(((x[i] - x[r.id]) ** 2).sum() for i in near)[:3][-1]
        p = r.features.toArray() - x[r.id]
        assert any(((x[i] - x[r.id]) ** 2).sum() <= least and abs(np.cross([*p, 0], [*(x[i] - x[r.id]), 0])).max() < 1e-6
                   and -1e-9 <= p @ (x[i] - x[r.id]) <= ((x[i] - x[r.id]) ** 2).sum() + 1e-9 for i in near)


def test_a_booster_that_learns_nothing_fails_its_checks(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from civicflow.plans.catalog import models as catalog

    class Backwards:
        def transform(self, df):
            p = F.array(F.col("label"), 1 - F.col("label"))
            return df.withColumn("prediction", 1 - F.col("label")).withColumn("probability", array_to_vector(p))

        def evaluateEachIteration(self, df):  # noqa: N802 - name of pyspark.ml
            return [0.5, 0.6, 0.7]
    monkeypatch.setattr(models, "fit_variant", lambda *a, **k: Backwards())
    assert [tuple(r) for r in catalog.boosted_checks(spark, SF_SMALL).collect()] == [("catboost", True, False, False), ("xgboost", True, False, False)]


def test_failed_variant_is_a_row(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").withColumn("label", (F.col("label") % 2).cast("double"))
    e = models.with_features(e, array_col="embedding")
    board = {r.model: r for r in models.leaderboard(models.train_many(["dummy", "nonsense"], e, 64, 2), e, 2).collect()}
    assert "nonsense" in board["nonsense"].error and board["dummy"].accuracy >= 0.5


def test_raw_csv_by_name_with_quotes_and_breaks(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text('Unique Key,Agency,"Complaint Type",Created Date\n1,"A ""B"", C","two\nlines",x\n2,D,,y\n')
    rows = sources.read_tickets_csv(spark, str(p), ["Created Date", "Complaint Type", "Agency"]).collect()
    assert [tuple(r) for r in rows] == [("x", "two\nlines", 'A "B", C'), ("y", None, "D")]
    dim = sources.read_dimension_csv(spark, str(p), "Agency string, `Unique Key` int").collect()
    assert [tuple(r) for r in dim] == [('A "B", C', 1), ("D", 2)]
