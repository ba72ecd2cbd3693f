"""Catalogue: Spark ML variants on the ``embeddings`` table (I1-I19, J5 OvR).

Train / test = seeded-hash split of the vectors (80 / 20); features = the
embedding array as a dense vector; label = ``label``.  Results are
predictions on the test rows; what SQL can't follow has checks of its own
(a second fit, the majority baseline) with constant answers.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow import sources
from civicflow.operators import metrics, models, search, split
from civicflow.plans.catalog import register
from civicflow.session import cut_lineage, table

SEED = 42


def _data(spark, sf):
    """The labelled rows, written once: train, test, number of features and of classes."""
    e = table(spark, sf, "embeddings")
    e = models.with_features(e.withColumn("label", F.col("label").cast("double")), array_col="embedding")
    e = cut_lineage(e.withColumn("u", cf.hash_unit("vec_id", SEED)))
    d, k = e.agg(F.max(F.size("embedding")), F.max("label")).first()
    e = e.drop("embedding")
    return e.filter("u < 0.8").drop("u"), e.filter("u >= 0.8").drop("u"), d, int(k) + 1


def _pred(name):
    def run(spark, sf):
        train, test, d, k = _data(spark, sf)
        model = models.fit_variant(name, train, d, k, "label", SEED, key="vec_id")
        out = models.predict(model, test)
        return out.select("vec_id", F.col("label").cast("int").alias("label"),
                          F.col("prediction").cast("int").alias("prediction"), "confidence")
    run.__name__ = f"train_{name}"
    return run


_HASH_TEST = f"CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':{SEED}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"

register("train_dummy", f"""
WITH tr AS (SELECT label FROM embeddings WHERE {_HASH_TEST} < 0.8),
     m AS (SELECT label AS maj FROM tr GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT vec_id, label, maj AS prediction, CAST(NULL AS DOUBLE) AS confidence
FROM embeddings, m WHERE {_HASH_TEST} >= 0.8""")(_pred("dummy"))

for _name in ("dt", "rf", "gbc", "nb", "bernoulli_nb", "mlp", "lda", "qda", "ridge", "ada"):
    register(f"train_{_name}")(_pred(_name))

register("train_knn", f"""
WITH tr AS (SELECT vec_id, label, embedding FROM embeddings WHERE {_HASH_TEST} < 0.8),
     te AS (SELECT vec_id, label, embedding FROM embeddings WHERE {_HASH_TEST} >= 0.8),
     far AS (SELECT te.vec_id, tr.label AS vote, row_number() OVER (PARTITION BY te.vec_id
               ORDER BY list_sum([power(CAST(te.embedding[i] AS DOUBLE) - CAST(tr.embedding[i] AS DOUBLE), 2) FOR i IN range(1, len(te.embedding) + 1)]),
                        tr.vec_id) AS r FROM te JOIN tr ON true),
     votes AS (SELECT vec_id, vote, count(*) AS n FROM far WHERE r <= 5 GROUP BY vec_id, vote),
     best AS (SELECT vec_id, vote, n, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, vote) AS r FROM votes)
SELECT te.vec_id, te.label, best.vote AS prediction, best.n / 5.0::DOUBLE AS confidence
FROM te JOIN best ON best.vec_id = te.vec_id AND best.r = 1""")(_pred("knn"))

_NB_SQL = f"""
WITH tr AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE {_HASH_TEST} < 0.8),
     te AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE {_HASH_TEST} >= 0.8),
     n AS (SELECT label, count(*) AS n FROM embeddings WHERE {_HASH_TEST} < 0.8 GROUP BY label),
"""


@register("nb_labels", _NB_SQL + """
     m AS (SELECT label, i, avg(x) AS mu, var_pop(x) AS v FROM tr GROUP BY label, i),
     s AS (SELECT te.vec_id, m.label AS cls, ln(any_value(n.n)) - 0.5 * sum(ln(m.v) + (te.x - m.mu) * (te.x - m.mu) / m.v) AS score
           FROM te JOIN m ON te.i = m.i JOIN n ON n.label = m.label GROUP BY te.vec_id, m.label)
SELECT vec_id, CAST(arg_max(cls, score) AS INTEGER) AS prediction FROM s GROUP BY vec_id""")
def nb_labels(spark, sf):
    """I5 against the closed form."""
    return _pred("nb")(spark, sf).select("vec_id", "prediction")


@register("bernoulli_nb_labels", _NB_SQL + """
     m AS (SELECT tr.label, i, (sum(CAST(x > 0 AS INTEGER)) + 1) / (any_value(n.n) + 2.0::DOUBLE) AS q FROM tr JOIN n USING (label) GROUP BY tr.label, i),
     s AS (SELECT te.vec_id, m.label AS cls, ln(any_value(n.n) + 1) + sum(CASE WHEN te.x > 0 THEN ln(m.q) ELSE ln(1 - m.q) END) AS score
           FROM te JOIN m ON te.i = m.i JOIN n ON n.label = m.label GROUP BY te.vec_id, m.label)
SELECT vec_id, CAST(arg_max(cls, score) AS INTEGER) AS prediction FROM s GROUP BY vec_id""")
def bernoulli_nb_labels(spark, sf):
    """I6 against the closed form."""
    return _pred("bernoulli_nb")(spark, sf).select("vec_id", "prediction")


_CHECKED = ("dt", "rf", "gbc", "lda", "qda", "ridge", "ada")


@register("model_checks", "SELECT unnest([" + ", ".join(f"'{n}'" for n in _CHECKED) + "]) AS model, true AS every_row, true AS same_again, true AS not_below_base")
def model_checks(spark, sf):
    """I2-I12 without a closed form in SQL: a prediction for every test row, the
    same from a second fit, and at least the accuracy of the majority label
    (five stumps on ten classes: of chance) less the deviation of the test size."""
    train, test, d, k = _data(spark, sf)
    base = models.accuracy_of(models.fit_majority(train), test)
    n = test.count()
    rows = []
    for name in _CHECKED:
        first, again = (models.predict(models.fit_variant(name, train, d, k, key="vec_id"), test).select(
            "vec_id", "label", F.col("prediction").alias(p)) for p in ("a", "b"))
        both, same, acc = first.join(again.drop("label"), "vec_id").agg(
            F.count(F.lit(1)), F.bool_and(F.col("a") == F.col("b")), F.avg((F.col("a") == F.col("label")).cast("double"))).first()
        least = 1 / k if name == "ada" else base
        rows.append((name, both == n, bool(same), acc >= least - 2 * (least * (1 - least) / n) ** 0.5 - 0.02))
    return spark.createDataFrame(rows, "model string, every_row boolean, same_again boolean, not_below_base boolean")


@register("oversample", f"""
WITH tr AS (SELECT label FROM embeddings WHERE {_HASH_TEST} < 0.8 AND NOT (label = 1 AND vec_id % 3 <> 0)), c AS (SELECT label, count(*) AS n FROM tr GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, n AS given, (SELECT max(n) FROM c) - n AS synthetic FROM c""")
def oversample(spark, sf):
    """H3: rows per class after interpolation (class 1 thinned out before)."""
    train, _, _, _ = _data(spark, sf)
    out = models.oversample(train.where("not (label = 1 and vec_id % 3 <> 0)"), "vec_id")
    return out.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count_if(~F.col("synthetic")).alias("given"), F.count_if("synthetic").alias("synthetic"))


def _binary(spark, sf):
    """Labelled documents: quality from length and word numbers."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("a"),
        F.size(F.split("text", " ")).cast("double").alias("b"), F.size(F.array_distinct(F.split("text", " "))).cast("double").alias("c"),
        F.length(F.regexp_replace("text", "[a-z ]", "")).cast("double").alias("d"))
    return cut_lineage(models.with_features(d, ["a", "b", "c", "d"]))


@register("boosted_checks", "SELECT unnest(['catboost', 'xgboost']) AS model, true AS every_row, true AS loss_falls, true AS better_than_chance")
def boosted_checks(spark, sf):
    """I4: the two large boosters on a binary label, split class by class: a
    prediction for every test row; the log loss on the training rows is never
    above that of the first tree (looked at after each tenth of the trees) and
    below it in the end; and where both classes occur the training rows are
    ranked better than by chance."""
    rows = cut_lineage(split.stratified_fold_ids(_binary(spark, sf), "doc_id", "label", k=4, seed=SEED))
    train, test = rows.where("fold <> 1"), rows.where("fold = 1")
    n, both, out = test.count(), train.select("label").distinct().count() == 2, []
    for name in ("catboost", "xgboost"):
        model = models.fit_variant(name, train, 4, 2)
        given = models.predict(model, test).agg(F.count("prediction")).first()[0]
        losses = model.evaluateEachIteration(train)
        at = [losses[i * (len(losses) - 1) // 10] for i in range(11)]
        auc = metrics.auc_binary(model.transform(train).withColumn("s", vector_to_array("probability")[1]), "label", "s").first()["auc"]
        out.append((name, given == n, max(at) <= at[0] and (at[-1] < at[0] or not both), not both or auc > 0.5))
    return spark.createDataFrame(out, "model string, every_row boolean, loss_falls boolean, better_than_chance boolean")


@register("train_weighted")
def train_weighted(spark, sf):
    """Reweighing weights (K8, group = label parity) as weightCol of a logistic model."""
    from civicflow.operators.fairness import reweigh
    train, test, d, k = _data(spark, sf)
    train = reweigh(train.withColumn("grp", (F.col("vec_id") % 2).cast("int")), ["grp"], "label")
    model = models.estimator("logreg", d, k, "label", SEED, weight_col="weight").fit(train)
    return models.predict(model, test).select("vec_id", F.col("label").cast("int").alias("label"),
                                              F.col("prediction").cast("int").alias("prediction"), "confidence")


@register("train_weighted_boosted")
def train_weighted_boosted(spark, sf):
    """The same weights (K8, by language) for a booster."""
    from civicflow.operators.fairness import reweigh
    rows = _binary(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    train = cut_lineage(reweigh(rows.where("doc_id % 4 <> 1"), ["lang"], "label"))
    model = models.estimator("gbc", 4, 2, "label", SEED, weight_col="weight").fit(train)
    return models.predict(model, rows.where("doc_id % 4 = 1")).select("doc_id", F.col("label").cast("int").alias("label"),
                                                                      F.col("prediction").cast("int").alias("prediction"), "confidence")


# All variants but the two large boosters, whose one-vs-rest fits on ten
# classes take minutes (boosted_checks runs them on two).
BOARD = tuple(v for v in models.VARIANTS if v not in ("xgboost", "catboost", "mlp"))


@register("leaderboard", "SELECT unnest([" + ", ".join(f"'{n}'" for n in (*BOARD, "unknown")) + "]) AS model, unnest([" + ", ".join(
    ["true"] * len(BOARD) + ["false"]) + "]) AS scored, unnest([" + ", ".join(["false"] * len(BOARD) + ["true"]) + "]) AS failed")
def leaderboard(spark, sf):
    """Every variant has a row; one that can't be fitted has its error."""
    train, test, d, k = _data(spark, sf)
    board = models.leaderboard(models.train_many([*BOARD, "unknown"], train, d, k, key="vec_id"), test, k)
    scores = ("accuracy", "auc", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro")
    good = F.lit(True)
    for c in scores:
        good = good & F.coalesce(F.col(c).between(0, 1), F.lit(False))
    return board.select("model", good.alias("scored"), F.col("error").isNotNull().alias("failed"))


_FOLDS_SQL = f"""
WITH f AS (SELECT vec_id, label, embedding, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{SEED}'), vec_id) - 1) % 5 AS fold
           FROM embeddings WHERE {_HASH_TEST} < 0.8),
     x AS (SELECT vec_id, label, fold, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM f),
     h AS (SELECT DISTINCT fold AS h FROM f),
     s AS (SELECT h, i, avg(x) AS m, stddev_pop(x) AS sd FROM h JOIN x ON x.fold <> h GROUP BY h, i),
     z AS (SELECT s.h, x.vec_id, x.label, x.fold, x.i, (x.x - s.m) / s.sd AS z FROM x JOIN s ON s.i = x.i),
     m AS (SELECT h, label AS cls, i, avg(z) AS mu, var_pop(z) + 1e-9 AS v FROM z WHERE fold <> h GROUP BY h, label, i),
     n AS (SELECT h, label AS cls, count(*) AS n FROM h JOIN f ON f.fold <> h GROUP BY h, label),
     sc AS (SELECT z.h, z.vec_id, z.label, m.cls, ln(any_value(n.n)) - 0.5 * sum(ln(m.v) + (z.z - m.mu) * (z.z - m.mu) / m.v) AS score
            FROM z JOIN m ON m.h = z.h AND m.i = z.i JOIN n ON n.h = m.h AND n.cls = m.cls WHERE z.fold = z.h GROUP BY z.h, z.vec_id, z.label, m.cls),
     p AS (SELECT h, vec_id, label AS y, arg_max(cls, score) AS p FROM sc GROUP BY h, vec_id, label),
     c AS (SELECT h, c, count_if(y = c) AS sup, count_if(p = c) AS pre, count_if(y = c AND p = c) AS tp
           FROM p JOIN (SELECT DISTINCT label AS c FROM f) k ON true GROUP BY h, c),
     r AS (SELECT h, sum(tp) / sum(sup) AS accuracy,
                  sum(sup * CASE WHEN sup + pre > 0 THEN 2.0::DOUBLE * tp / (sup + pre) ELSE 0 END) / sum(sup) AS f1_weighted FROM c GROUP BY h)
SELECT CAST(h AS VARCHAR) AS fold, round(accuracy, 9) AS accuracy, round(f1_weighted, 9) AS f1_weighted FROM r
UNION ALL SELECT 'mean', round(avg(accuracy), 9), round(avg(f1_weighted), 9) FROM r
UNION ALL SELECT 'std', round(stddev_pop(accuracy), 9), round(stddev_pop(f1_weighted), 9) FROM r"""


@register("fold_metrics", _FOLDS_SQL)
def fold_metrics(spark, sf):
    """Per-fold metrics of the normalised Gaussian variant with mean and deviation; the normalisation is fitted on the other folds each time."""
    train, _, d, k = _data(spark, sf)
    folds = split.stratified_fold_ids(train, "vec_id", "label", k=5, seed=SEED)
    scores = models.cross_validate_variant("nb", folds, d, k, "vec_id", normalize=True)
    out = split.fold_summary(scores, ["accuracy", "f1_weighted"])
    return out.select("fold", F.round("accuracy", 9).alias("accuracy"), F.round("f1_weighted", 9).alias("f1_weighted"))


@register("tuned")
def tuned(spark, sf):
    """CV over tree depth with stratified folds, kept only if better on test."""
    train, test, d, k = _data(spark, sf)
    folds = split.stratified_fold_ids(train, "vec_id", "label", k=5, seed=SEED)
    cv = models.tune_tree(folds, depths=(2, 4, 8), parallelism=4)
    base = models.fit_variant("dt", train, d, k)
    a0, a1 = (models.accuracy_of(m, test) for m in (base, cv.bestModel))
    decision = models.keep_if_better(a0, a1)
    best_depth = cv.bestModel.getOrDefault("maxDepth")
    return spark.createDataFrame([(float(a0), float(a1), int(best_depth), bool(decision["use_tuned"]),
                                   decision["improvement_pct"])],
                                 "base_accuracy double, tuned_accuracy double, best_depth int, use_tuned boolean, "
                                 "improvement_pct double")


#: The champion's grid with fewer and shallower trees, for a query that runs in seconds.
_SEARCHED = {"learning_rate": [0.01, 0.05, 0.1, 0.15, 0.2], "depth": [2, 3], "iterations": [4, 8, 12], "l2_leaf_reg": [1, 3, 5, 7, 9]}


@register("tuned_booster", """
SELECT 10 AS draws, true AS fewer_fits_than_all, true AS best_of_the_last, true AS trees_as_drawn, true AS same_after_loading, true AS same_as_its_booster""")
def tuned_booster(spark, sf):
    """Ten draws for a booster on the labelled documents; the chosen one saves and loads, and without
    regularisation its trees give what Spark's own booster gives."""
    rows = cut_lineage(split.stratified_fold_ids(_binary(spark, sf), "doc_id", "label", k=4, seed=SEED))
    points = models.draw_points(_SEARCHED, 10, SEED)
    found = search.search_booster(rows, points, 2, patience=4)
    chosen = search.fit_found(found, rows, 2)
    path = sources.scratch_path(spark, "tuned-booster")
    models.save_model(spark, chosen, path, {"model": "catboost", "target": "label", "tuned": True})
    again = models.load_pipeline(path).transform(chosen.transform(rows).select("doc_id", "features", F.col("prediction").alias("first")))
    last = [sum(s) / len(s) for _, s in found.scores if len(s) == 4]
    best = next(sum(s) / len(s) for p, s in found.scores if p == found.point)
    gbt = GBTClassifier(maxIter=5, maxDepth=3, seed=SEED).fit(rows)
    plain = search.boosted_trees(gbt, 5, 0.0, [0.0, 1.0]).transform(gbt.transform(rows).select("features", F.col("prediction").alias("own")))
    return spark.createDataFrame([(len(points), found.fits < 4 * len(points), best == max(last), 0 < found.trees <= found.point["iterations"],
                                   again.where("first <> prediction").isEmpty(), plain.where("own <> prediction").isEmpty())],
                                 "draws int, fewer_fits_than_all boolean, best_of_the_last boolean, trees_as_drawn boolean, same_after_loading boolean, same_as_its_booster boolean")


@register("training_flow", f"""
WITH e AS (SELECT vec_id, label, embedding, {_HASH_TEST} < 0.8 AS tr FROM embeddings),
     x AS (SELECT vec_id, label, tr, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM e),
     s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM x WHERE tr GROUP BY i),
     z AS (SELECT vec_id, label, tr, x.i, (x - m) / sd AS z FROM x JOIN s ON s.i = x.i),
     m AS (SELECT label AS cls, i, avg(z) AS mu, var_pop(z) AS v FROM z WHERE tr GROUP BY label, i),
     n AS (SELECT label AS cls, count(*) AS n FROM e WHERE tr GROUP BY label),
     sc AS (SELECT z.vec_id, z.label, m.cls, ln(any_value(n.n)) - 0.5 * sum(ln(m.v) + (z.z - m.mu) * (z.z - m.mu) / m.v) AS score
            FROM z JOIN m ON m.i = z.i JOIN n ON n.cls = m.cls WHERE NOT tr GROUP BY z.vec_id, z.label, m.cls),
     maj AS (SELECT cls FROM n ORDER BY n DESC, cls LIMIT 1),
     p AS (SELECT 'nb' AS model, label AS y, arg_max(cls, score) AS p FROM sc GROUP BY vec_id, label
           UNION ALL SELECT 'dummy', label, cls FROM e, maj WHERE NOT tr),
     c AS (SELECT model, cls, count_if(y = cls) AS sup, count_if(p = cls) AS pre, count_if(y = cls AND p = cls) AS tp FROM p, (SELECT DISTINCT label AS cls FROM e) GROUP BY ALL),
     r AS (SELECT model, sum(tp) / sum(sup) AS accuracy, sum(sup * CASE WHEN sup + pre > 0 THEN 2.0::DOUBLE * tp / (sup + pre) ELSE 0 END) / sum(sup) AS f1 FROM c GROUP BY model),
     best AS (SELECT arg_max(model, f1) AS model, arg_max(accuracy, f1) AS accuracy FROM r)
SELECT r.model, round(r.accuracy, 9) AS accuracy, r.model = best.model AS champion, 'label' AS target, 64 AS n_features,
       (SELECT count(*) FROM e WHERE tr) AS rows, false AS tuned, round(best.accuracy, 9) AS loaded_accuracy,
       (SELECT accuracy FROM r WHERE model = 'dummy') > best.accuracy AS use_tuned FROM r, best""")
def training_flow(spark, sf):
    """Filter, normalise, train, rank, save, load again, with its metadata; the majority stands in for a tuned model."""
    train, test, d, k = _data(spark, sf)
    path = sources.scratch_path(spark, "training")
    found = models.training_flow(train, test, d, k, "vec_id", path, ("dummy", "nb"), normalize=True,
                                 tune=lambda name, model, rows: models.fit_majority(rows))
    loaded = models.accuracy_of(models.load_pipeline(f"{path}/champion"), test)
    meta = spark.read.parquet(f"{path}/champion/metadata").select("target", "n_features", "rows", "tuned")
    board = found["leaderboard"].select("model", F.round("accuracy", 9).alias("accuracy"), (F.col("model") == found["champion"]).alias("champion"))
    return board.join(F.broadcast(meta.withColumns({"loaded_accuracy": F.round(F.lit(loaded), 9), "use_tuned": F.lit(found["use_tuned"])})))  # one row


@register("auc_ovr_model")
def auc_ovr_model(spark, sf):
    """J5 one-vs-rest AUC from a model's class probabilities."""
    train, test, d, k = _data(spark, sf)
    model = models.fit_variant("nb", train, d, k)
    pred = model.transform(test).withColumn("_prob", vector_to_array("probability"))
    return metrics.auc_ovr(pred.withColumn("label", F.col("label").cast("int")), "label", "_prob", list(range(k)))
