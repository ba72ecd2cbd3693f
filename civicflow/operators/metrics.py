"""Classification evaluation.

Everything derives from one aggregate: the (y, p) count table, whose size is
bounded by classes^2.  No metric looks at rows twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.operators.ranks import totals_before


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def pair_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n) of the pairs that occur; a null label or prediction is a label of its own."""
    return df.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n) for every pair of labels in the sorted union of true
    and predicted labels; absent pairs have n = 0.

    The result is the square of the labels by definition; the other metrics
    use only :func:`pair_counts`.
    """
    counts = pair_counts(df, y, p)
    labels = counts.agg(F.array_distinct(F.flatten(F.collect_list(F.array(F.col(y), F.col(p))))).alias("_l"))
    grid = labels.select(F.explode("_l").alias("_y"), "_l").select("_y", F.explode("_l").alias("_p"))
    return grid.join(counts, F.col("_y").eqNullSafe(counts[y]) & F.col("_p").eqNullSafe(counts[p]), "left").select(
        F.col("_y").alias(y), F.col("_p").alias(p), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class_table(counts: DataFrame, y: str, p: str) -> DataFrame:
    """label, tp, support (true count), predicted (predicted count)."""
    n, none = F.col("n"), F.lit(0).cast("long")
    true = counts.select(F.col(y).alias("label"), F.when(F.col(y).eqNullSafe(F.col(p)), n).otherwise(none).alias("tp"), n.alias("support"), none.alias("predicted"))
    said = counts.select(F.col(p).alias("label"), none.alias("tp"), none.alias("support"), n.alias("predicted"))
    return true.union(said).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per-class precision / recall / F1 / support, then 'macro avg' and
    'weighted avg' rows (undefined ratios are 0)."""
    t = per_class_table(pair_counts(df, y, p), y, p)
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    rows = t.select(F.col("label").cast("string").alias("label"), prec.alias("precision"), rec.alias("recall"),
                    "support")
    rows = rows.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                           F.col("precision") + F.col("recall")))
    total = F.sum("support")
    macro = rows.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), total.alias("support"), F.avg("f1").alias("f1"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"),
                        (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                        (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                        total.alias("support"),
                        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"))
    cols = ["label", "precision", "recall", "f1", "support"]
    return rows.select(cols).unionByName(macro.select(cols)).unionByName(weighted.select(cols))


def summary_by(counts: DataFrame, key: str, y: str, p: str) -> DataFrame:
    """J2/J4 for many models at once: one row per ``key`` with n, accuracy,
    Cohen's kappa, multi-class MCC and weighted precision / recall / F1,
    macro F1, from the counts ``(key, y, p, n)``."""
    n, none = F.col("n"), F.lit(0).cast("long")
    true = counts.select(key, F.col(y).alias("label"), F.when(F.col(y).eqNullSafe(F.col(p)), n).otherwise(none).alias("tp"), n.alias("support"),
                         none.alias("predicted"))
    said = counts.select(key, F.col(p).alias("label"), none.alias("tp"), none.alias("support"), n.alias("predicted"))
    t = true.union(said).groupBy(key, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    f1 = _safe_div(2 * prec * rec, prec + rec)
    a = t.groupBy(key).agg(
        F.sum("support").cast("double").alias("s"), F.sum("tp").cast("double").alias("c"),
        F.sum(F.col("predicted") * F.col("support")).cast("double").alias("pt"),
        F.sum(F.col("predicted") * F.col("predicted")).cast("double").alias("pp"),
        F.sum(F.col("support") * F.col("support")).cast("double").alias("tt"),
        F.sum(prec * F.col("support")).alias("wp"), F.sum(rec * F.col("support")).alias("wr"),
        F.sum(f1 * F.col("support")).alias("wf"), F.avg(f1).alias("f1_macro"))
    s, c = F.col("s"), F.col("c")
    po = c / s
    pe = F.col("pt") / (s * s)
    mcc_den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return a.select(
        key, s.cast("long").alias("n"), po.alias("accuracy"),
        F.when(pe != 1, (po - pe) / (1 - pe)).otherwise(F.lit(0.0)).alias("kappa"),
        _safe_div(c * s - F.col("pt"), mcc_den).alias("mcc"),
        (F.col("wp") / s).alias("precision_weighted"), (F.col("wr") / s).alias("recall_weighted"),
        (F.col("wf") / s).alias("f1_weighted"), "f1_macro")


def summary_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """J2/J4 of one model: see :func:`summary_by`."""
    return summary_by(pair_counts(df, y, p).withColumn("_one", F.lit(1)), "_one", y, p).drop("_one")


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows and share of equal label and prediction, for one model."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).eqNullSafe(F.col(p)).cast("double")).alias("accuracy"))


def auc_from_long(long_df: DataFrame, cls: str, pos: str, score: str) -> DataFrame:
    """J5 core: per class AUC by the rank-sum formula with average ranks for
    tied scores.  Input rows: (class, is_positive 0/1, score).

    Works on the (class, score) count table; ranks are distributed running
    totals, exact for any number of distinct scores.
    """
    g = long_df.groupBy(cls, score).agg(F.count(F.lit(1)).alias("n"), F.sum(pos).alias("npos"))
    g = totals_before(g, cls, F.col(score), "n")
    g = g.withColumn("_rank", F.col("_before") + (F.col("n") + 1) / 2.0)
    per = g.groupBy(cls).agg(F.sum(F.col("npos") * F.col("_rank")).alias("R"),
                             F.sum("npos").cast("double").alias("P"), F.sum("n").cast("double").alias("T"))
    Q = F.col("T") - F.col("P")
    auc = F.when((F.col("P") > 0) & (Q > 0), (F.col("R") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * Q))
    return per.select(cls, auc.alias("auc"), F.col("P").cast("long").alias("support"))


def auc_binary(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """J5 for a binary label and one score column."""
    return auc_from_long(df.select(F.lit(positive).alias("cls"), (F.col(y) == positive).cast("int").alias("pos"),
                                   F.col(score).cast("double").alias("score")), "cls", "pos", "score")


def auc_ovr(df: DataFrame, y: str, scores: str, classes: list) -> DataFrame:
    """J5 one-vs-rest: ``scores`` is an array column, index i scoring
    ``classes[i]``.  Rows per class plus a support-weighted 'weighted' row."""
    cls_arr = F.array(*[F.lit(c) for c in classes])
    long_df = (df.select(F.col(y), F.posexplode(scores).alias("_i", "_s"))
                 .select(F.element_at(cls_arr, F.col("_i") + 1).alias("cls"),
                         (F.col(y) == F.element_at(cls_arr, F.col("_i") + 1)).cast("int").alias("pos"),
                         F.col("_s").cast("double").alias("score")))
    per = auc_from_long(long_df, "cls", "pos", "score")
    weighted = per.agg(F.lit(None).cast(per.schema["cls"].dataType).alias("cls"),
                       (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"),
                       F.sum("support").alias("support"))
    return per.unionByName(weighted)
