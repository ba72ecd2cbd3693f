"""Group fairness audit.

All measures come from one aggregate N(group..., y, p): its size is
groups x classes^2, independent of the row count.  Per-class one-vs-rest
numbers are sums over that cube.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow.operators.ranks import totals_before
from civicflow.session import cut_lineage

DPD = "demographic_parity_difference"
EOD = "equalized_odds_difference"
DIR = "disparate_impact_ratio"


def fairness_cube(df: DataFrame, y: str, p: str, group_cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*group_cols, y, p).agg(F.count(F.lit(1)).alias("n"))


def _classes(df: DataFrame, y: str, classes):
    if classes is not None:
        return list(classes)
    return [r[0] for r in df.select(y).distinct().orderBy(y).collect()]  # bounded: one row per class


def group_rates(df: DataFrame, y: str, p: str, group_cols: Sequence[str], classes=None,
                cube: DataFrame | None = None) -> DataFrame:
    """K1: per (class, group...): rows, selection rate (share with p == class),
    true-positive rate and false-positive rate (0 when undefined)."""
    cube = cube if cube is not None else fairness_cube(df, y, p, group_cols)
    cls = _classes(cube, y, classes)
    t = cube.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in cls])))
    is_y, is_p = F.col(y) == F.col("cls"), F.col(p) == F.col("cls")
    n = F.col("n")
    agg = t.groupBy("cls", *group_cols).agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(is_p, n).otherwise(0)).alias("selected"),
        F.sum(F.when(is_y, n).otherwise(0)).alias("positives"),
        F.sum(F.when(is_y & is_p, n).otherwise(0)).alias("tp"),
        F.sum(F.when(~is_y & is_p, n).otherwise(0)).alias("fp"))
    neg = F.col("rows") - F.col("positives")
    return agg.select(
        "cls", *group_cols, "rows",
        (F.col("selected") / F.col("rows")).alias("selection_rate"),
        F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(F.lit(0.0)).alias("tpr"),
        F.when(neg > 0, F.col("fp") / neg).otherwise(F.lit(0.0)).alias("fpr"))


def per_class_metrics(df: DataFrame, y: str, p: str, group_cols: Sequence[str], classes=None,
                      digits: int | None = 3) -> DataFrame:
    """K2-K6: per class: demographic parity difference and equalised odds
    difference over the tuple of ``group_cols``; disparate impact ratio over
    the *first* group column only (null when the largest rate is 0)."""
    cube = fairness_cube(df, y, p, group_cols)
    cls = _classes(cube, y, classes)
    rates = group_rates(df, y, p, group_cols, cls, cube=cube)
    dp = rates.groupBy("cls").agg(
        (F.max("selection_rate") - F.min("selection_rate")).alias(DPD),
        F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias(EOD))
    first = group_cols[0]
    r1 = group_rates(df, y, p, [first], cls, cube=cube.groupBy(first, y, p).agg(F.sum("n").alias("n")))
    di = r1.groupBy("cls").agg(F.min("selection_rate").alias("_mn"), F.max("selection_rate").alias("_mx")).select(
        "cls", F.when(F.col("_mx") > 0, F.col("_mn") / F.col("_mx")).alias(DIR))
    out = dp.join(di, "cls")
    if digits is not None:
        out = out.select("cls", *[cf.round_half_even(c, digits).alias(c) for c in (DPD, EOD, DIR)])
    return out


def verdict(metrics: DataFrame, dpd_max: float = 0.2, eod_max: float = 0.2,
            dir_lo: float = 0.8, dir_hi: float = 1.2) -> DataFrame:
    """K7: one row: violation when any class has DPD > dpd_max or EOD >
    eod_max or a (non-null, non-NaN) DIR outside [dir_lo, dir_hi]."""
    d = F.col(DIR)
    dir_bad = d.isNotNull() & ~F.isnan(d) & ((d < dir_lo) | (d > dir_hi))
    return metrics.agg(
        F.max(DPD).alias("max_dpd"), F.max(EOD).alias("max_eod"),
        F.bool_or(F.col(DPD) > dpd_max).alias("dpd_violation"),
        F.bool_or(F.col(EOD) > eod_max).alias("eod_violation"),
        F.coalesce(F.bool_or(dir_bad), F.lit(False)).alias("dir_violation"),
    ).withColumn("violation", F.col("dpd_violation") | F.col("eod_violation") | F.col("dir_violation"))


def reweigh(df: DataFrame, group_cols: Sequence[str], y: str, method: str = "inverse",
            out: str = "weight") -> DataFrame:
    """K8: sample weights.

    ``inverse`` (default): 1 / relative frequency of (group tuple, label) = N / n(g, y).
    ``independence``: P(g) P(y) / P(g, y).
    The (group, label) table is aggregated and joined back; no per-row dictionary lookups.
    """
    gy = df.groupBy(*group_cols, y).agg(F.count(F.lit(1)).alias("_ngy"))
    total = gy.agg(F.sum("_ngy")).scalar()
    if method == "inverse":
        w = gy.select(*group_cols, y, (total / F.col("_ngy")).alias(out))
    elif method == "independence":
        ng = F.sum("_ngy").over(Window.partitionBy(*group_cols))
        ny = F.sum("_ngy").over(Window.partitionBy(y))
        w = gy.select(*group_cols, y, (ng * ny / (total * F.col("_ngy"))).alias(out))
    else:
        raise ValueError(method)
    cond = [df[c].eqNullSafe(w[c]) for c in [*group_cols, y]]
    return df.join(w, cond, "left").select(df["*"], w[out])


def _extend(hull: list[tuple], p: tuple) -> None:
    """Adds a point ``(x, y, ...)`` to the right of an upper hull; exact on integers."""
    while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) >= (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]):
        hull.pop()
    hull.append(p)


def upper_hull(points: list[tuple]) -> list[tuple]:
    """Vertices of the upper hull of points that come by ascending ``x``."""
    hull: list[tuple] = []
    for p in points:
        _extend(hull, p)
    return hull


def _range_hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hull of each group's points in a partition, which come sorted; only vertices are held."""
    key, hull, schema = None, [], None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key] * len(found), schema.field(0).type), *[pa.array(c, f.type) for c, f in zip(
            zip(*found, strict=True), list(schema)[1:], strict=True)]], schema=schema)

    for batch in batches:
        schema = batch.schema
        for g, *point in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if hull and g != key:
                yield rows(hull)
                hull = []
            key = g
            _extend(hull, tuple(point))
    if hull:
        yield rows(hull)


def _segments(table: pa.Table) -> pa.Table:
    """Edges of a group's hull from the vertices of its ranges."""
    table = table.sort_by("x")
    points = upper_hull(list(zip(*(table[c].to_pylist() for c in ("x", "y", "score")), strict=True)))
    g = table["g"].slice(0, 1)
    pairs = list(zip(points, points[1:], strict=False)) or [(points[0], points[0])]
    columns = [[v[side][i] for v in pairs] for side in (0, 1) for i in range(3)]
    kinds = [pa.int64(), pa.int64(), pa.float64()] * 2
    return pa.Table.from_arrays([pa.concat_arrays([g.combine_chunks()] * len(pairs)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                                names=["g", "x0", "y0", "high", "x1", "y1", "low"])


def threshold_moving(df: DataFrame, group: str, y: str, score: str, grid_steps: int = 1000):
    """K9: group-wise thresholds under demographic parity, exact on any ties.

    Each distinct score of a group is a point: how many rows are selected from
    it upwards, and how many predictions are then correct.  Running totals
    from the top score give the points; the upper hull of a group's points is
    what two mixed thresholds can reach at every rate in between.  Hulls are
    taken per range of scores and merged per group (a hull of n such integer
    points has at most in the order of n^(2/3) vertices).  Of the rates
    i / grid_steps that all groups can reach, the one with the best pooled
    accuracy on the hulls wins (to 12 digits; the smallest on ties).

    Rows with a null score are never selected but count in their group's size,
    so a group can't be asked for more than its scored share; they count as
    correct where the label isn't 1.

    Returns ``(thresholds, curve)``: thresholds = (group, high, low, take,
    selected, rows, best_rate, pooled_accuracy): all rows with ``score >=
    high`` are selected (null: none) and ``take`` of those with ``low <= score
    < high``, in all ``selected`` of ``rows``; curve = (rate, pooled_accuracy).
    """
    G = int(grid_steps)
    s = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), (F.coalesce(F.col(y) == 1, F.lit(False))).cast("long").alias("pos"), s.alias("score"))
    hist = rows.groupBy("g", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))
    hist = cut_lineage(hist.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).groupBy("g", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    sums = cut_lineage(hist.groupBy("g").agg(F.sum("n").alias("gn"), F.sum("pos").alias("gp")))
    scored = totals_before(hist.where("score is not null"), "g", -F.col("score"), "n", "prev")
    scored = totals_before(scored, "g", -F.col("score"), "pos", "prev_pos")
    joined = scored.withColumnRenamed("g", "_g").join(sums, F.col("_g").eqNullSafe(F.col("g")))
    x, tp = F.col("prev") + F.col("n"), F.col("prev_pos") + F.col("pos")
    points = joined.select("g", x.alias("x"), (2 * tp - x + F.col("gn") - F.col("gp")).alias("y"), "score").unionByName(
        sums.select("g", F.lit(0).cast("long").alias("x"), (F.col("gn") - F.col("gp")).alias("y"), F.lit(None).cast("double").alias("score")))
    kind = points.schema["g"].dataType.simpleString()
    hulls = points.repartitionByRange("g", "x").sortWithinPartitions("g", "x").mapInArrow(_range_hulls, f"g {kind}, x long, y long, score double")
    edges = hulls.groupBy("g").applyInArrow(_segments, f"g {kind}, x0 long, y0 long, high double, x1 long, y1 long, low double")
    edges = cut_lineage(edges.withColumnRenamed("g", "_g").join(sums, F.col("_g").eqNullSafe(F.col("g"))).drop("_g"))
    # the rates on an edge without its beginning, and rate 0 on the first one
    lo = F.when(F.col("x0") == 0, 0).otherwise(F.floor(F.col("x0") * G / F.col("gn")) + 1).cast("int")
    hi = F.floor(F.col("x1") * G / F.col("gn")).cast("int")
    at = F.col("i") * F.col("gn") / G
    per_rate = edges.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("i", F.explode(F.sequence("lo", "hi")))
    value = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("y0"))
    per_rate = cut_lineage(per_rate.withColumn("value", value))  # grid_steps + 1 rows per group
    groups = sums.agg(F.count(F.lit(1))).scalar()
    acc = per_rate.groupBy("i").agg(F.round(F.sum("value") / F.sum("gn"), 12).alias("pooled_accuracy"), F.count(F.lit(1)).alias("there")).where(F.col("there") == groups)
    best = acc.orderBy(F.desc("pooled_accuracy"), F.asc("i")).limit(1).select("i", (F.col("i") / F.lit(float(G))).alias("best_rate"), "pooled_accuracy")
    selected = F.floor(at + 0.5).cast("long")
    thresholds = per_rate.join(F.broadcast(best), "i").select(
        F.col("g").alias(group), "high", "low", (selected - F.col("x0")).alias("take"), selected.alias("selected"), F.col("gn").alias("rows"), "best_rate", "pooled_accuracy")
    return thresholds, acc.select((F.col("i") / F.lit(float(G))).alias("rate"), "pooled_accuracy")


def apply_thresholds(df: DataFrame, thresholds: DataFrame, group: str, score: str, key: str, out: str = "p_adjusted", seed: int = 42) -> DataFrame:
    """K9 step 5: predictions by the thresholds of each group (no threshold: nobody).

    Of the rows between its two thresholds a group takes those with the
    smallest seeded hash of ``key``: hash buckets are counted first, and only
    the rows of the bucket in which the draw ends are ordered.
    """
    t = cut_lineage(thresholds.select(F.col(group).alias("_g"), "high", "low", "take"))
    s = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    above, least = F.coalesce(s >= F.col("_high"), F.lit(False)), F.coalesce(s >= F.col("_low"), F.lit(False))
    names = {"high": "_high", "low": "_low", "take": "_take"}
    rows = df.join(t.withColumnsRenamed(names), df[group].eqNullSafe(t["_g"]), "left").withColumns(
        {"_above": above, "_band": least & ~above, "_hash": cf.seeded_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)}).drop("_g", "_high", "_low")
    rows = rows.withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counts = rows.where("_band and _take > 0").groupBy(F.col(group).alias("_g"), "_take", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_g").orderBy("_bucket")))  # at most 65,536 a group
    last = cut_lineage(upto.where("_upto >= _take").groupBy("_g").agg(
        F.min("_bucket").alias("_last"), F.min_by(F.col("_take") - F.col("_upto") + F.col("_n"), "_bucket").alias("_rest")))
    rows = rows.join(last, rows[group].eqNullSafe(last["_g"]), "left").drop("_g")
    ends = F.coalesce(F.col("_band") & (F.col("_bucket") == F.col("_last")), F.lit(False))
    sure = F.col("_above") | F.coalesce(F.col("_band") & (F.col("_bucket") < F.col("_last")), F.lit(False))
    order = Window.partitionBy(group).orderBy("_hash", key, score)
    drawn = rows.where(ends).withColumn(out, (F.row_number().over(order) <= F.col("_rest")).cast("int"))
    return rows.where(~ends).withColumn(out, sure.cast("int")).unionByName(drawn).select(*df.columns, out)


def metric_flags(metrics: DataFrame, cutoff: float = 0.2, names: DataFrame | None = None) -> DataFrame:
    """Flag each class whose DPD or EOD exceeds ``cutoff``; with ``names``
    (cls, class_name, class_group) also the readable label ``group (name)``."""
    out = metrics.withColumn("dpd_flag", F.col(DPD) > cutoff).withColumn("eod_flag", F.col(EOD) > cutoff)
    if names is None:
        return out
    label = F.concat(F.coalesce("class_group", F.lit("Other")), F.lit(" ("), F.coalesce("class_name", F.lit("Unknown")), F.lit(")"))
    return out.join(names, "cls", "left").withColumn("class_label", label).drop("class_group", "class_name")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per class, before/after metrics side by side with the change."""
    b = before.select("cls", *[F.col(c).alias(f"{c}_before") for c in (DPD, EOD, DIR)])
    a = after.select("cls", *[F.col(c).alias(f"{c}_after") for c in (DPD, EOD, DIR)])
    j = b.join(a, "cls", "full_outer")
    return j.withColumn("dpd_change", F.col(f"{DPD}_after") - F.col(f"{DPD}_before"))


def accuracy_change(df: DataFrame, y: str, before: str, after: str) -> DataFrame:
    """One row: accuracy before and after the thresholds, and the change."""
    share = lambda p: F.avg(F.col(y).eqNullSafe(F.col(p)).cast("double"))
    return df.agg(share(before).alias("accuracy_before"), share(after).alias("accuracy_after")).withColumn(
        "accuracy_change", F.col("accuracy_after") - F.col("accuracy_before"))


@dataclass
class Audit:
    """What :func:`audit_flow` found; ``predictions`` are null without a violation."""

    before: DataFrame
    verdict: DataFrame
    violated: bool
    metrics: DataFrame
    predictions: DataFrame | None


def audit_flow(train: DataFrame, test: DataFrame, key: str, y: str, group_cols: Sequence[str], group: str,
               fit: Callable[[DataFrame, str | None], Callable[[DataFrame], DataFrame]], path: str, target=1,
               classes=None, grid_steps: int = 1000) -> Audit:
    """Metrics -> verdict -> reweigh and retrain -> group thresholds for
    the target class -> store.

    ``fit(train, weight_col)`` returns a function that adds ``prediction`` and
    ``score`` (of the target class) to rows.  ``metrics`` has the stages
    ``plain``, ``reweighed`` and ``adjusted`` (the target class only) with the
    accuracy of each; adjusted predictions go to ``path``, keyed by ``key``.
    """
    def measured(df: DataFrame, label: str, p: str, stage: str, cls) -> DataFrame:
        m = per_class_metrics(df, label, p, group_cols, cls)
        return m.withColumn("stage", F.lit(stage)).withColumn("accuracy", df.agg(
            F.avg(F.col(label).eqNullSafe(F.col(p)).cast("double"))).scalar())

    plain = cut_lineage(fit(train, None)(test))
    before = measured(plain, y, "prediction", "plain", classes)
    found = verdict(before)
    violated = bool(found.first()["violation"])
    if not violated:
        return Audit(before, found, False, before, None)
    weighted = cut_lineage(fit(reweigh(train, group_cols, y), "weight")(test)).withColumn("_is_target", (F.col(y) == target).cast("int"))
    thresholds, _ = threshold_moving(weighted, group, "_is_target", "score", grid_steps)
    adjusted = apply_thresholds(weighted, thresholds, group, "score", key)
    adjusted.select(key, *dict.fromkeys([group, *group_cols]), y, "_is_target", "p_adjusted").write.mode("overwrite").parquet(path)
    stored = train.sparkSession.read.parquet(path)
    metrics = before.unionByName(measured(weighted, y, "prediction", "reweighed", classes)).unionByName(
        measured(stored, "_is_target", "p_adjusted", "adjusted", [1]))
    return Audit(before, found, True, metrics, stored.select(key, "p_adjusted"))
