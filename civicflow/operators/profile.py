"""Aggregations and profiling.

Every operator is one aggregate over the input (map-side partial
aggregation, one shuffle on the grouping key) followed by work on the small
grouped table.  Windows only ever run over grouped tables, never over the
fact table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow import functions as cf
from civicflow.session import cut_lineage


def total_of(counts: DataFrame, col: str = "n") -> Column:
    """Grand total of a count column as a scalar subquery: the share
    division stays a distributed projection instead of a single-task window
    over every distinct value."""
    return counts.agg(F.sum(col)).scalar()


def filter_funnel(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before/after a filter, removed, removal % and kept % (one pass)."""
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    total = F.count(F.lit(1))
    return df.agg(total.alias("rows_before"), kept.alias("rows_after")).select(
        "rows_before", "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        cf.round_half_even((F.col("rows_before") - F.col("rows_after")) * 100.0 / F.col("rows_before"), 4).alias("removed_pct"),
        cf.round_half_even(F.col("rows_after") * 100.0 / F.col("rows_before"), 4).alias("kept_pct"),
    )


def frequency_table(df: DataFrame, column: str, dropna: bool = False) -> DataFrame:
    """(value, n), count descending then value ascending; nulls kept unless ``dropna``."""
    src = df.filter(F.col(column).isNotNull()) if dropna else df
    return src.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def share_table(df: DataFrame, column: str, digits: int = 4, dropna: bool = False) -> DataFrame:
    """(value, n, pct) with pct = n / all rows * 100 rounded half-even."""
    counts = df.filter(F.col(column).isNotNull()) if dropna else df
    counts = counts.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    pct = cf.round_half_even(F.col("n") * 100.0 / total_of(counts), digits)
    return counts.withColumn("pct", pct).orderBy(F.desc("n"), F.asc_nulls_last(column))


def distinct_stats(df: DataFrame, column: str) -> DataFrame:
    """Distinct count, categories with exactly 1 / at most 10 rows,
    mean rows per category (one row)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col(column).isNotNull())
    return counts.agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n_rows"),
        F.count_if(F.col("n") == 1).alias("n_single"),
        F.count_if(F.col("n") <= 10).alias("n_le10"),
    ).withColumn("mean_rows_per_value", F.col("n_rows") / F.col("n_distinct"))


def rows_per_year(df: DataFrame, ts_col: str) -> DataFrame:
    """(year, n) sorted by year."""
    return (df.groupBy(F.year(ts_col).alias("year")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy("year"))


def topk_with_rest(df: DataFrame, column: str, k: int = 5, rest_label: str = "rest") -> DataFrame:
    """The ``k`` most frequent values (count desc, value asc) plus one rest row."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = (counts.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)
                 .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last(column)))))  # k rows
    top = top.select("rank", F.col(column).cast("string").alias("label"), "n")
    rest = total_of(counts) - F.coalesce(top.agg(F.sum("n")).scalar(), F.lit(0))
    one = df.sparkSession.range(1).select(F.lit(k + 1).alias("rank"), F.lit(rest_label).alias("label"), rest.alias("n"))
    return top.union(one.where("n > 0"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, nulls) per column plus a ``__total__`` row, one pass."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"))
                      for i, c in enumerate(cols)]
                    + [F.struct(F.lit("__total__").alias("column_name"),
                                sum((F.col(f"n{i}") for i in range(len(cols))), F.lit(0)).alias("nulls"))])
    return wide.select(F.inline(pairs)).select("column_name", F.col("nulls").cast("long").alias("nulls"))


#: Bins of one interval in a round of :func:`grouped_quantiles`.
BINS = 1 << 14


def _magnitude(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises, the same for values within an eighth of a power of e."""
    size = F.floor(F.log(F.abs(v)) * 8).cast("int") + 6_000  # above 0 for every double but 0
    finite = F.when(v == 0, 0).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), 30_000).when(v == float("inf"), 20_000).when(v == float("-inf"), -20_000).otherwise(finite)


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``by`` columns, ``n`` and ``quantiles``, an array of exact
    quantiles with linear interpolation, of every group that has a value.

    The values of a group are counted by value; the wanted ranks of all groups
    are then narrowed down together: a histogram of magnitudes first, then
    ``BINS`` equal bins between the least and the greatest value of the bin
    that holds the rank, until they are the same (six rounds for any doubles).
    A round is one aggregation over what is left of the values; no task ever
    holds or sorts a group, only its bins.
    """
    g, v = F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")
    counts = cut_lineage(df.select(*by, v).where("v is not null").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")).select(g, "v", "n"))
    sizes = cut_lineage(counts.groupBy("g").agg(F.sum("n").alias("total")))
    low = [F.floor(F.lit(float(p)) * (F.col("total") - 1)) for p in probs]
    ranks = F.array_distinct(F.array(*[x for k in low for x in (k, F.least(k + 1, F.col("total") - 1))]))
    wanted = sizes.select(F.col("g").alias("wg"), F.explode(ranks).alias("rank"))

    def found(bins: DataFrame, part: list[str], targets: DataFrame, same: Column) -> DataFrame:
        """The bin of each rank: its least and greatest value and the rows before."""
        upto = F.sum("n").over(Window.partitionBy(*part).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.withColumn("before", F.col("start") + upto - F.col("n"))
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        return targets.join(bins, same & inside).select("wg", "rank", "least", "most", "before")

    def histogram(rows: DataFrame, part: list[str]) -> DataFrame:
        return rows.groupBy(*part, "bin").agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))

    bins = histogram(counts.withColumn("bin", _magnitude(F.col("v"))), ["g"]).withColumn("start", F.lit(0))
    state = cut_lineage(found(bins, ["g"], wanted, F.col("wg") == F.col("g")))
    parts = []
    while True:
        open_ = F.col("least") < F.col("most")
        parts.append(state.where(~open_))
        state = state.where(open_)
        if state.isEmpty():
            break
        narrow = state.select(F.col("wg").alias("ig"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("before").alias("start")).distinct()
        rows = counts.join(narrow, (F.col("g") == F.col("ig")) & F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (BINS - 1))
        bins = histogram(rows.withColumn("bin", place), ["g", "lo", "start"])
        targets = state.select("wg", "rank", F.col("least").alias("at"))
        state = cut_lineage(found(bins, ["g", "lo"], targets, (F.col("wg") == F.col("g")) & (F.col("at") == F.col("lo"))))
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    at = values.groupBy("wg").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("least")))).alias("at"))  # two for each quantile

    def quantile(p: float, k: Column) -> Column:
        a, b, rest = F.col("at")[k], F.col("at")[F.least(k + 1, F.col("total") - 1)], F.lit(float(p)) * (F.col("total") - 1) - k
        return F.when((rest == 0) | (a == b), a).otherwise(a + rest * (b - a))
    out = sizes.join(at, F.col("wg") == F.col("g"))
    return out.select("g.*", F.col("total").alias("n"), F.array(*[quantile(p, k) for p, k in zip(probs, low, strict=True)]).alias("quantiles"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation (D11), per column: all columns and ranks together."""
    value = lambda c: F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))
    long = df.select(F.inline(F.array(*[value(c) for c in columns])))
    rows = grouped_quantiles(long, ["c"], "v", probs).collect()  # a row per column
    return {c: [None] * len(probs) for c in columns} | {r["c"]: list(r["quantiles"]) for r in rows}


def measure_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, min, q1, median, q3, max of a measure, for each group of ``by`` or for all rows.

    Quartiles are exact with linear interpolation (same as DuckDB
    ``quantile_cont``), by :func:`grouped_quantiles`.
    """
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    simple = [F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")]
    if not by:
        q = exact_quantiles(df, [column], list(probs.values()))[column]
        return df.agg(*simple).select("n", "mean", "min", *[F.lit(v).cast("double").alias(k) for k, v in zip(probs, q, strict=True)], "max")
    stats = df.groupBy(*by).agg(*simple)
    found = grouped_quantiles(df, by, column, list(probs.values())).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "quantiles")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & stats[c].eqNullSafe(found[f"_by{i}"])
    return stats.join(found, same, "left").select(*[stats[c] for c in by], "n", "mean", "min", *[F.col("quantiles")[i].alias(k) for i, k in enumerate(probs)], "max")


# ---------------------------------------------------------------- D4, D11: sketches

#: Sizes of the sketches: distinct counts within about 2 % (three deviations: 5 %), ranks within 1.4 %.
DISTINCT_K, QUANTILE_K = 12, 200


def period_sketches(df: DataFrame, ts_col: str, distinct: Sequence[str] = (), measures: Sequence[str] = (), period: str = "month") -> DataFrame:
    """D4/D11 as a table to store: per period its rows, a distinct-count sketch
    of each ``distinct`` column and a quantile sketch of each of ``measures``.
    Any range of periods is answered from it without the rows."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    aggs = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(DISTINCT_K)).alias(f"distinct_{c}") for c in distinct]
    aggs += [F.kll_sketch_agg_double(value(c), F.lit(QUANTILE_K)).alias(f"quantiles_{c}") for c in measures]
    return df.groupBy(F.date_trunc(period, ts_col).alias("period")).agg(F.count(F.lit(1)).alias("rows"), *aggs)


def from_sketches(sketches: DataFrame, by: Sequence[Column] = (), distinct: Sequence[str] = (), measures: Sequence[str] = (),
                  probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Merged sketches of some periods (for each ``by``): rows, ``n_<column>`` distinct values and ``<measure>`` quantiles, within the stated errors."""
    aggs = [F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{c}")).alias(f"n_{c}") for c in distinct]
    merged = [F.kll_merge_agg_double(f"quantiles_{c}", F.lit(QUANTILE_K)).alias(f"_{c}") for c in measures]
    out = sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *aggs, *merged)
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    found = {c: F.when(F.kll_sketch_get_n_double(f"_{c}") > 0, F.kll_sketch_get_quantile_double(f"_{c}", ranks)) for c in measures}
    return out.withColumns(found).drop(*[f"_{c}" for c in measures]) if found else out


# ---------------------------------------------------------------- D12: imputation

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class NullImputer:
    """Text columns -> mode (smallest value on ties, 'Unknown' if the
    column is all null); numeric columns -> exact median.  Keys and labels are
    named in ``exclude`` and never filled.  One pass counts nulls; only
    columns that have some are looked at further."""

    def __init__(self, columns: Sequence[str] | None = None, unknown: str = "Unknown", exclude: Sequence[str] = ()):
        self.columns, self.unknown, self.exclude = columns, unknown, set(exclude)
        self.fill: dict[str, object] = {}

    def fit(self, df: DataFrame) -> NullImputer:
        cols = [f for f in df.schema.fields if (self.columns is None or f.name in self.columns) and f.name not in self.exclude
                and isinstance(f.dataType, (*_NUMERIC, T.StringType))]
        nulls = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f"z{i}") for i, f in enumerate(cols)]).first() if cols else ()
        cols = [f for f, n in zip(cols, nulls, strict=True) if n]
        numbers = [f.name for f in cols if isinstance(f.dataType, _NUMERIC)]
        self.fill = {c: q[0] for c, q in exact_quantiles(df, numbers, [0.5]).items()} if numbers else {}
        for f in cols:
            if isinstance(f.dataType, T.StringType):
                top = df.where(F.col(f.name).isNotNull()).groupBy(f.name).count().orderBy(F.desc("count"), f.name).first()
                self.fill[f.name] = self.unknown if top is None else top[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        types = {f.name: f.dataType for f in df.schema.fields}
        for c, v in self.fill.items():
            if c not in types:
                continue
            if isinstance(types[c], _NUMERIC):
                exprs[c] = F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double"))
            else:
                exprs[c] = F.coalesce(F.col(c), F.lit(v))
        return df.withColumns(exprs) if exprs else df


def share_tiers(df: DataFrame, column: str, cuts: Sequence[float] = (1.5, 0.5, 0.1)) -> DataFrame:
    """Class share (% of rows) and tier 1..len(cuts)+1 (share >= cut[i])."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = total_of(counts)
    t = counts.withColumn("pct", cf.round_half_even(F.col("n") * 100.0 / total, 4))
    pct = F.col("n") * 100.0 / total
    tier = F.lit(len(cuts) + 1)
    for i, c in reversed(list(enumerate(cuts))):
        tier = F.when(pct >= c, F.lit(i + 1)).otherwise(tier)
    return t.withColumn("tier", tier.cast("int"))


def tier_counts(tiers: DataFrame) -> DataFrame:
    """Number of classes and rows per tier."""
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows")).orderBy("tier")


def group_mode_rate(df: DataFrame, group: str, y: str, p: str) -> DataFrame:
    """Per group: rows, accuracy, most common prediction (smallest on
    ties) and the share of rows predicted as that value.  Works on the small
    (group, y, p) count table."""
    cube = df.groupBy(group, y, p).agg(F.count(F.lit(1)).alias("n"))
    per_pred = cube.groupBy(group, p).agg(F.sum("n").alias("np"))
    w = Window.partitionBy(group).orderBy(F.desc("np"), F.asc(p))
    mode = (per_pred.withColumn("r", F.row_number().over(w)).filter("r = 1")
                    .select(group, F.col(p).alias("mode_pred"), F.col("np").alias("n_mode")))
    acc = cube.groupBy(group).agg(F.sum("n").alias("n"),
                                  F.sum(F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)).alias("n_correct"))
    return (acc.join(mode, group)
               .select(group, "n", (F.col("n_correct") / F.col("n")).alias("accuracy"), "mode_pred",
                       (F.col("n_mode") / F.col("n")).alias("mode_selection_rate")))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Row x column counts with zero-filled cells; ``values`` fixes the
    output columns (otherwise the distinct column values, a bounded list)."""
    if values is None:
        values = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    out = df.groupBy(row).pivot(column, list(values)).count()
    return out.fillna(0, subset=[str(v) for v in values])


def share_drift(a: DataFrame, b: DataFrame, column: str, limit: float = 0.05) -> DataFrame:
    """Largest absolute difference of class shares between two tables."""
    def shares(d, name):
        g = d.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return g.select(F.col(column).alias(f"{name}_value"), (F.col("n") / total_of(g)).alias(name))
    j = shares(a, "share_a").join(shares(b, "share_b"), F.col("share_a_value").eqNullSafe(F.col("share_b_value")), "full_outer")
    diff = F.abs(F.coalesce("share_a", F.lit(0.0)) - F.coalesce("share_b", F.lit(0.0)))
    return j.agg(F.max(diff).alias("max_abs_diff")).withColumn("within_limit", F.col("max_abs_diff") < limit)


def pair_shares(df: DataFrame, group_cols: Sequence[str], label: str) -> DataFrame:
    """Relative frequency of each (group..., label) combination."""
    g = df.groupBy(*group_cols, label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / total_of(g))


def count_per(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """E7 report: rows per value of the given column(s)."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
