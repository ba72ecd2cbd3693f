"""Ranking, top-k and category engineering.

Fitted state is a small dictionary DataFrame.  Its size is bounded either by
construction (top-N lists, keep-sets above a share threshold) or checked
before it is broadcast (distinct-value code tables).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow import functions as cf
from civicflow.operators.joins import bounded_broadcast
from civicflow.operators.profile import exact_quantiles
from civicflow.session import cut_lineage


def top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values with rank and % of all rows.

    Count desc, value asc on ties.  ``orderBy().limit(n)`` plans as a
    distributed take-ordered (each partition keeps n rows), so the result is
    bounded by ``n`` however large the input.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    with_pct = counts.withColumn("pct", cf.round_half_even(F.col("n") * 100.0 / total, 4))
    top = with_pct.filter(F.col(column).isNotNull()).orderBy(F.desc("n"), F.asc(column)).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(column))))


class Fitted:
    """A fitted dictionary: constructor arguments and one table.

    ``fit`` writes the table once to the shared folder; transforms never go
    back to the training data.  ``save`` and ``load`` keep both (M1, A11).
    """

    params: tuple[str, ...] = ()
    table_name = "codes"

    def save(self, path: str) -> None:
        table: DataFrame = getattr(self, self.table_name)
        table.write.mode("overwrite").parquet(f"{path}/table")
        values = json.dumps({p: getattr(self, p) for p in self.params})
        table.sparkSession.createDataFrame([(type(self).__name__, values)], "kind string, params string").write.mode(
            "overwrite").parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        row = spark.read.parquet(f"{path}/params").first()
        if row["kind"] != cls.__name__:
            raise ValueError(f"{path} holds a {row['kind']}")
        own = cls(**json.loads(row["params"]))
        setattr(own, cls.table_name, spark.read.parquet(f"{path}/table"))
        return own


# ---------------------------------------------------------------- E2 / E3

class TopNBucketer(Fitted):
    """Keep the top-N values (count desc, value asc), others -> ``other``.
    Nulls also become ``other`` (they are never in the top list)."""

    params, table_name = ("column", "n", "other", "out"), "keep"

    def __init__(self, column: str, n: int = 20, other: str = "Other", out: str | None = None):
        self.column, self.n, self.other, self.out = column, n, other, out or column
        self.keep: DataFrame | None = None

    def fit(self, df: DataFrame) -> TopNBucketer:
        self.keep = cut_lineage(top_categories(df, self.column, self.n).select(F.col(self.column).alias("_k")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        keep = bounded_broadcast(self.keep.withColumn("_hit", F.lit(True)))
        j = df.join(keep, df[self.column] == keep["_k"], "left")
        val = F.when(F.col("_hit"), F.col(self.column)).otherwise(F.lit(self.other))
        return j.withColumn(self.out, val).drop("_k", "_hit")


class TopNEncoder(Fitted):
    """Top-N bucketing with rest label, then sorted dense codes over the
    processed values seen at fit time; the source column is dropped.

    The code table has at most N+1 entries.  Values unseen at fit map to the
    rest label; if the rest label itself was unseen at fit, the code is null.
    """

    params = ("column", "n", "rest", "out")

    def __init__(self, column: str, n: int = 50, rest: str = "sonstiges", out: str | None = None):
        self.column, self.n, self.rest = column, n, rest
        self.out = out or f"{column}_encoded"
        self.codes: DataFrame | None = None

    def fit(self, df: DataFrame) -> TopNEncoder:
        counts = cut_lineage(df.groupBy(F.col(self.column).alias("_v")).agg(F.count(F.lit(1)).alias("n")))
        top = counts.where("_v is not null").orderBy(F.desc("n"), "_v").limit(self.n)
        outside = counts.agg(F.sum("n")).scalar() > F.coalesce(top.agg(F.sum("n")).scalar(), F.lit(0))
        rest = df.sparkSession.range(1).where(outside).select(F.lit(self.rest).alias("_v"))
        order = Window.orderBy("_v")  # at most N + 1 rows
        self.codes = cut_lineage(top.select("_v").union(rest).distinct().select(
            "_v", (F.row_number().over(order) - 1).cast("int").alias("_code")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        codes = self.codes.select(F.col("_v").alias("_t"), F.col("_code").alias("_tc"), (F.col("_v") == self.rest).alias("_is_rest"))
        rest = codes.where("_is_rest").agg(F.max("_tc")).scalar()
        j = df.join(bounded_broadcast(codes), df[self.column] == F.col("_t"), "left")
        return j.withColumn(self.out, F.coalesce(F.col("_tc"), rest)).drop("_t", "_tc", "_is_rest", self.column)


# ---------------------------------------------------------------- E4

class DenseCodes(Fitted):
    """Per column, distinct values in ascending order -> 0..k-1, null
    gets the last code.  Numbers sort as numbers (integers exactly), text
    binary.

    ``fit`` is one pass for all columns: each row gives (column, value) pairs
    that are made distinct with a map-side aggregate.  The distinct values are
    range partitioned, numbered inside their partition and shifted by the rows
    of the partitions before, so that no column is ranked in one task.
    ``transform`` joins each column's codes.  A value unseen at fit gets a null
    code, or with ``unseen="error"`` ends the job with its column and text.
    """

    params = ("columns", "suffix", "unseen")

    def __init__(self, columns: Sequence[str], suffix: str = "", unseen: str = "null"):
        if unseen not in ("null", "error"):
            raise ValueError(unseen)
        self.columns = list(columns)
        self.suffix, self.unseen = suffix, unseen
        self.codes: DataFrame | None = None

    def fit(self, df: DataFrame) -> DenseCodes:
        types = {f.name: f.dataType for f in df.schema.fields}
        items = []
        for c in self.columns:
            whole = isinstance(types[c], T.IntegralType)
            number = whole or isinstance(types[c], T.NumericType)
            items.append(F.struct(
                F.lit(c).alias("_col"), F.col(c).cast("string").alias("_s"), (F.col(c).cast("long") if whole else F.lit(None).cast("long")).alias("_l"),
                (F.col(c).cast("double") if number and not whole else F.lit(None).cast("double")).alias("_d")))
        order = [F.asc("_col"), F.asc_nulls_last("_l"), F.asc_nulls_last("_d"), F.asc_nulls_last("_s")]
        pairs = df.select(F.inline(F.array(*items))).distinct()
        local = cut_lineage(pairs.repartitionByRange(*order).sortWithinPartitions(*order)
                                 .withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)))
        sizes = local.groupBy("_p", "_col").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
        before = Window.partitionBy("_col").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
        shift = sizes.select("_p", "_col", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
        self.codes = cut_lineage(local.join(shift, ["_p", "_col"]).select(
            "_col", "_s", (F.col("_i") + F.col("_shift")).cast("int").alias("_code")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            table = (self.codes.filter(F.col("_col") == c)
                     .select(F.col("_s").alias(f"_s_{c}"), F.col("_code").alias(f"_c_{c}")))
            out = (out.join(table, out[c].cast("string").eqNullSafe(F.col(f"_s_{c}")), "left")
                      .withColumn(c + self.suffix, self._code(c, F.col(f"_c_{c}")))
                      .drop(f"_s_{c}", f"_c_{c}"))
        return out


    def _code(self, c: str, code: Column) -> Column:
        if self.unseen == "null":
            return code
        return F.coalesce(code, F.raise_error(F.concat(F.lit(f"{c}: unseen value "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("int"))


# ---------------------------------------------------------------- E5

class RareBucketer(Fitted):
    """E5: values whose share of all rows, in % rounded to 4 decimals, is
    below ``min_pct`` become ``other``; nulls stay null.

    Only the keep-set (share >= min_pct) is broadcast: it has at most
    ``100 / min_pct`` entries whatever the input size.
    """

    params, table_name = ("column", "min_pct", "other"), "keep"

    def __init__(self, column: str, min_pct: float = 0.01, other: str = "Other"):
        self.column, self.min_pct, self.other = column, min_pct, other
        self.keep: DataFrame | None = None

    def fit(self, df: DataFrame) -> RareBucketer:
        counts = df.groupBy(self.column).agg(F.count(F.lit(1)).alias("n"))  # null group counts in the total
        pct = cf.round_half_even(F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar(), 4)
        self.keep = cut_lineage(counts.withColumn("_pct", pct)
                                .filter(F.col(self.column).isNotNull() & (F.col("_pct") >= self.min_pct))
                                .select(F.col(self.column).alias("_k")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        keep = self.keep.withColumn("_hit", F.lit(True))
        keep = bounded_broadcast(keep) if self.min_pct > 0 else keep
        j = df.join(keep, df[self.column] == keep["_k"], "left")
        val = F.when(F.col(self.column).isNull() | F.col("_hit"), F.col(self.column)).otherwise(F.lit(self.other))
        return j.withColumn(self.column, val).drop("_k", "_hit")


# ---------------------------------------------------------------- E6

class IQRCapper:
    """Clip each column into [Q1 - k*IQR, Q3 + k*IQR] (exact quartiles,
    linear interpolation, by :func:`civicflow.operators.profile.exact_quantiles`);
    the bounds (two numbers per column) become literals in the transform."""

    def __init__(self, columns: Sequence[str], k: float = 1.5):
        self.columns, self.k = list(columns), k
        self.bounds: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> IQRCapper:
        row = exact_quantiles(df, self.columns, [0.25, 0.75])
        self.bounds = {}
        for c in self.columns:
            if row[c][0] is None:
                continue
            q1, q3 = float(row[c][0]), float(row[c][1])
            iqr = q3 - q1
            self.bounds[c] = (q1 - self.k * iqr, q3 + self.k * iqr)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {c: cf.clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in self.bounds.items() if c in df.columns}
        return df.withColumns(exprs) if exprs else df

    def report(self, df: DataFrame) -> DataFrame:
        """Rows outside the bounds per column (one pass)."""
        aggs = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in self.bounds.items()]
        return df.agg(*aggs)


# ---------------------------------------------------------------- E8

def min_share_filter(train: DataFrame, test: DataFrame, column: str, min_pct: float = 1.5):
    """Classes below ``min_pct`` % of the *train* rows are removed from
    both tables (left-semi joins against a keep-set of at most 100/min_pct
    classes)."""
    counts = train.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    keep = (counts.withColumn("_pct", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())
                  .filter(F.col("_pct") >= min_pct).select(column))
    keep = bounded_broadcast(keep)
    return train.join(keep, column, "left_semi"), test.join(keep, column, "left_semi")
