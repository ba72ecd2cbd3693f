"""Running totals over an unbounded ordered table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.session import cut_lineage


def totals_before(df: DataFrame, group: str, order: Column, value: str, out: str = "_before") -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same group that come
    before in the order (which must be total inside a group).

    Rows are range partitioned by (group, order); each piece is summed on its
    own and shifted by the sum of the group's pieces before (one row each).
    """
    rows = df.withColumn("_o", order)
    rows = cut_lineage(rows.repartitionByRange(F.col(group), F.col("_o")).withColumn("_p", F.spark_partition_id()))
    unbounded = Window.unboundedPreceding
    pieces = rows.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.sum(value).alias("_n"))
    shift = pieces.select("_g", "_q", F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_q").rowsBetween(unbounded, -1)), F.lit(0)).alias("_shift"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_p", group).orderBy("_o").rowsBetween(unbounded, -1)), F.lit(0))
    j = rows.withColumn("_own", own).join(shift, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return j.select(*df.columns, (F.col("_own") + F.col("_shift")).alias(out))
