"""Join helpers: when to broadcast a side.

* A side whose size is bounded *by construction* (a top-N list, a keep-set of
  categories above a share threshold, a literal dictionary, a one-row
  aggregate) is broadcast with :func:`bounded_broadcast`.
* Any other side is joined plainly: Spark broadcasts it if its size in bytes
  is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise,
  with AQE splitting skewed keys.  No job runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction."""
    return F.broadcast(df)


def same_keys(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of the columns of both sides in which a null equals a null."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Small literal dictionary as a DataFrame (always broadcast-safe)."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))
