"""Dimension lookups and enrichment joins.

Dimension sides are de-duplicated on their key (so a left join can never
multiply fact rows).  Literal dictionaries with unique keys are broadcast;
any other dimension is joined plainly, so Spark broadcasts it by its size in
bytes and the fact side is not shuffled when the dimension is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow.operators.joins import bounded_broadcast


def _unique_dim(dim: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    # One row per key (smallest value on duplicates -> deterministic).
    d = dim.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(v).alias(v) for v in values])
    return d


def fill_group_from_dimension(df: DataFrame, key: str, group: str, dim: DataFrame, dim_key: str,
                              dim_group: str, drop_unfilled: bool = True) -> DataFrame:
    """A missing (null or blank) ``group`` is filled from ``dim`` via
    ``key``; existing values are never overwritten; rows still missing are
    dropped (``drop_unfilled``)."""
    d = _unique_dim(dim.select(F.col(dim_key).alias("_dk"), F.col(dim_group).alias("_dg")), "_dk", ["_dg"])
    j = df.join(d, df[key] == d["_dk"], "left")
    missing = F.col(group).isNull() | (F.trim(F.col(group)) == "")
    out = j.withColumn(group, F.when(missing, F.col("_dg")).otherwise(F.col(group))).drop("_dk", "_dg")
    return out.filter(F.col(group).isNotNull()) if drop_unfilled else out


def lookup_with_default(df: DataFrame, key, dim: DataFrame, dim_key: str, dim_value: str, out: str,
                        default=None, bounded: bool = False) -> DataFrame:
    """``out`` = dim value for ``key`` (column name or Column), else ``default``.

    ``bounded=True`` marks a literal dictionary with unique keys (bounded by
    construction): it is broadcast as is, without de-duplication or size check.
    """
    d = dim.select(F.col(dim_key).alias("_lk"), F.col(dim_value).alias("_lv"))
    d = bounded_broadcast(d) if bounded else _unique_dim(d, "_lk", ["_lv"])
    k = cf.col(key)
    j = df.join(d, k == d["_lk"], "left")
    val = F.col("_lv") if default is None else F.coalesce(F.col("_lv"), F.lit(default))
    return j.withColumn(out, val).drop("_lk", "_lv")


def attach_shares(df: DataFrame, key: str, shares: DataFrame, shares_key: str, share_cols: Sequence[str],
                  missing: str = "drop", drop_keys: bool = False) -> DataFrame:
    """Attach share columns by normalised key (upper + trim).

    ``missing='drop'``: rows with any missing share are dropped (C3).
    ``missing='mean'``: missing shares take the column mean of the share
    dimension (C4), computed by one small aggregate.
    """
    d = shares.select(cf.normalize_key(shares_key).alias("_sk"), *share_cols)
    d = _unique_dim(d, "_sk", list(share_cols))
    j = df.join(d, cf.normalize_key(key) == d["_sk"], "left").drop("_sk")
    if missing == "drop":
        j = j.dropna(subset=list(share_cols))
    elif missing == "mean":
        # one row; rounded, so that the order of summation doesn't show
        means = shares.agg(*[cf.round_half_even(F.avg(c), 9).alias(c) for c in share_cols]).first()
        j = j.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in share_cols})
    else:
        raise ValueError(f"unknown missing policy {missing!r}")
    return j.drop(key) if drop_keys else j


def two_hop_lookup(df: DataFrame, key: str, first: DataFrame, first_key: str, first_value: str,
                   second: DataFrame, second_key: str, second_value: str, out: str, default,
                   bounded: bool = False) -> DataFrame:
    """Key -> intermediate value -> code; ``default`` when either hop misses."""
    tmp = "_hop1"
    step = lookup_with_default(df, key, first, first_key, first_value, tmp, bounded=bounded)
    step = lookup_with_default(step, tmp, second, second_key, second_value, out, default, bounded=bounded)
    return step.drop(tmp)


def class_label(df: DataFrame, class_col: str, names: DataFrame, name_key: str, name_value: str,
                groups: DataFrame, group_key: str, group_value: str,
                default_name: str = "Unknown", default_group: str = "Other") -> DataFrame:
    """Class id -> name -> super-group with defaults at each hop, plus
    the readable label ``group (name)``."""
    step = lookup_with_default(df, class_col, names, name_key, name_value, "class_name", default_name)
    step = lookup_with_default(step, "class_name", groups, group_key, group_value, "class_group", default_group)
    return step.withColumn("class_label", F.concat(F.col("class_group"), F.lit(" ("), F.col("class_name"), F.lit(")")))


def keep_in_set(df: DataFrame, column: str, keys: DataFrame, key: str | None = None, bounded: bool = True) -> DataFrame:
    """Rows whose value is in ``keys`` (left-semi join)."""
    k = keys.select(F.col(key or column).alias("_ks"))
    k = bounded_broadcast(k) if bounded else k
    return df.join(k, df[column] == k["_ks"], "left_semi")


def match_report(df: DataFrame, key: str, dim: DataFrame, dim_key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, matched rows and match rate (optionally per ``by``)."""
    d = dim.select(F.col(dim_key).alias("_mk")).distinct().withColumn("_hit", F.lit(1))
    j = df.join(d, df[key] == d["_mk"], "left")
    g = j.groupBy(*by) if by else j.groupBy()
    return g.agg(F.count(F.lit(1)).alias("rows"), F.count("_hit").alias("matched")).withColumn(
        "match_rate", F.col("matched") / F.col("rows"))


def unmatched_keys(df: DataFrame, key: str, dim: DataFrame, dim_key: str, by: str | None = None) -> DataFrame:
    """Rows without a partner (left-anti join), counted per key (or per ``by``)."""
    d = dim.select(F.col(dim_key).alias("_mk")).distinct()
    g = by or key
    return (df.join(d, df[key] == d["_mk"], "left_anti")
              .groupBy(g).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), g))
