"""Date and time features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from civicflow import functions as cf


def add_date_features(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``<c>_hour``, ``<c>_month``, ``<c>_dayofweek`` (Monday = 0)."""
    new = {}
    for c in columns:
        if c in df.columns:
            new[f"{c}_hour"] = cf.hour_of(c)
            new[f"{c}_month"] = cf.month_of(c)
            new[f"{c}_dayofweek"] = cf.weekday_of(c)
    return df.withColumns(new) if new else df


def add_duration_days(df: DataFrame, start: str, end: str, out: str = "duration_days") -> DataFrame:
    """fractional days between two timestamps (null if either is null)."""
    if start not in df.columns or end not in df.columns:
        return df
    return df.withColumn(out, cf.days_between(start, end))


def add_age_days(df: DataFrame, created: str, as_of=None, out: str = "age_days") -> DataFrame:
    """age at ``as_of`` (timestamp text or Column; default now)."""
    return df.withColumn(out, cf.age_days(created, as_of))
