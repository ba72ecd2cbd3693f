"""Row cleaning, column housekeeping and rule checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow import functions as cf


# ---------------------------------------------------------------- B6-B9

def fill_missing_like(df: DataFrame, column: str, default: str) -> DataFrame:
    """Null / blank / 'nan' -> ``default``; no-op when the column is absent."""
    if column not in df.columns:
        return df
    return df.withColumn(column, cf.default_if_missing(column, default))


def drop_missing_key(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose key is null or empty."""
    if column not in df.columns:
        return df
    return df.filter(cf.present_key(column))


def coerce_integer(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Text -> nullable integer (bad -> null)."""
    if column not in df.columns:
        return df
    return df.withColumn(out or column, cf.to_int_or_null(column))


# ---------------------------------------------------------------- B10-B15

def clip_columns(df: DataFrame, columns: Iterable[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Clip share columns into [lo, hi]; nulls stay null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: cf.clip(c, lo, hi) for c in present}) if present else df


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """B11 (no-op when absent)."""
    return df.withColumnRenamed(old, new)


def clean_column_names(df: DataFrame) -> DataFrame:
    """Every blank in a column name becomes '_'."""
    return df.toDF(*[cf.space_to_underscore(c) for c in df.columns])


def drop_if_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop listed columns; absent names are ignored."""
    return df.drop(*[c for c in columns if c in df.columns])


def round_columns(df: DataFrame, columns: Iterable[str], digits: int = 2) -> DataFrame:
    """Numpy-style half-to-even rounding."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: cf.round_half_even(c, digits) for c in present}) if present else df


def select_features(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Fixed feature order, target first when given."""
    cols = ([target] if target else []) + [c for c in features if c != target]
    return df.select(*cols)


def zero_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Constant fallback columns where the dimension is absent."""
    return df.withColumns({c: F.lit(0.0) for c in columns})


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required columns absent from the schema (schema only, no job)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


# ---------------------------------------------------------------- F4

def drop_negative(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """drop rows with a negative value; nulls kept unless ``keep_null=False``."""
    if column not in df.columns:
        return df
    c = F.col(column)
    return df.filter((c.isNull() | (c >= 0)) if keep_null else (c >= 0))


# ---------------------------------------------------------------- B20-B22: rule table

Rule = tuple[str, Column]


def _holds(pred: Column) -> Column:
    # A rule over a missing value does not hold.
    return F.coalesce(pred, F.lit(False))


def rule_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One pass over the data, one row per rule with its violation count.

    Output: ``rule`` string, ``violations`` long, ``rows`` long.
    """
    aggs = [F.sum(F.when(_holds(pred), 0).otherwise(1)).cast("long").alias(f"r{i}")
            for i, (_, pred) in enumerate(rules)]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
                      for i, (name, _) in enumerate(rules)])
    return (wide.select("rows", F.inline(pairs))
                .select("rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
                        F.col("rows").cast("long").alias("rows")))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Tag each row with the rules it fails.

    Adds ``failed_rules`` (array<string>, rule order) and ``is_valid``;
    ``filter('is_valid')`` / ``filter('not is_valid')`` split good rows from
    the quarantine without a second pass.
    """
    failed = F.array(*[F.when(~_holds(pred), F.lit(name)) for name, pred in rules])
    return (df.withColumn("failed_rules", F.filter(failed, lambda x: x.isNotNull()))
              .withColumn("is_valid", F.size("failed_rules") == 0))


def enum_rule(column: str, allowed: Iterable[str]) -> Rule:
    """Membership of a field in a fixed set."""
    return (f"{column}_in_set", F.col(column).isin(list(allowed)))


def range_rule(column: str, lo=None, hi=None) -> Rule:
    c = F.col(column)
    pred = F.lit(True)
    if lo is not None:
        pred = pred & (c >= lo)
    if hi is not None:
        pred = pred & (c <= hi)
    return (f"{column}_range", pred)


# The sets of the domain rules.
AGENCIES = ("NYPD", "DSNY", "DOT", "DEP", "DOB", "FDNY", "HPD", "DOE")
VEHICLE_TYPES = ("none", "N/A", "PASSENGER VEHICLE", "TRUCK", "MOTORCYCLE", "BUS", "TAXI", "LIVERY VEHICLE")


def ticket_rules(duration: str | None = None, hour: str | None = None, month: str | None = None, weekday: str | None = None,
                 shares: Sequence[str] = (), zip_code: str | None = None, iso_time: str | None = None,
                 sets: dict[str, Iterable[str]] | None = None, shares_add_up: bool = False) -> list[Rule]:
    """The domain rules of a ticket for the columns that are named:
    non-negative duration, hour 0-23, month 1-12, weekday 0-6, shares within
    [0, 1], five-digit zip code, readable ISO timestamp, membership in fixed
    sets.  ``shares_add_up`` also asks that the shares add up to 1 (to 0.01):
    not so by default, as the shares of overlapping groups come to more."""
    rules: list[Rule] = []
    for column, lo, hi in ((duration, 0, None), (hour, 0, 23), (month, 1, 12), (weekday, 0, 6), *((s, 0.0, 1.0) for s in shares)):
        if column:
            rules.append(range_rule(column, lo, hi))
    if shares and shares_add_up:
        rules.append(("shares_add_up", F.abs(sum((F.col(s) for s in shares), F.lit(0.0)) - 1.0) < 0.01))
    if zip_code:
        rules.append((f"{zip_code}_five_digits", F.col(zip_code).cast("string").rlike("^[0-9]{5}$")))
    if iso_time:
        rules.append((f"{iso_time}_iso", cf.parse_timestamp(iso_time).isNotNull()))
    return rules + [enum_rule(c, allowed) for c, allowed in (sets or {}).items()]


# ---------------------------------------------------------------- B3

def year_set_predicate(ts_col: str, years) -> Column:
    """``year(ts) IN years`` written as timestamp ranges, one per run of
    consecutive years.  Parquet skips row groups by them on columns with a
    time zone; on columns without one Spark filters after the scan, so tables
    that are filtered by year should be written by
    :func:`civicflow.sources.write_by_year`."""
    ys = sorted(set(int(y) for y in years))
    if not ys:
        return F.lit(False)
    runs, start, prev = [], ys[0], ys[0]
    for y in ys[1:]:
        if y != prev + 1:
            runs.append((start, prev))
            start = y
        prev = y
    runs.append((start, prev))
    c = F.col(ts_col)
    pred = None
    for a, b in runs:
        r = (c >= F.lit(f"{a}-01-01 00:00:00").cast("timestamp_ntz")) & (c < F.lit(f"{b + 1}-01-01 00:00:00").cast("timestamp_ntz"))
        pred = r if pred is None else (pred | r)
    return pred
