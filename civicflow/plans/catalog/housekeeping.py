"""Catalogue: file round trips (A1-A8, A12), column housekeeping (B11-B21,
H4), bucket counts (E7), partitioned reads (B3) and the applied power
transform (H2).  Files are written to the shared folder by Spark from the
driver tables and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow import sources
from civicflow.operators import categories, clean, profile, scaling
from civicflow.operators import fairness as fair
from civicflow.plans.catalog import register
from civicflow.plans.catalog.fairness import _metrics_sql
from civicflow.plans.catalog.profile import labelled
from civicflow.plans.catalog.scaling import _YJ_COLS, _grid_sql, _yj_sql
from civicflow.session import table


# ---------------------------------------------------------------- A: files

_WIDE_SQL = """
SELECT o_orderkey, o_custkey, 'said "' || o_orderpriority || '", again' AS ctype, 'line one' || chr(10) || 'line, two' AS descriptor,
       o_orderstatus AS agency, date_trunc('second', o_orderdate) AS created FROM orders"""


def _wide_csv(spark, sf) -> str:
    """An export with more columns than wanted, in another order, with quotes, commas and line breaks."""
    o = table(spark, sf, "orders")
    path = sources.scratch_path(spark, "export")
    sources.write_csv(o.select(
        F.col("o_orderkey").alias("Unique Key"), F.lit("a,b").alias("Address Type"), F.col("o_orderstatus").alias("Agency"),
        F.concat(F.lit("line one\nline, two")).alias("Descriptor"), F.col("o_custkey").alias("Incident Zip"),
        F.concat(F.lit('said "'), "o_orderpriority", F.lit('", again')).alias("Complaint Type"), F.lit(None).cast("string").alias("Park"),
        F.date_format("o_orderdate", cf.TICKET_TS_FORMAT).alias("Created Date"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", cf.TICKET_TS_FORMAT)).otherwise("open").alias("Closed Date")), path)
    return path


@register("raw_csv", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "Unique Key", created AS "Created Date", CASE WHEN o_orderkey % 2 = 0 THEN created END AS "Closed Date",
       agency AS "Agency", ctype AS "Complaint Type", descriptor AS "Descriptor", CAST(o_custkey AS VARCHAR) AS "Incident Zip"
FROM ({_WIDE_SQL}) WHERE year(created) IN (1996, 1997)""")
def raw_csv(spark, sf):
    """Columns by header name, parsed and filtered."""
    raw = sources.read_tickets_csv(spark, _wide_csv(spark, sf), [
        "Unique Key", "Created Date", "Closed Date", "Agency", "Complaint Type", "Descriptor", "Incident Zip"])
    return sources.prepare_raw_tickets(raw, (1996, 1997))


@register("preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf):
    return sources.preview(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"), 5)


@register("dimension_csv", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS c_nationkey, c_name, n_name FROM customer
LEFT JOIN nation ON c_custkey % 2 = 0 AND c_nationkey = n_nationkey""")
def dimension_csv(spark, sf):
    """A4: two dimension files with another column order, one with unreadable numbers, joined."""
    path, nations = sources.scratch_path(spark, "dimension"), sources.scratch_path(spark, "nations")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("?").alias("c_nationkey")
    sources.write_csv(table(spark, sf, "customer").select("c_name", key, "c_custkey"), path)
    sources.write_csv(table(spark, sf, "nation").select("n_name", "n_regionkey", "n_nationkey"), nations)
    customers = sources.read_dimension_csv(spark, path, "c_custkey long, c_nationkey int, c_name string")
    names = sources.read_dimension_csv(spark, nations, "n_nationkey int, n_name string")
    return customers.join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").drop("n_nationkey")


@register("train_test_load", """
SELECT CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, c_mktsegment AS y, c_nationkey, c_custkey % 3 AS grp, c_custkey, c_acctbal AS balance
FROM customer""")
def train_test_load(spark, sf):
    """Target and sensitive columns apart from the features, one column renamed."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", (F.col("c_custkey") % 3).alias("grp"))
    paths = [sources.scratch_path(spark, n) for n in ("train", "test")]
    for path, part in zip(paths, (c.where("c_custkey % 4 <> 0"), c.where("c_custkey % 4 = 0"))):
        sources.write_parquet(part, path)
    out = sources.load_train_test(spark, *paths, target="c_mktsegment", sensitive=["c_nationkey", "grp"], rename={"c_acctbal": "balance"})
    return out.select("split", "y", "c_nationkey", "grp", "features.c_custkey", "features.balance")


@register("metrics_csv", f"SELECT CAST(cls AS VARCHAR) AS cls, {fair.DPD}, {fair.EOD}, {fair.DIR} FROM ({_metrics_sql('lang', 'lang')})")
def metrics_csv(spark, sf):
    """Fairness table stored and read typed."""
    path = sources.scratch_path(spark, "metrics")
    sources.write_csv(fair.per_class_metrics(labelled(spark, sf), "y", "p", ["lang"]), path)
    return sources.read_metrics_csv(spark, path)


@register("years_read", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) IN (1995, 1998)""")
def years_read(spark, sf):
    """B3 on tickets written by year: only two folders are read."""
    path = sources.scratch_path(spark, "by-year")
    sources.write_by_year(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", path)
    return sources.read_years(spark, path, [1995, 1998]).select("o_orderkey", "year")


# ---------------------------------------------------------------- B: columns

@register("rename_drop", "SELECT c_custkey, c_acctbal AS duration_days FROM customer")
def rename_drop(spark, sf):
    """One column renamed, leaking ones dropped, absent ones ignored."""
    c = clean.rename_column(table(spark, sf, "customer"), "c_acctbal", "duration_days")
    return clean.drop_if_present(c, ["c_name", "c_nationkey", "c_mktsegment", "Location", "Complaint_Type_original"])


@register("zero_columns", "SELECT c_custkey, 0.0::DOUBLE AS share_a, 0.0::DOUBLE AS share_b FROM customer")
def zero_columns(spark, sf):
    return clean.zero_columns(table(spark, sf, "customer").select("c_custkey"), ["share_a", "share_b"])


@register("metric_text", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE round(o_totalprice, 2) END AS value FROM orders""")
def metric_text(spark, sf):
    """Unreadable text and 'NaN' are null."""
    k, v = F.col("o_orderkey"), F.round("o_totalprice", 2).cast("string")
    text = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "NaN").otherwise(v)
    return table(spark, sf, "orders").select("o_orderkey", cf.to_number_or_null(text).alias("value"))


@register("suffix_key", "SELECT c_custkey, upper(c_name) AS key FROM customer")
def suffix_key(spark, sf):
    """A closing suffix goes, whatever its case."""
    name = F.concat(F.lit("  "), F.lower("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" County ")).otherwise(F.lit("")))
    return table(spark, sf, "customer").select("c_custkey", cf.normalize_key(name, "county").alias("key"))


@register("required_columns", "SELECT unnest(['Agency', 'Incident_Zip']) AS missing, count(*) AS rows FROM customer")
def required_columns(spark, sf):
    """Required columns that the table lacks, with the rows concerned."""
    c = table(spark, sf, "customer")
    missing = F.array(*[F.lit(m) for m in clean.missing_columns(c, ["Agency", "c_name", "Incident_Zip", "c_custkey"])])
    return c.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(missing).alias("missing"), "rows")


_RULES = {"days_range": "o_totalprice / 1000 - 100 >= 0", "hour_range": "(o_orderkey % 26) BETWEEN 0 AND 23", "month_range": "month(o_orderdate) BETWEEN 1 AND 12",
          "weekday_range": "(o_orderkey % 8) BETWEEN 0 AND 6", "a_range": "(o_orderkey % 3) / 2.0 BETWEEN 0 AND 1", "b_range": "1 - (o_orderkey % 4) / 2.0 BETWEEN 0 AND 1",
          "shares_add_up": "abs((o_orderkey % 3) / 2.0 + 1 - (o_orderkey % 4) / 2.0 - 1) < 0.01", "zip_five_digits": "regexp_full_match(CAST(o_custkey * 100 AS VARCHAR), '[0-9]{5}')",
          "time_iso": "o_orderkey % 9 <> 0", "agency_in_set": "o_orderkey % 2 = 0"}


@register("domain_rules", " UNION ALL ".join(
    f"SELECT '{name}' AS rule, CAST(count(*) FILTER (WHERE NOT coalesce({sql}, false)) AS BIGINT) AS violations, count(*) AS rows FROM orders"
    for name, sql in _RULES.items()))
def domain_rules(spark, sf):
    """The ticket rules on orders, with violations of every kind."""
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(
        (F.col("o_totalprice") / 1000 - 100).alias("days"), (k % 26).alias("hour"), F.month("o_orderdate").alias("month"), (k % 8).alias("weekday"),
        ((k % 3) / 2.0).alias("a"), (1 - (k % 4) / 2.0).alias("b"), (F.col("o_custkey") * 100).alias("zip"),
        F.when(k % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon").alias("time"),
        F.when(k % 2 == 0, "NYPD").otherwise("XXXX").alias("agency"))
    return clean.rule_report(t, clean.ticket_rules("days", "hour", "month", "weekday", ["a", "b"], "zip", "time", {"agency": clean.AGENCIES}, shares_add_up=True))


@register("kept_counts", """
WITH top AS (SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 6)
SELECT CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'Other' END AS p_brand, count(*) AS n FROM part GROUP BY 1""")
def kept_counts(spark, sf):
    """Rows per kept category and in the rest bucket."""
    p = table(spark, sf, "part").select("p_brand")
    return profile.count_per(categories.TopNBucketer("p_brand", 6).fit(p).transform(p), ["p_brand"])


@register("tier_counts", """
WITH t AS (SELECT o_custkey, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM orders GROUP BY o_custkey)
SELECT CAST(CASE WHEN pct >= 1.5 THEN 1 WHEN pct >= 0.5 THEN 2 WHEN pct >= 0.1 THEN 3 ELSE 4 END AS INTEGER) AS tier, count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows
FROM t GROUP BY 1""")
def tier_counts(spark, sf):
    return profile.tier_counts(profile.share_tiers(table(spark, sf, "orders"), "o_custkey"))


# ---------------------------------------------------------------- H2

def _applied(c: str) -> str:
    return "CASE " + " ".join(f"WHEN l = {lam}::DOUBLE THEN {_yj_sql(c, lam)}" for lam in scaling.DEFAULT_LAMBDAS) + " END"


@register("yeo_johnson", f"""
WITH best AS ({_grid_sql()}),
     x AS (SELECT l_orderkey, l_linenumber, {', '.join(_YJ_COLS)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {', '.join(f'(SELECT round({_applied(c)}, 6) FROM (SELECT "lambda" AS l FROM best WHERE column_name = {chr(39)}{c}{chr(39)})) AS {c}' for c in _YJ_COLS)}
FROM x""")
def yeo_johnson(spark, sf):
    """H2: the transform with the lambda of each column."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_YJ_COLS)
    out = scaling.YeoJohnsonGrid(_YJ_COLS).fit(li).transform(li)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _YJ_COLS])
