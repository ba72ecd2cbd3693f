"""Catalogue: aggregations and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow import sources
from civicflow.operators import profile
from civicflow.plans.catalog import register
from civicflow.session import table

_FUNNEL_KEEP = "o_orderstatus = 'F' AND o_totalprice > 100000"


def _r4(expr: str) -> str:
    return f"round_even(CAST({expr} AS DOUBLE) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE"


@register("filter_funnel", f"""
SELECT rows_before, rows_after, rows_before - rows_after AS rows_removed,
       {_r4('(rows_before - rows_after) * 100.0::DOUBLE / rows_before')} AS removed_pct,
       {_r4('rows_after * 100.0::DOUBLE / rows_before')} AS kept_pct
FROM (SELECT CAST(count(*) AS BIGINT) AS rows_before,
             CAST(count_if({_FUNNEL_KEEP}) AS BIGINT) AS rows_after FROM orders)""")
def filter_funnel(spark, sf):
    o = table(spark, sf, "orders")
    return profile.filter_funnel(o, F.expr(_FUNNEL_KEEP))


@register("freq_table", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority""")
def freq_table(spark, sf):
    return profile.frequency_table(table(spark, sf, "orders"), "o_orderpriority")


@register("share_table", f"""
SELECT o_orderpriority, n, {_r4('n * 100.0::DOUBLE / sum(n) OVER ()')} AS pct
FROM (SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority)""")
def share_table(spark, sf):
    return profile.share_table(table(spark, sf, "orders"), "o_orderpriority")


@register("freq_of_freq", """
SELECT CAST(count(*) AS BIGINT) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_rows,
       CAST(count_if(n = 1) AS BIGINT) AS n_single, CAST(count_if(n <= 10) AS BIGINT) AS n_le10,
       CAST(sum(n) AS DOUBLE) / count(*) AS mean_rows_per_value
FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)""")
def freq_of_freq(spark, sf):
    return profile.distinct_stats(table(spark, sf, "orders"), "o_custkey")


@register("rows_per_year", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def rows_per_year(spark, sf):
    return profile.rows_per_year(table(spark, sf, "orders"), "o_orderdate")


@register("topk_rest", """
WITH c AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rk
           FROM part GROUP BY p_brand)
SELECT CAST(CASE WHEN rk <= 5 THEN rk ELSE 6 END AS INTEGER) AS rank,
       CASE WHEN rk <= 5 THEN p_brand ELSE 'rest' END AS label, CAST(sum(n) AS BIGINT) AS n
FROM c GROUP BY 1, 2""")
def topk_rest(spark, sf):
    return profile.topk_with_rest(table(spark, sf, "part"), "p_brand", k=5)


def _docs_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left")


_DL_SQL = ("SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
           "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


@register("null_profile", f"""
WITH t AS ({_DL_SQL}),
     c AS (SELECT count_if(doc_id IS NULL) AS a, count_if(lang IS NULL) AS b, count_if(source IS NULL) AS c,
                  count_if(n_chars IS NULL) AS d, count_if(quality IS NULL) AS e, count_if(toxic IS NULL) AS f FROM t)
SELECT column_name, CAST(nulls AS BIGINT) AS nulls FROM (
  SELECT 'doc_id' AS column_name, a AS nulls FROM c UNION ALL SELECT 'lang', b FROM c
  UNION ALL SELECT 'source', c FROM c UNION ALL SELECT 'n_chars', d FROM c
  UNION ALL SELECT 'quality', e FROM c UNION ALL SELECT 'toxic', f FROM c
  UNION ALL SELECT '__total__', a + b + c + d + e + f FROM c)""")
def null_profile(spark, sf):
    return profile.null_profile(_docs_labels(spark, sf), ["doc_id", "lang", "source", "n_chars", "quality", "toxic"])


@register("measure_stats", """
SELECT o_orderpriority, CAST(count(o_totalprice) AS BIGINT) AS n, avg(o_totalprice) AS mean,
       min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
       quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max
FROM orders GROUP BY o_orderpriority""")
def measure_stats(spark, sf):
    return profile.measure_stats(table(spark, sf, "orders"), "o_totalprice", by=["o_orderpriority"])


@register("impute", f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS lang, quality, toxic
           FROM ({_DL_SQL})),
     m AS (SELECT lang AS mode_lang FROM t WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
     q AS (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) AS mq, quantile_cont(CAST(toxic AS DOUBLE), 0.5) AS mt FROM t)
SELECT doc_id, coalesce(lang, mode_lang) AS lang, coalesce(CAST(quality AS DOUBLE), mq) AS quality,
       coalesce(CAST(toxic AS DOUBLE), mt) AS toxic
FROM t, m, q""")
def impute(spark, sf):
    t = _docs_labels(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("lang"),
        "quality", "toxic")
    return profile.NullImputer(["lang", "quality", "toxic"]).fit(t).transform(t)


@register("tiering", f"""
SELECT o_custkey, n, {_r4('n * 100.0::DOUBLE / sum(n) OVER ()')} AS pct,
       CASE WHEN n * 100.0::DOUBLE / sum(n) OVER () >= 1.5 THEN 1
            WHEN n * 100.0::DOUBLE / sum(n) OVER () >= 0.5 THEN 2
            WHEN n * 100.0::DOUBLE / sum(n) OVER () >= 0.1 THEN 3 ELSE 4 END AS tier
FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey)""")
def tiering(spark, sf):
    return profile.share_tiers(table(spark, sf, "orders"), "o_custkey", cuts=(1.5, 0.5, 0.1))


_YP_SQL = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality AS y, CAST(d.n_chars > 500 AS INTEGER) AS p
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def labelled(spark, sf):
    """labels joined to documents: y = quality, p = (n_chars > 500) as a rule predictor."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(d, "doc_id").withColumn("p", (F.col("n_chars") > 500).cast("int"))


@register("group_mode_rate", f"""
WITH t AS ({_YP_SQL}),
     pp AS (SELECT lang, p, count(*) AS np, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, p) AS r
            FROM t GROUP BY lang, p),
     a AS (SELECT lang, count(*) AS n, count_if(y = p) AS nc FROM t GROUP BY lang)
SELECT a.lang, CAST(a.n AS BIGINT) AS n, a.nc / a.n AS accuracy, pp.p AS mode_pred,
       pp.np / a.n AS mode_selection_rate
FROM a JOIN pp ON a.lang = pp.lang AND pp.r = 1""")
def group_mode_rate(spark, sf):
    return profile.group_mode_rate(labelled(spark, sf), "lang", "y", "p")


@register("crosstab", """
SELECT o_orderpriority, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS "F",
       CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS "O", CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS "P"
FROM orders GROUP BY o_orderpriority""")
def crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@register("share_drift", """
WITH a AS (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS sa FROM orders
           WHERE o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1),
     b AS (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS sb FROM orders
           WHERE o_orderdate >= TIMESTAMP '1998-07-01' GROUP BY 1)
SELECT max(abs(coalesce(sa, 0.0) - coalesce(sb, 0.0))) AS max_abs_diff,
       max(abs(coalesce(sa, 0.0) - coalesce(sb, 0.0))) < 0.05 AS within_limit
FROM a FULL OUTER JOIN b ON a.o_orderpriority = b.o_orderpriority""")
def share_drift(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    return profile.share_drift(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut),
                               "o_orderpriority")


@register("pair_shares", f"""
SELECT lang, y, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER () AS share
FROM ({_YP_SQL}) GROUP BY lang, y""")
def pair_shares(spark, sf):
    return profile.pair_shares(labelled(spark, sf), ["lang"], "y")


@register("sketched_years", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows, true AS distinct_within, true AS median_within FROM orders GROUP BY 1""")
def sketched_years(spark, sf):
    """D4/D11 from monthly sketches: each year's distinct customers and median price against the exact ones."""
    o = table(spark, sf, "orders").select("o_orderdate", "o_custkey", "o_totalprice")
    path = sources.scratch_path(spark, "sketches")
    sources.write_parquet(profile.period_sketches(o, "o_orderdate", ["o_custkey"], ["o_totalprice"]), path)
    year = F.year("period").alias("year")
    found = profile.from_sketches(spark.read.parquet(path), [year], ["o_custkey"], ["o_totalprice"], [0.5])
    found = found.select("year", F.col("rows"), "n_o_custkey", F.col("o_totalprice")[0].alias("median"))
    exact = o.join(F.broadcast(found), F.year("o_orderdate") == F.col("year")).groupBy("year", "rows", "n_o_custkey", "median").agg(  # a row per year
        F.countDistinct("o_custkey").alias("n"), F.avg((F.col("o_totalprice") <= F.col("median")).cast("double")).alias("below"))
    return exact.select("year", "rows", (F.abs(F.col("n_o_custkey") / F.col("n") - 1) < 0.05).alias("distinct_within"), (F.abs(F.col("below") - 0.5) < 0.03).alias("median_within"))
