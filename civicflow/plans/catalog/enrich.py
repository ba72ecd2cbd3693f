"""Catalogue: dimension lookups and enrichment joins.

The ticket-like table is ``customer``: ``c_nationkey`` plays the zip code,
the region name plays the borough; some boroughs are blanked and some keys
point outside the dimension so every branch (fill, keep, drop, default) runs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.operators import enrich
from civicflow.operators.joins import literal_table
from civicflow.plans.catalog import register
from civicflow.session import table

# SQL pieces shared by the oracles --------------------------------------------------------------

_DIM_SQL = "SELECT n_nationkey AS zip, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey"
_TICKETS_SQL = f"""
SELECT c_custkey,
       CASE WHEN c_custkey % 13 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS zip,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE d.borough END AS borough
FROM customer LEFT JOIN ({_DIM_SQL}) d ON d.zip = c_nationkey"""


def _zip_dim(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("zip"),
                                                            F.col("r_name").alias("borough"))


def _tickets(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    dim = _zip_dim(spark, sf).withColumnRenamed("borough", "_b")
    j = enrich.lookup_with_default(c, "c_nationkey", dim, "zip", "_b", "_true_borough")
    k = F.col("c_custkey")
    return j.select(
        "c_custkey",
        F.when(k % 13 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("zip"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, F.lit(""))
         .otherwise(F.col("_true_borough")).alias("borough"))


@register("zip_fill", f"""
WITH t AS ({_TICKETS_SQL}), d AS ({_DIM_SQL})
SELECT c_custkey, zip, borough FROM (
  SELECT t.c_custkey, t.zip,
         CASE WHEN t.borough IS NULL OR trim(t.borough) = '' THEN d.borough ELSE t.borough END AS borough
  FROM t LEFT JOIN d ON t.zip = d.zip)
WHERE borough IS NOT NULL""")
def zip_fill(spark, sf):
    return enrich.fill_group_from_dimension(_tickets(spark, sf), "zip", "borough", _zip_dim(spark, sf),
                                            "zip", "borough").select("c_custkey", "zip", "borough")


@register("lookup_default", f"""
WITH t AS ({_TICKETS_SQL}), d AS ({_DIM_SQL})
SELECT t.c_custkey, t.zip, coalesce(d.borough, 'Unspecified') AS borough_lookup
FROM t LEFT JOIN d ON t.zip = d.zip""")
def lookup_default(spark, sf):
    t = _tickets(spark, sf).select("c_custkey", "zip")
    return enrich.lookup_with_default(t, "zip", _zip_dim(spark, sf), "zip", "borough", "borough_lookup",
                                      "Unspecified")


# Fixed value: the four segments whose shares form the group-share dimension.
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
_SHARE_COLS = [f"share_{s.lower()}" for s in _SEGMENTS]

_SHARES_SQL = f"""
SELECT r_name AS region,
       {', '.join(f"avg(CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END) AS share_{s.lower()}" for s in _SEGMENTS)}
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name"""
_DIRTY_KEY_SQL = f"""
SELECT c_custkey,
       CASE WHEN c_custkey % 9 = 0 THEN 'UNKNOWN_REGION' WHEN c_custkey % 4 = 0 THEN lower(d.borough) || '  '
            ELSE d.borough END AS region_key
FROM customer LEFT JOIN ({_DIM_SQL}) d ON d.zip = c_nationkey"""


def _shares(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("r_name").alias("region")).agg(
        *[F.avg(F.when(F.col("c_mktsegment") == s, 1.0).otherwise(0.0)).alias(f"share_{s.lower()}")
          for s in _SEGMENTS])


def _dirty_keys(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    dim = _zip_dim(spark, sf)
    j = enrich.lookup_with_default(c, "c_nationkey", dim, "zip", "borough", "_b")
    k = F.col("c_custkey")
    key = (F.when(k % 9 == 0, F.lit("UNKNOWN_REGION"))
            .when(k % 4 == 0, F.concat(F.lower("_b"), F.lit("  "))).otherwise(F.col("_b")))
    return j.select("c_custkey", key.alias("region_key"))


@register("shares_join", f"""
WITH t AS ({_DIRTY_KEY_SQL}), s AS ({_SHARES_SQL})
SELECT t.c_custkey, {', '.join('s.' + c for c in _SHARE_COLS)}
FROM t JOIN s ON upper(trim(t.region_key)) = upper(trim(s.region))""")
def shares_join(spark, sf):
    out = enrich.attach_shares(_dirty_keys(spark, sf), "region_key", _shares(spark, sf), "region",
                               _SHARE_COLS, missing="drop", drop_keys=True)
    return out.select("c_custkey", *_SHARE_COLS)


@register("shares_fallback", f"""
WITH t AS ({_DIRTY_KEY_SQL}), s AS ({_SHARES_SQL}),
     m AS (SELECT {', '.join(f'round_even(avg({c}) * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS {c}' for c in _SHARE_COLS)} FROM s)
SELECT t.c_custkey, {', '.join(f'coalesce(s.{c}, m.{c}) AS {c}' for c in _SHARE_COLS)}
FROM t LEFT JOIN s ON upper(trim(t.region_key)) = upper(trim(s.region)), m""")
def shares_fallback(spark, sf):
    out = enrich.attach_shares(_dirty_keys(spark, sf), "region_key", _shares(spark, sf), "region",
                               _SHARE_COLS, missing="mean", drop_keys=True)
    return out.select("c_custkey", *_SHARE_COLS)


# Fixed value: event type codes (an unknown type maps to -1).
_TYPE_CODES = [("click", 0), ("view", 1), ("purchase", 2), ("signup", 3)]


@register("code_lookup", f"""
SELECT e.event_id, e.event_type, CAST(coalesce(d.code, -1) AS INTEGER) AS type_code
FROM events e LEFT JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in _TYPE_CODES)}) d(k, code)
  ON e.event_type = d.k""")
def code_lookup(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    codes = literal_table(spark, _TYPE_CODES, "k string, code int")
    return enrich.lookup_with_default(ev, "event_type", codes, "k", "code", "type_code", -1, bounded=True)


# Part type -> product family (MEDIUM has none), family -> code; default code 99.
_TYPE_FAMILY = [("ECONOMY", "budget"), ("STANDARD", "budget"), ("PROMO", "marketing"),
                ("LARGE", "size"), ("SMALL", "size")]
_FAMILY_CODE = [("budget", 1), ("marketing", 2), ("size", 3)]


@register("two_hop", f"""
SELECT p.p_partkey, p.p_type, CAST(coalesce(c.code, 99) AS INTEGER) AS family_code
FROM part p
LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _TYPE_FAMILY)}) f(t, fam) ON p.p_type = f.t
LEFT JOIN (VALUES {', '.join(f"('{a}', {b})" for a, b in _FAMILY_CODE)}) c(fam, code) ON f.fam = c.fam""")
def two_hop(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    fam = literal_table(spark, _TYPE_FAMILY, "t string, fam string")
    code = literal_table(spark, _FAMILY_CODE, "fam string, code int")
    return enrich.two_hop_lookup(p, "p_type", fam, "t", "fam", code, "fam", "code", "family_code", 99, bounded=True)


@register("class_group_label", """
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS cls
           FROM customer),
     g AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT t.c_custkey, t.cls, coalesce(n.n_name, 'Unknown') AS class_name, coalesce(g.r_name, 'Other') AS class_group,
       coalesce(g.r_name, 'Other') || ' (' || coalesce(n.n_name, 'Unknown') || ')' AS class_label
FROM t LEFT JOIN nation n ON t.cls = n.n_nationkey LEFT JOIN g ON coalesce(n.n_name, 'Unknown') = g.n_name""")
def class_group_label(spark, sf):
    c = table(spark, sf, "customer")
    t = c.select("c_custkey", F.when(F.col("c_custkey") % 13 == 0, F.col("c_nationkey") + 100)
                 .otherwise(F.col("c_nationkey")).alias("cls"))
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    groups = n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")
    out = enrich.class_label(t, "cls", n, "n_nationkey", "n_name", groups, "n_name", "r_name")
    return out.select("c_custkey", "cls", "class_name", "class_group", "class_label")


@register("semi_topn", """
WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM top)""")
def semi_topn(spark, sf):
    from civicflow.operators.categories import top_categories
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    top = top_categories(p, "p_brand", 10)
    return enrich.keep_in_set(p, "p_brand", top)


@register("unmatched_report", """
SELECT d.lang, CAST(count(*) AS BIGINT) AS rows, CAST(count(l.doc_id) AS BIGINT) AS matched,
       count(l.doc_id) / count(*) AS match_rate
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
GROUP BY d.lang""")
def unmatched_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lab = table(spark, sf, "labels").select("doc_id")
    return enrich.match_report(d, "doc_id", lab, "doc_id", by=["lang"])


@register("unmatched_keys", """
SELECT d.source, CAST(count(*) AS BIGINT) AS n
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
GROUP BY d.source""")
def unmatched_keys(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    lab = table(spark, sf, "labels").select("doc_id")
    return enrich.unmatched_keys(d, "doc_id", lab, "doc_id", by="source")
