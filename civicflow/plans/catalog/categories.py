"""Catalogue: ranking, top-k and category engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.operators import categories as cat
from civicflow.plans.catalog import register
from civicflow.session import table


def _r4(expr: str) -> str:
    return f"round_even(CAST({expr} AS DOUBLE) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE"


@register("top_categories", f"""
SELECT o_orderpriority, n, pct, CAST(rank AS INTEGER) AS rank FROM (
  SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n,
         {_r4('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()')} AS pct,
         row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rank
  FROM orders GROUP BY o_orderpriority)
WHERE o_orderpriority IS NOT NULL AND rank <= 30""")
def top_categories(spark, sf):
    """Flagship: top-30 order priorities with rank and share of all orders."""
    return cat.top_categories(table(spark, sf, "orders"), "o_orderpriority", 30).select(
        "o_orderpriority", "n", "pct", "rank")


@register("topn_bucket", """
WITH top AS (SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
             ORDER BY count(*) DESC, p_brand LIMIT 20)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'Other' END AS p_brand
FROM part""")
def topn_bucket(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return cat.TopNBucketer("p_brand", 20).fit(p).transform(p)


@register("topn_encode", """
WITH top AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source
             ORDER BY count(*) DESC, source LIMIT 10),
     t AS (SELECT doc_id, CASE WHEN source IN (SELECT source FROM top) THEN source ELSE 'sonstiges' END AS v
           FROM documents),
     codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT v FROM t))
SELECT t.doc_id, codes.code AS source_encoded FROM t JOIN codes ON t.v = codes.v""")
def topn_encode(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return cat.TopNEncoder("source", 10).fit(d).transform(d)


@register("dense_codes", """
SELECT o_orderkey,
       CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority,
       CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS o_custkey
FROM orders""")
def dense_codes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    return cat.DenseCodes(["o_orderstatus", "o_orderpriority", "o_custkey"]).fit(o).transform(o)


_RARE_PCT = 0.03


@register("rare_bucket", f"""
WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
     k AS (SELECT l_partkey FROM (SELECT l_partkey, {_r4('n * 100.0::DOUBLE / sum(n) OVER ()')} AS pct FROM c)
           WHERE l_partkey IS NOT NULL AND pct >= {_RARE_PCT})
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_partkey IS NULL THEN NULL
            WHEN l_partkey IN (SELECT l_partkey FROM k) THEN CAST(l_partkey AS VARCHAR) ELSE 'Other' END AS part_bucket
FROM lineitem""")
def rare_bucket(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             F.col("l_partkey").cast("string").alias("part_bucket"))
    return cat.RareBucketer("part_bucket", min_pct=_RARE_PCT).fit(li).transform(li)


def _cap(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, q.{c}_1 - 1.5::DOUBLE * (q.{c}_3 - q.{c}_1)), "
            f"q.{c}_3 + 1.5::DOUBLE * (q.{c}_3 - q.{c}_1)) END AS {c}")


@register("iqr_cap", f"""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS l_extendedprice_1,
                  quantile_cont(l_extendedprice, 0.75) AS l_extendedprice_3,
                  quantile_cont(l_quantity, 0.25) AS l_quantity_1, quantile_cont(l_quantity, 0.75) AS l_quantity_3
           FROM lineitem)
SELECT l_orderkey, l_linenumber, {_cap('l_extendedprice')}, {_cap('l_quantity')}
FROM lineitem, q""")
def iqr_cap(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return cat.IQRCapper(["l_extendedprice", "l_quantity"], k=1.5).fit(li).transform(li)


_CUT = "TIMESTAMP '1999-01-01'"


@register("min_share_classes", f"""
WITH train AS (SELECT * FROM lineitem WHERE l_shipdate < {_CUT}),
     test AS (SELECT * FROM lineitem WHERE l_shipdate >= {_CUT}),
     keep AS (SELECT l_quantity FROM (SELECT l_quantity, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct
                                      FROM train GROUP BY l_quantity) WHERE pct >= 1.5)
SELECT 'train' AS split, l_orderkey, l_linenumber, l_quantity FROM train WHERE l_quantity IN (SELECT l_quantity FROM keep)
UNION ALL
SELECT 'test', l_orderkey, l_linenumber, l_quantity FROM test WHERE l_quantity IN (SELECT l_quantity FROM keep)""")
def min_share_classes(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    cut = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    train, test = cat.min_share_filter(li.filter(F.col("l_shipdate") < cut), li.filter(F.col("l_shipdate") >= cut),
                                       "l_quantity", min_pct=1.5)
    cols = ["l_orderkey", "l_linenumber", "l_quantity"]
    return (train.select(F.lit("train").alias("split"), *cols)
                 .unionByName(test.select(F.lit("test").alias("split"), *cols)))
