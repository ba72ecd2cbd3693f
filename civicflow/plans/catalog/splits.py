"""Catalogue: reproducible sampling and exact stratified splits.

Row order is md5('<key>:<seed>') (hex text), reproduced verbatim in SQL.
"""

from __future__ import annotations

from civicflow.operators import split
from civicflow.plans.catalog import register
from civicflow.session import table

SEED = 42


def _quota_sql(src: str, strata: str, total_expr: str, quota_expr: str) -> str:
    """Largest-remainder class quotas over the rows of ``src`` (SQL text)."""
    return f"""
    SELECT {strata}, n, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, {strata})
                                     <= ({quota_expr}) - sum(base) OVER () THEN 1 ELSE 0 END AS quota
    FROM (SELECT {strata}, n, (n * ({quota_expr})) // ({total_expr}) AS base,
                 (n * ({quota_expr})) % ({total_expr}) AS rem
          FROM (SELECT {strata}, count(*) AS n FROM {src} GROUP BY {strata}))"""


def _split_sql(tbl: str, key: str, strata: str, total: int, test: int) -> str:
    return f"""
WITH h AS (SELECT {key}, {strata}, md5(CAST({key} AS VARCHAR) || ':{SEED}') AS h FROM {tbl}),
     nn AS (SELECT count(*) AS n FROM h),
     drawn AS (SELECT * FROM (SELECT h.*, row_number() OVER (ORDER BY h, {key}) AS gr FROM h)
               WHERE gr <= {total}),
     sizes AS (SELECT least(n, {total}) AS t,
                      CASE WHEN n >= {total} THEN {test} ELSE least({test}, CAST(floor(0.1 * n) AS BIGINT)) END AS q
               FROM nn),
     quotas AS ({_quota_sql('drawn', strata, '(SELECT t FROM sizes)', '(SELECT q FROM sizes)')}),
     ranked AS (SELECT d.{key}, d.{strata}, q.n, q.quota,
                       row_number() OVER (PARTITION BY d.{strata} ORDER BY d.h, d.{key}) AS r
                FROM drawn d JOIN quotas q ON d.{strata} = q.{strata})
SELECT {key}, {strata}, CASE WHEN r > n - quota THEN 'test' ELSE 'train' END AS split FROM ranked"""


@register("exact_split", _split_sql("orders", "o_orderkey", "o_orderpriority", 66000, 6000))
def exact_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.exact_stratified_split(o, "o_orderkey", "o_orderpriority", SEED, total=66_000, test=6_000)


@register("split_small", _split_sql("customer", "c_custkey", "c_mktsegment", 66000, 6000))
def split_small(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return split.exact_stratified_split(c, "c_custkey", "c_mktsegment", SEED, total=66_000, test=6_000)


# The same draw below the row count of every driver table of 0.01 and up, so
# that the large branch has an oracle.
@register("exact_split_drawn", _split_sql("orders", "o_orderkey", "o_orderpriority", 1000, 90))
def exact_split_drawn(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.exact_stratified_split(o, "o_orderkey", "o_orderpriority", SEED, total=1_000, test=90)


def _two_stage_sql(stage1: int, train: int) -> str:
    return f"""
WITH h AS (SELECT o_orderkey, o_orderpriority, md5(CAST(o_orderkey AS VARCHAR) || ':{SEED}') AS h FROM orders),
     nn AS (SELECT count(*) AS n, least(count(*), {stage1}) AS t,
                   CASE WHEN count(*) >= {stage1} THEN {stage1 - train} ELSE least({stage1 - train}, count(*) // 10) END AS q
            FROM h),
     q1 AS ({_quota_sql('h', 'o_orderpriority', '(SELECT n FROM nn)', '(SELECT t FROM nn)')}),
     drawn AS (SELECT o_orderkey, o_orderpriority, h FROM (
                 SELECT h.*, q1.quota, row_number() OVER (PARTITION BY h.o_orderpriority ORDER BY h.h, h.o_orderkey) AS r
                 FROM h JOIN q1 ON h.o_orderpriority = q1.o_orderpriority) WHERE r <= quota),
     q2 AS ({_quota_sql('drawn', 'o_orderpriority', '(SELECT t FROM nn)', '(SELECT q FROM nn)')}),
     ranked AS (SELECT d.o_orderkey, d.o_orderpriority, q2.n, q2.quota,
                       row_number() OVER (PARTITION BY d.o_orderpriority ORDER BY d.h, d.o_orderkey) AS r
                FROM drawn d JOIN q2 ON d.o_orderpriority = q2.o_orderpriority)
SELECT o_orderkey, o_orderpriority, CASE WHEN r > n - quota THEN 'test' ELSE 'train' END AS split FROM ranked"""


@register("two_stage_split", _two_stage_sql(6_500, 6_000))
def two_stage_split(spark, sf):
    """A tenth of the usual sizes: both stages run on the smaller driver tables."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.two_stage_split(o, "o_orderkey", "o_orderpriority", SEED, stage1=6_500, train=6_000)


@register("two_stage_split_full", _two_stage_sql(65_000, 60_000))
def two_stage_split_full(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.two_stage_split(o, "o_orderkey", "o_orderpriority", SEED)


@register("fold_ids", f"""
SELECT o_orderkey, o_orderpriority,
       CAST((row_number() OVER (PARTITION BY o_orderpriority
                                ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':{SEED}'), o_orderkey) - 1) % 10
            AS INTEGER) AS fold
FROM orders""")
def fold_ids(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.stratified_fold_ids(o, "o_orderkey", "o_orderpriority", k=10, seed=SEED)


@register("seeded_sample", f"""
SELECT o_orderkey FROM orders
WHERE CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':{SEED}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.1""")
def seeded_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return split.seeded_sample(o, "o_orderkey", 0.1, SEED)
