"""Catalogue: feature scaling (H1, H2) and class-balance weights (H3)."""

from __future__ import annotations

from civicflow.operators import scaling
from civicflow.plans.catalog import register
from civicflow.session import table

_YJ_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


@register("zscore", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
                  avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM lineitem)
SELECT l_orderkey, l_linenumber, (l_quantity - mq) / sq AS l_quantity, (l_extendedprice - me) / se AS l_extendedprice
FROM lineitem, s""")
def zscore(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return scaling.ZScore(["l_quantity", "l_extendedprice"]).fit(li).transform(li)


def _yj_sql(c: str, lam: float) -> str:
    pos = f"ln(1 + {c})" if lam == 0 else f"(pow({c} + 1, {lam}::DOUBLE) - 1) / {lam}::DOUBLE"
    neg = f"-ln(1 - {c})" if lam == 2 else f"-(pow(1 - {c}, {2 - lam}::DOUBLE) - 1) / {2 - lam}::DOUBLE"
    return f"CASE WHEN {c} >= 0 THEN {pos} ELSE {neg} END"


def _grid_sql() -> str:
    parts = []
    for c in _YJ_COLS:
        for lam in scaling.DEFAULT_LAMBDAS:
            parts.append(
                f"SELECT '{c}' AS column_name, {lam}::DOUBLE AS \"lambda\", "
                f"-count(*) / 2.0::DOUBLE * ln(var_pop({_yj_sql(c, lam)})) "
                f"+ ({lam}::DOUBLE - 1) * sum(sign({c}) * ln(1 + abs({c}))) AS llf FROM lineitem")
    return f"""
WITH g AS ({' UNION ALL '.join(parts)})
SELECT column_name, "lambda" FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY llf DESC, "lambda") AS r FROM g) WHERE r = 1"""


@register("yeo_johnson_grid", _grid_sql())
def yeo_johnson_grid(spark, sf):
    li = table(spark, sf, "lineitem").select(*_YJ_COLS)
    return scaling.YeoJohnsonGrid(_YJ_COLS).fit(li).table.select("column_name", "lambda")


@register("balance_weights", """
SELECT l_orderkey, l_linenumber, l_returnflag,
       count(*) OVER () / (count(DISTINCT l_returnflag) OVER () * count(*) OVER (PARTITION BY l_returnflag)) AS weight
FROM lineitem""")
def balance_weights(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return scaling.class_balance_weights(li, "l_returnflag")
