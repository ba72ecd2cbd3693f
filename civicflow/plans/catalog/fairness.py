"""Catalogue: fairness audit (K1-K12) on labels x documents.

y = quality, p = (n_chars > 500), groups = lang (and the tuple lang, source).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow import sources
from civicflow.operators import fairness as fair
from civicflow.plans.catalog import register
from civicflow.plans.catalog.profile import _YP_SQL, labelled
from civicflow.session import cut_lineage

# K9 parameter: common-rate grid 0..1 in steps of 1/1000.
GRID = 1000


def _rates_sql(group: str, rows: str = _YP_SQL) -> str:
    return f"""
    WITH t AS ({rows}), cls AS (SELECT DISTINCT y AS c FROM t)
    SELECT cls.c AS cls, {group}, CAST(count(*) AS BIGINT) AS rows,
           count_if(p = cls.c) / count(*) AS selection_rate,
           CASE WHEN count_if(y = cls.c) > 0 THEN count_if(y = cls.c AND p = cls.c) / count_if(y = cls.c)
                ELSE 0.0 END AS tpr,
           CASE WHEN count_if(y <> cls.c) > 0 THEN count_if(y <> cls.c AND p = cls.c) / count_if(y <> cls.c)
                ELSE 0.0 END AS fpr
    FROM t JOIN cls ON true GROUP BY cls.c, {group}"""


def _r3(e: str) -> str:
    return f"round_even(({e}) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE"


def _metrics_sql(groups: str, first: str, rows: str = _YP_SQL) -> str:
    return f"""
    WITH a AS ({_rates_sql(groups, rows)}), b AS ({_rates_sql(first, rows)}),
         dp AS (SELECT cls, max(selection_rate) - min(selection_rate) AS dpd,
                       greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eod FROM a GROUP BY cls),
         di AS (SELECT cls, CASE WHEN max(selection_rate) > 0 THEN min(selection_rate) / max(selection_rate) END AS dir
                FROM b GROUP BY cls)
    SELECT dp.cls, {_r3('dpd')} AS {fair.DPD}, {_r3('eod')} AS {fair.EOD}, {_r3('dir')} AS {fair.DIR}
    FROM dp JOIN di ON dp.cls = di.cls"""


@register("fair_rates", _rates_sql("lang"))
def fair_rates(spark, sf):
    return fair.group_rates(labelled(spark, sf), "y", "p", ["lang"])


@register("fair_per_class", _metrics_sql("lang", "lang"))
def fair_per_class(spark, sf):
    return fair.per_class_metrics(labelled(spark, sf), "y", "p", ["lang"])


@register("fair_per_class_tuple", _metrics_sql("lang, source", "lang"))
def fair_per_class_tuple(spark, sf):
    return fair.per_class_metrics(labelled(spark, sf), "y", "p", ["lang", "source"])


@register("fair_verdict", f"""
WITH m AS ({_metrics_sql('lang', 'lang')})
SELECT max({fair.DPD}) AS max_dpd, max({fair.EOD}) AS max_eod, bool_or({fair.DPD} > 0.2) AS dpd_violation,
       bool_or({fair.EOD} > 0.2) AS eod_violation,
       coalesce(bool_or({fair.DIR} IS NOT NULL AND NOT isnan({fair.DIR}) AND ({fair.DIR} < 0.8 OR {fair.DIR} > 1.2)), false)
         AS dir_violation,
       bool_or({fair.DPD} > 0.2) OR bool_or({fair.EOD} > 0.2)
         OR coalesce(bool_or({fair.DIR} IS NOT NULL AND NOT isnan({fair.DIR}) AND ({fair.DIR} < 0.8 OR {fair.DIR} > 1.2)), false)
         AS violation
FROM m""")
def fair_verdict(spark, sf):
    return fair.verdict(fair.per_class_metrics(labelled(spark, sf), "y", "p", ["lang"]))


@register("reweigh", f"""
WITH t AS ({_YP_SQL})
SELECT doc_id, lang, y, count(*) OVER () / count(*) OVER (PARTITION BY lang, y) AS weight FROM t""")
def reweigh(spark, sf):
    return fair.reweigh(labelled(spark, sf), ["lang"], "y").select("doc_id", "lang", "y", "weight")


@register("reweigh_independence", f"""
WITH t AS ({_YP_SQL})
SELECT doc_id, lang, y,
       CAST(count(*) OVER (PARTITION BY lang) AS DOUBLE) * count(*) OVER (PARTITION BY y)
         / (count(*) OVER () * count(*) OVER (PARTITION BY lang, y)) AS weight
FROM t""")
def reweigh_independence(spark, sf):
    return fair.reweigh(labelled(spark, sf), ["lang"], "y", method="independence").select("doc_id", "lang", "y", "weight")


def _thresholds_sql(rows: str) -> str:
    """K9 over rows (g, y, score): a point is a vertex of its group's hull if
    every slope from the left is steeper than every slope to the right."""
    return f"""
WITH b AS (SELECT g, coalesce(y = 1, false) AS pos, CASE WHEN NOT isnan(score) THEN score END AS score FROM ({rows})),
     gs AS (SELECT g, count(*) AS n, count_if(pos) AS p FROM b GROUP BY g),
     pt AS (SELECT g, sum(c) OVER o AS x, sum(2 * tp - c) OVER o + (SELECT n - p FROM gs WHERE gs.g IS NOT DISTINCT FROM t.g) AS y, score
            FROM (SELECT g, score, count(*) AS c, count_if(pos) AS tp FROM b WHERE score IS NOT NULL GROUP BY g, score) t WINDOW o AS (PARTITION BY g ORDER BY score DESC)
            UNION ALL SELECT g, 0, n - p, NULL FROM gs),
     v AS (SELECT p.g, p.x, p.y, p.score FROM pt p LEFT JOIN pt o ON o.g IS NOT DISTINCT FROM p.g AND o.x <> p.x GROUP BY p.g, p.x, p.y, p.score
           HAVING coalesce(min((p.y - o.y) / (p.x - o.x)::DOUBLE) FILTER (o.x < p.x), 9) > coalesce(max((o.y - p.y) / (o.x - p.x)::DOUBLE) FILTER (o.x > p.x), -9)),
     edge AS (SELECT g, x AS x0, y AS y0, score AS high, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(score) OVER w AS low, count(*) OVER (PARTITION BY g) AS k
              FROM v WINDOW w AS (PARTITION BY g ORDER BY x)),
     full_edge AS (SELECT g, x0, y0, high, coalesce(x1, x0) AS x1, coalesce(y1, y0) AS y1, CASE WHEN x1 IS NULL THEN high ELSE low END AS low
                   FROM edge WHERE x1 IS NOT NULL OR k = 1),
     per AS (SELECT e.*, n, i, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (i * n / {GRID}::DOUBLE - x0) / (x1 - x0) ELSE y0 END AS val
             FROM full_edge e JOIN gs ON gs.g IS NOT DISTINCT FROM e.g JOIN (SELECT range AS i FROM range(0, {GRID + 1})) r
               ON i * n <= x1 * {GRID} AND (i * n > x0 * {GRID} OR (i = 0 AND x0 = 0))),
     acc AS (SELECT i, round(sum(val) / sum(n), 12) AS pooled_accuracy FROM per GROUP BY i HAVING count(*) = (SELECT count(*) FROM gs)),
     best AS (SELECT i, pooled_accuracy FROM acc ORDER BY pooled_accuracy DESC, i LIMIT 1)
SELECT g, high, low, CAST(floor(best.i * n / {GRID}::DOUBLE + 0.5) - x0 AS BIGINT) AS take, CAST(floor(best.i * n / {GRID}::DOUBLE + 0.5) AS BIGINT) AS selected,
       n AS rows, best.i / {float(GRID)}::DOUBLE AS best_rate, best.pooled_accuracy
FROM best JOIN per ON per.i = best.i"""


def _moved_sql(rows: str) -> str:
    """Rows (doc_id, g, y, score) with ``p_adj``: above the upper threshold, or among the first of the band by hash."""
    return f"""
SELECT doc_id, g, y, score, CAST(above OR (band AND row_number() OVER (PARTITION BY g, band ORDER BY md5(doc_id || ':42'), doc_id) <= take) AS INTEGER) AS p_adj
FROM (SELECT r.*, m.take, coalesce(score >= high, false) AS above, coalesce(score >= low, false) AND NOT coalesce(score >= high, false) AS band
      FROM ({rows}) r JOIN ({_thresholds_sql(rows)}) m ON r.g IS NOT DISTINCT FROM m.g)"""


_YP_SCORE_SQL = f"SELECT doc_id, lang AS g, y, CAST(n_chars AS DOUBLE) AS score FROM ({_YP_SQL})"
_ADJUSTED_SQL = f"SELECT t.*, m.p_adj FROM ({_YP_SQL}) t JOIN ({_moved_sql(_YP_SCORE_SQL)}) m ON t.doc_id = m.doc_id"


@register("threshold_moving", f"SELECT g AS lang, * EXCLUDE (g) FROM ({_thresholds_sql(_YP_SCORE_SQL)})")
def threshold_moving(spark, sf):
    thresholds, _ = fair.threshold_moving(labelled(spark, sf), "lang", "y", "n_chars", GRID)
    return thresholds


def _adjusted(spark, sf):
    df = labelled(spark, sf)
    thresholds, _ = fair.threshold_moving(df, "lang", "y", "n_chars", GRID)
    return fair.apply_thresholds(df, thresholds, "lang", "n_chars", "doc_id", out="p_adj")


_ADJUSTED_YP = f"SELECT * REPLACE (p_adj AS p) FROM ({_ADJUSTED_SQL})"


@register("fair_compare", f"""
WITH b AS ({_metrics_sql('lang', 'lang')}), a AS ({_metrics_sql('lang', 'lang', _ADJUSTED_YP)})
SELECT coalesce(b.cls, a.cls) AS cls, {', '.join(f'b.{c} AS {c}_before' for c in (fair.DPD, fair.EOD, fair.DIR))},
       {', '.join(f'a.{c} AS {c}_after' for c in (fair.DPD, fair.EOD, fair.DIR))}, a.{fair.DPD} - b.{fair.DPD} AS dpd_change
FROM b FULL JOIN a ON a.cls = b.cls""")
def fair_compare(spark, sf):
    """Metrics before vs after threshold moving."""
    before_m = fair.per_class_metrics(labelled(spark, sf), "y", "p", ["lang"])
    after_m = fair.per_class_metrics(_adjusted(spark, sf), "y", "p_adj", ["lang"])
    return fair.compare(before_m, after_m)


@register("fair_accuracy_change", f"""
SELECT avg(CAST(y = p AS INTEGER)) AS accuracy_before, avg(CAST(y = p_adj AS INTEGER)) AS accuracy_after,
       avg(CAST(y = p_adj AS INTEGER)) - avg(CAST(y = p AS INTEGER)) AS accuracy_change FROM ({_ADJUSTED_SQL})""")
def fair_accuracy_change(spark, sf):
    return fair.accuracy_change(_adjusted(spark, sf), "y", "p", "p_adj")


@register("metric_flags", f"""
WITH m AS ({_metrics_sql('lang, source', 'lang')})
SELECT *, {fair.DPD} > 0.1 AS dpd_flag, {fair.EOD} > 0.1 AS eod_flag FROM m""")
def metric_flags(spark, sf):
    m = fair.per_class_metrics(labelled(spark, sf), "y", "p", ["lang", "source"])
    return fair.metric_flags(m, cutoff=0.1)


@register("fair_adjusted_rates", f"SELECT * FROM ({_rates_sql('lang', _ADJUSTED_YP)}) WHERE cls = 1")
def fair_adjusted_rates(spark, sf):
    """K9 step 5 + K1: selection rates per group after applying the moved thresholds."""
    return fair.group_rates(_adjusted(spark, sf), "y", "p_adj", ["lang"], classes=[1])


# ---------------------------------------------------------------- K10

# The audited model is a table of (weighted) label rates per length class, so that SQL can follow it.
_LENGTH = "CAST(least(n_chars // 400, 12) AS INTEGER)"
_AUDIT_ROWS = f"SELECT doc_id, lang, y, {_LENGTH} AS b FROM ({_YP_SQL})"


def _rate_fit(train, weight):
    """Label rate per length class; a class that wasn't trained on has the overall rate."""
    w = F.col(weight) if weight else F.lit(1.0)
    t = cut_lineage(train.groupBy("b").agg(F.sum(w * F.col("y")).alias("_pos"), F.sum(w).alias("_all")))
    overall = t.agg(F.round(F.sum("_pos") / F.sum("_all"), 9)).scalar()
    rates = t.select("b", F.round(F.col("_pos") / F.col("_all"), 9).alias("_rate"))
    return lambda rows: (rows.join(F.broadcast(rates), "b", "left").withColumn("score", F.coalesce("_rate", overall)).drop("_rate")
                         .withColumn("prediction", (F.col("score") >= 0.9).cast("int")))


def _scored_sql(weight: str) -> str:
    return f"""
    SELECT s.doc_id, s.lang, s.y, s.score, CAST(s.score >= 0.9 AS INTEGER) AS p FROM (
      SELECT t.*, coalesce(r.rate, (SELECT round(sum(w * y) / sum(w), 9) FROM w)) AS score
      FROM r0 t LEFT JOIN (SELECT b, round(sum(w * y) / sum(w), 9) AS rate FROM w GROUP BY b) r USING (b) WHERE t.doc_id % 3 = 0) s"""


def _audit_stage(weight: str, inner: str) -> str:
    return f"""
    WITH r0 AS ({_AUDIT_ROWS}), tr AS (SELECT * FROM r0 WHERE doc_id % 3 <> 0), w AS (SELECT *, {weight} AS w FROM tr)
    {inner}"""


_PLAIN = _audit_stage("1.0::DOUBLE", _scored_sql(""))
_REWEIGHED = _audit_stage("count(*) OVER () / count(*) OVER (PARTITION BY lang, y)", _scored_sql(""))
_MOVED = f"SELECT doc_id, g AS lang, y, p_adj AS p FROM ({_moved_sql(f'SELECT doc_id, lang AS g, y, score FROM ({_REWEIGHED})')})"


def _stage_sql(rows: str, stage: str, only: str = "") -> str:
    return f"""SELECT *, '{stage}' AS stage, (SELECT avg(CAST(y = p AS INTEGER)) FROM ({rows})) AS accuracy
    FROM ({_metrics_sql('lang', 'lang', rows)}) {only}"""


@register("audit_flow", f"""
{_stage_sql(_PLAIN, 'plain')} UNION ALL {_stage_sql(_REWEIGHED, 'reweighed')} UNION ALL {_stage_sql(_MOVED, 'adjusted', 'WHERE cls = 1')}""")
def audit_flow(spark, sf):
    """Audit of a table model on every third labelled document."""
    rows = cut_lineage(labelled(spark, sf).select("doc_id", "lang", "y", F.expr("cast(least(n_chars div 400, 12) as int)").alias("b")))
    found = fair.audit_flow(rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 = 0"), "doc_id", "y", ["lang"], "lang",
                            _rate_fit, sources.scratch_path(spark, "adjusted"), target=1, grid_steps=GRID)
    return found.metrics
