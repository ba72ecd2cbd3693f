"""Catalogue: classification evaluation.

Truth y = labels.quality; rule predictor p = (documents.n_chars > 500);
score = n_chars.
"""

from __future__ import annotations

from civicflow.operators import metrics
from civicflow.plans.catalog import register
from civicflow.plans.catalog.profile import _YP_SQL, labelled

_CONF_SQL = f"""
WITH t AS ({_YP_SQL}),
     c AS (SELECT y, p, count(*) AS n FROM t GROUP BY y, p),
     l AS (SELECT y AS v FROM c UNION SELECT p FROM c)
SELECT a.v AS y, b.v AS p, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM l a JOIN l b ON true LEFT JOIN c ON c.y = a.v AND c.p = b.v"""

_PER_CLASS_SQL = f"""
WITH conf AS ({_CONF_SQL}),
     k AS (SELECT l.v AS label,
                  (SELECT sum(n) FROM conf WHERE y = l.v AND p = l.v) AS tp,
                  (SELECT sum(n) FROM conf WHERE y = l.v) AS support,
                  (SELECT sum(n) FROM conf WHERE p = l.v) AS predicted
           FROM (SELECT DISTINCT y AS v FROM conf) l)
SELECT label, tp, support, predicted,
       CASE WHEN predicted <> 0 THEN tp / predicted ELSE 0.0 END AS prec,
       CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS rec
FROM k"""


@register("confusion", _CONF_SQL)
def confusion(spark, sf):
    return metrics.confusion_counts(labelled(spark, sf), "y", "p")


@register("class_report", f"""
WITH k AS ({_PER_CLASS_SQL}),
     r AS (SELECT CAST(label AS VARCHAR) AS label, prec AS precision, rec AS recall,
                  CASE WHEN prec + rec <> 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1,
                  CAST(support AS BIGINT) AS support FROM k)
SELECT * FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r""")
def class_report(spark, sf):
    return metrics.class_report(labelled(spark, sf), "y", "p")


@register("kappa_mcc", f"""
WITH k AS ({_PER_CLASS_SQL}),
     f AS (SELECT *, CASE WHEN prec + rec <> 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM k),
     a AS (SELECT CAST(sum(support) AS DOUBLE) AS s, CAST(sum(tp) AS DOUBLE) AS c,
                  CAST(sum(predicted * support) AS DOUBLE) AS pt, CAST(sum(predicted * predicted) AS DOUBLE) AS pp,
                  CAST(sum(support * support) AS DOUBLE) AS tt, sum(prec * support) AS wp, sum(rec * support) AS wr,
                  sum(f1 * support) AS wf, avg(f1) AS f1_macro FROM f)
SELECT CAST(s AS BIGINT) AS n, c / s AS accuracy,
       CASE WHEN pt / (s * s) <> 1 THEN (c / s - pt / (s * s)) / (1 - pt / (s * s)) ELSE 0.0 END AS kappa,
       CASE WHEN sqrt((s * s - pp) * (s * s - tt)) <> 0 THEN (c * s - pt) / sqrt((s * s - pp) * (s * s - tt))
            ELSE 0.0 END AS mcc,
       wp / s AS precision_weighted, wr / s AS recall_weighted, wf / s AS f1_weighted, f1_macro
FROM a""")
def kappa_mcc(spark, sf):
    return metrics.summary_metrics(labelled(spark, sf), "y", "p")


@register("auc_ovr", f"""
WITH t AS ({_YP_SQL}),
     g AS (SELECT CAST(n_chars AS DOUBLE) AS score, count(*) AS n, sum(CAST(y = 1 AS INTEGER)) AS npos FROM t GROUP BY 1),
     r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     + (n + 1) / 2.0::DOUBLE AS rk FROM g),
     a AS (SELECT sum(npos * rk) AS R, CAST(sum(npos) AS DOUBLE) AS P, CAST(sum(n) AS DOUBLE) AS T FROM r)
SELECT 1 AS cls, (R - P * (P + 1) / 2) / (P * (T - P)) AS auc, CAST(P AS BIGINT) AS support FROM a""")
def auc_ovr(spark, sf):
    return metrics.auc_binary(labelled(spark, sf), "y", "n_chars", positive=1)
