"""Registered queries: evaluation of scored rows (M9-M12, M14-M16) and H3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import features as FT
from ..operators import profile as G
from ..sources import fixtures as fx
from .q_profile import histogram_sql, round_hist
from .registry import register

_FX = fx.with_fx("fx_scored")


@register("roc_auc", _FX + """, c AS (SELECT score, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS n_pos,
   sum(CASE WHEN target = 1 THEN 0 ELSE 1 END) AS n_neg FROM fx_scored GROUP BY score),
r AS (SELECT *, sum(n_neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_neg AS below FROM c)
SELECT round(sum(n_pos * (below + 0.5e0 * n_neg)) / (sum(n_pos) * sum(n_neg)), 6) AS auc FROM r""")
def q_roc_auc(spark, d):
    return E.roc_auc(fx.fx_scored(spark, d)).select(F.round("auc", 6).alias("auc"))


_CNT = """, p AS (SELECT target, CASE WHEN score >= 0.5e0 THEN 1 ELSE 0 END AS prediction FROM fx_scored),
k AS (SELECT sum(CASE WHEN target = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN target <> 1 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN target = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN target <> 1 AND prediction = 0 THEN 1 ELSE 0 END) AS tn FROM p)
"""


def _div(a, b):
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0e0 END)"


@register("classification_metrics", _FX + _CNT + f"""SELECT round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
  round(pr, 6) AS precision, round(rc, 6) AS recall, round({_div('2 * pr * rc', 'pr + rc')}, 6) AS f1
FROM (SELECT *, {_div('tp', 'tp + fp')} AS pr, {_div('tp', 'tp + fn')} AS rc FROM k)""")
def q_classification_metrics(spark, d):
    m = E.classification_metrics(fx.fx_scored(spark, d))
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("confusion_matrix", _FX + _CNT.split(",\nk AS")[0] + """
SELECT target, CAST(prediction AS INT) AS prediction, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2""")
def q_confusion_matrix(spark, d):
    return E.confusion_matrix(fx.fx_scored(spark, d))


@register("classification_report", _FX + _CNT + f""", rows AS (
  SELECT '1' AS label, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, tp + fn AS support FROM k
  UNION ALL SELECT '0', {_div('tn', 'tn + fn')}, {_div('tn', 'tn + fp')}, tn + fp FROM k),
r2 AS (SELECT *, {_div('2 * precision * recall', 'precision + recall')} AS f1 FROM rows)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, CAST(support AS BIGINT) AS support,
       round(f1, 6) AS f1 FROM r2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), CAST(sum(support) AS BIGINT),
       round(avg(f1), 6) FROM r2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), CAST(sum(support) AS BIGINT),
       round(sum(f1 * support) / sum(support), 6) FROM r2""")
def q_classification_report(spark, d):
    r = E.classification_report(fx.fx_scored(spark, d))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall")],
                    F.col("support").cast("bigint").alias("support"), F.round("f1", 6).alias("f1"))


@register("probability_distribution", _FX + """SELECT target, round(avg(score), 6) AS mean,
  round(median(score), 6) AS median, round(stddev_pop(score), 6) AS std FROM fx_scored GROUP BY target""")
def q_probability_distribution(spark, d):
    p = E.probability_distribution(fx.fx_scored(spark, d))
    return p.select("target", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@register("roc_curve", _FX + """, c AS (SELECT score, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS n_pos,
   sum(CASE WHEN target = 1 THEN 0 ELSE 1 END) AS n_neg FROM fx_scored GROUP BY score),
t AS (SELECT sum(n_pos) AS P, sum(n_neg) AS N FROM c)
SELECT score AS threshold,
  round(CASE WHEN N > 0 THEN sum(n_neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / N ELSE 0e0 END, 6) AS fpr,
  round(CASE WHEN P > 0 THEN sum(n_pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / P ELSE 0e0 END, 6) AS tpr
FROM c, t""")
def q_roc_curve(spark, d):
    r = E.roc_curve(fx.fx_scored(spark, d))
    return r.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register("score_histogram_by_class", _FX + histogram_sql("fx_scored", "score", 50, "target"))
def q_score_histogram_by_class(spark, d):
    return round_hist(G.histogram(fx.fx_scored(spark, d), "score", 50, ["target"]))


def split_sql(key: str) -> str:
    """H3 in DuckDB: the share of 0.2 of each target, first by hash."""
    u = f"CAST('0x' || substr(md5('42|' || {key}), 1, 8) AS BIGINT)"
    return (f"row_number() OVER (PARTITION BY target ORDER BY {u}, {key}) "
            "<= floor(count(*) OVER (PARTITION BY target) * 0.2e0 + 0.5e0)")


@register("stratified_split", _FX + f"""SELECT doc_id, target, {split_sql('CAST(doc_id AS VARCHAR)')} AS is_valid
FROM fx_scored""")
def q_stratified_split(spark, d):
    return FT.stratified_split(fx.fx_scored(spark, d), "doc_id").select("doc_id", "target", "is_valid")
