"""Queries: score metrics and single-feature AUC (SCORE1-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.scalar import LEAK_AUC_THRESHOLD, PROBA_EPS
from foldwise.operators.scoring import METRICS, binary_metrics, single_feature_auc, with_summary
from foldwise.plans.inputs import base, prepared
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import auc_ctes, with_base

CLIP = f"greatest(least(score, 1 - {PROBA_EPS}), {PROBA_EPS})"


def _pointwise_sql(rel: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""SELECT {sel}-avg(y * ln(p) + (1 - y) * ln(1 - p)) AS logloss, avg((p - y) * (p - y)) AS brier
FROM {rel} {grp}"""


def _metric_sql(metric: str) -> str:
    ctes = ["cl AS (SELECT row_id, y, " + CLIP + " AS p FROM base)", auc_ctes("a", "cl", "p", "y"),
            "pw AS (" + _pointwise_sql("cl") + ")"]
    return with_base(*ctes) + f"\nSELECT round({metric}, 6) AS value FROM a CROSS JOIN pw"


def _metric_query(metric: str):
    def q(spark, sf):
        m = binary_metrics(base(spark, sf), "score", "y")
        return m.select(r6(metric).alias("value"))
    q.__name__ = f"q_metric_{metric}"
    return q


for _m in METRICS:
    register(f"metric_{_m}", _metric_sql(_m))(_metric_query(_m))


BY_FOLD_SQL = with_base(
    "cl AS (SELECT row_id, y, fold, " + CLIP + " AS p FROM prepared WHERE fold IS NOT NULL)",
    auc_ctes("a", "cl", "p", "y", ["fold"]),
    "pw AS (" + _pointwise_sql("cl", "fold") + ")",
    "m AS (SELECT a.fold, a.auc, pw.logloss, a.pr_auc, a.ks, pw.brier FROM a JOIN pw ON a.fold = pw.fold)") + f"""
SELECT CAST(fold AS INTEGER) AS fold, {", ".join(f"round({c}, 6) AS {c}" for c in METRICS)} FROM m
UNION ALL SELECT -1, {", ".join(f"round(avg({c}), 6)" for c in METRICS)} FROM m
UNION ALL SELECT -2, {", ".join(f"round(stddev_pop({c}), 6)" for c in METRICS)} FROM m"""


@register("metrics_by_fold", BY_FOLD_SQL)
def q_metrics_by_fold(spark, sf):
    """SCORE6: five metrics per validation fold in one job, plus their mean (fold -1)
    and population std (fold -2, Q6)."""
    p = prepared(spark, sf).where(F.col("fold").isNotNull())
    m = with_summary(binary_metrics(p, "score", "y", by=["fold"]))
    return m.select("fold", *[r6(c).alias(c) for c in METRICS])


SFA_FEATURES = ["price", "bal", "price_n", "score", "seg"]
SFA_NUM = ["price", "bal", "price_n", "score"]
SFA_SQL = with_base(
    "lf AS (" + "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, y FROM base" for c in SFA_NUM) + ")",
    auc_ctes("a", "lf", "v", "y", ["feature"])) + f"""
SELECT f.feature, round(CASE WHEN a.P > 0 AND a.N > 0 AND a.nd >= 2 THEN greatest(a.auc, 1 - a.auc) END, 6) AS auc,
       coalesce(CASE WHEN a.P > 0 AND a.N > 0 AND a.nd >= 2 THEN greatest(a.auc, 1 - a.auc) END >= {LEAK_AUC_THRESHOLD}, false) AS flag
FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in SFA_FEATURES) + """) f
LEFT JOIN a ON f.feature = a.feature"""


@register("single_feature_auc", SFA_SQL)
def q_single_feature_auc(spark, sf):
    a = single_feature_auc(base(spark, sf), SFA_FEATURES, "y", "row_id")
    return a.select("feature", r6("auc").alias("auc"), "flag")
