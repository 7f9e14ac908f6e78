"""Queries: models, attribution and model-driven selection (ML1-5, SHAP1-2, SEL1, SEL4,
SEL5). SQL checks what doesn't depend on the learner: the encodings, a one-column model's optimum (Newton's
steps in SQL) and linear SHAP; the others are compared with single fits and direct computation in the unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.hashing import h_duckdb
from foldwise.operators import models as ml
from foldwise.operators.encoding import ordered_statistics
from foldwise.operators.selection import forward_search, lift_screen, selection_round
from foldwise.plans.inputs import K, SEED, base, prepared
from foldwise.plans.q_features import assembled_rows
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import with_base
from foldwise.session import materialize

NUM = ["price", "bal", "price_n"]
CAT = ["seg", "pri"]
LR = ml.ModelSpec(kind="logistic", max_iter=30)


def selection_frame(spark, sf):
    """Raw columns + out-of-fold candidate features, one row per order, written once to
    the checkpoint folder: every model fit of a selection round reads it."""
    return materialize(assembled_rows(prepared(spark, sf)), "selection")


BASELINE = ["price", "bal", "seg", "pri"]
CANDIDATES = ["te_seg", "freq_pri", "ratio_price_bal", "score"]


def _cv(spark, sf, spec=LR):
    return ml.cross_validate(prepared(spark, sf), "row_id", "y", NUM, CAT, K, spec=spec)


def _full(spark, sf):
    """The design of dev and holdout rows, its full model and its fold models."""
    design, model = ml.fit(prepared(spark, sf), "row_id", "y", NUM, CAT, LR, k=K)
    return design, model


@register("cv_oof_predictions")
def q_cv_oof_predictions(spark, sf):
    r = _cv(spark, sf)
    return r.oof.select("row_id", "fold", r6("proba").alias("proba"))


def _newton_sql(steps: int = 12) -> str:
    """CTEs ``it0`` to ``it<steps>`` (i, b0, b1): Newton steps of the model of every fold left out on one standardised
    column, and ``tr`` (i, y, z), ``st`` (i, m, s) behind them."""
    lam = LR.reg_param
    ctes = [f"st AS (SELECT i, avg(price) AS m, stddev_samp(price) AS s FROM prepared, (SELECT unnest(range({K})) AS i) WHERE fold IS NOT NULL AND fold <> i GROUP BY i)",
            "tr AS (SELECT i, y, (price - m) / s AS z FROM prepared, st WHERE fold IS NOT NULL AND fold <> i)",
            "it0 AS (SELECT i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM st)"]
    for n in range(steps):
        ctes.append(f"""it{n + 1} AS (
  SELECT i, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM (
    SELECT i, b0, b1, avg(p - y) AS g0, avg((p - y) * z) + {lam} * b1 AS g1, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * z) AS h01, avg(p * (1 - p) * z * z) + {lam} AS h11
    FROM (SELECT i, b0, b1, y, z, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM it{n} JOIN tr USING (i)) GROUP BY i, b0, b1))""")
    return with_base(*ctes)


@register("cv_one_column", _newton_sql() + """
SELECT row_id, fold, round(1 / (1 + exp(-(b0 + b1 * (price - m) / s))), 6) AS proba
FROM prepared JOIN it12 ON fold = it12.i JOIN st ON fold = st.i""")
def q_cv_one_column(spark, sf):
    """ML1 with one column: the fold models' optimum is the same whoever finds it."""
    r = ml.cross_validate(prepared(spark, sf), "row_id", "y", ["price"], [], K, spec=LR)
    return r.oof.select("row_id", "fold", r6("proba").alias("proba"))


def _statistics_sql() -> str:
    hash_ = h_duckdb("row_id", f"ts{SEED}")
    ctes = [f"ts AS (SELECT row_id, y, fold, coalesce(seg, '__missing__') AS seg, coalesce(pri, '__missing__') AS pri, {hash_} AS hh FROM prepared)",
            f"m AS (SELECT unnest(range({K + 1})) AS i)",
            "pr AS (SELECT i, avg(y) AS prior FROM ts, m WHERE fold IS NOT NULL AND fold <> i GROUP BY i)"]
    used = "fold IS NOT NULL AND fold <> i"
    parts = []
    for c in ("seg", "pri"):
        w = f"(PARTITION BY i, {c} ORDER BY hh, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        t = f"(PARTITION BY i, {c})"
        parts.append(f"""SELECT row_id, '{c}' AS feature, CAST(i AS INTEGER) AS model,
  round((coalesce(sum(CASE WHEN {used} THEN y ELSE 0 END) OVER {w}, 0) + prior) / (coalesce(sum(CASE WHEN {used} THEN 1 ELSE 0 END) OVER {w}, 0) + 1.0), 6) AS enc_fit,
  round((sum(CASE WHEN {used} THEN y ELSE 0 END) OVER {t} + prior) / (sum(CASE WHEN {used} THEN 1 ELSE 0 END) OVER {t} + 1.0), 6) AS enc_apply
  FROM ts CROSS JOIN m JOIN pr USING (i)""")
    return with_base(*ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("ordered_target_statistics", _statistics_sql())
def q_ordered_target_statistics(spark, sf):
    """The encodings of the categorical columns for each of the k fold models and the full one."""
    s = ordered_statistics(prepared(spark, sf), "row_id", "y", CAT, K, seed=SEED)
    rows = s.select("row_id", F.posexplode(F.arrays_zip("enc_fit", "enc_apply")).alias("at", "e"))
    feature = F.get(F.array(*[F.lit(c) for c in CAT]), F.floor(F.col("at") / (K + 1)).cast("int"))
    return rows.select("row_id", feature.alias("feature"), (F.col("at") % (K + 1)).cast("int").alias("model"),
                       r6("e.enc_fit").alias("enc_fit"), r6("e.enc_apply").alias("enc_apply"))


@register("baseline_metrics")
def q_baseline_metrics(spark, sf):
    """ML4: features-off control = the raw columns only; per-fold metrics, mean (-1) and
    population std (-2)."""
    r = _cv(spark, sf)
    return r.fold_metrics.select("fold", *[r6(c).alias(c) for c in ml.METRICS])


@register("full_model_scores")
def q_full_model_scores(spark, sf):
    design, model = _full(spark, sf)
    return ml.predict(design, model).select("row_id", r6("proba").alias("proba"))


@register("holdout_metrics")
def q_holdout_metrics(spark, sf):
    h = ml.holdout_metrics(prepared(spark, sf), "row_id", "y", NUM, CAT, spec=LR)
    return h.select(*[r6(c).alias(c) for c in ml.METRICS])


@register("training_metrics_row")
def q_training_metrics_row(spark, sf):
    """ML5: the fold models and the full model share one design."""
    design, model = _full(spark, sf)
    r = ml.cross_validate(design, "row_id", "y", NUM, CAT, K, spec=LR)
    h = ml.binary_metrics(ml.predict(design, model, design.table.where("split = 'holdout'")), "proba", "label")
    return ml.training_record(r, h, design.table.where("split = 'dev'"), K, iteration=0, feature_set_id="|".join(sorted(NUM + CAT)))


SHAP_COLS = ["price", "bal", "price_n", "score"]


@register("shap_linear", with_base() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(avg(abs((1.0 / s) * ({c} - m))), 6) AS mean_abs_shap "
    f"FROM base, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM base) st" for c in SHAP_COLS))
def q_shap_linear(spark, sf):
    """SHAP1 for a linear score with coefficients 1/std (a standardised linear model):
    exact per-row contributions coef * (x - mean), averaged in absolute value."""
    b = base(spark, sf)
    st = b.agg(*[F.avg(c).alias(f"m_{c}") for c in SHAP_COLS],
               *[F.stddev_samp(c).alias(f"s_{c}") for c in SHAP_COLS]).first()  # 2 numbers per feature
    coefs = {c: 1.0 / st[f"s_{c}"] for c in SHAP_COLS}
    means = {c: st[f"m_{c}"] for c in SHAP_COLS}
    s = ml.linear_shap(b, coefs, means)
    return s.select("feature", r6("mean_abs_shap").alias("mean_abs_shap"))


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    imp = ml.permutation_importance(_cv(spark, sf), NUM + CAT, n_repeats=3)
    return imp.select("feature", r6("importance").alias("importance"))


def _set_aucs(df):
    """The AUCs of feature sets over one design of all the round's columns."""
    features = [*BASELINE, *CANDIDATES]
    cats = [c for c in features if c in CAT]
    design = ml.build_design(df.where("fold IS NOT NULL"), "row_id", "y", [c for c in features if c not in cats], cats, K)
    return lambda sets: ml.set_aucs(design, sets, LR)


@register("lift_screen")
def q_lift_screen(spark, sf):
    """SEL1: CV AUC of baseline + one candidate minus the baseline CV AUC."""
    df = selection_frame(spark, sf)
    return lift_screen(spark, _set_aucs(df), BASELINE, CANDIDATES).select("feature", r6("lift").alias("lift"))


@register("greedy_selection")
def q_greedy_selection(spark, sf):
    df = selection_frame(spark, sf)
    steps = forward_search(spark, _set_aucs(df), BASELINE, CANDIDATES)
    return steps.where("feature IS NOT NULL OR step = 0").select((F.col("step") - 1).alias("step"), "feature", r6("auc").alias("auc"))


@register("feature_selection_round")
def q_feature_selection_round(spark, sf):
    df = selection_frame(spark, sf)
    return selection_round(df, _set_aucs(df), BASELINE, CANDIDATES)


GBT = ml.ModelSpec(kind="gbt", trees=20, depth=4)


@register("shap_tree")
def q_shap_tree(spark, sf):
    """SHAP1 for the boosted-tree model: exact tree SHAP of every validation row under
    its own fold model, mean absolute value per input column."""
    return ml.tree_shap_importance(_cv(spark, sf, GBT)).select("feature", r6("mean_abs_shap").alias("mean_abs_shap"))
