"""Queries: splits, folds and out-of-fold features (SPL*, OOF*, F*, UDF1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.scalar import LEAK_AUC_THRESHOLD
from foldwise.operators import features as fx
from foldwise.operators.scoring import single_feature_auc
from foldwise.operators.splits import fold_audit, holdout_temporal
from foldwise.plans.inputs import HOLDOUT_FRACTION, K, base, ev, prepared
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import auc_ctes, with_base, with_ev


def target_encoding_seg():
    return fx.GroupStat(name="te", key="seg", value="y", uses_target=True, default=0.5)


# --------------------------------------------------------------------------- flagship
# Out-of-fold target encoding of the customer segment, its single-feature AUC and the
# leak flag: join + split + folds + fold-subtraction aggregate + histogram AUC.

FLAGSHIP_SQL = with_base(
    """tr AS (
  SELECT f.fold, p.seg, avg(CAST(p.y AS DOUBLE)) AS m
  FROM prepared p, (SELECT DISTINCT fold FROM prepared WHERE fold IS NOT NULL) f
  WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.seg IS NOT NULL
  GROUP BY f.fold, p.seg)""",
    """te AS (
  SELECT p.row_id, p.y, p.seg, p.fold, coalesce(tr.m, 0.5) AS te
  FROM prepared p LEFT JOIN tr ON p.seg = tr.seg AND p.fold = tr.fold
  WHERE p.fold IS NOT NULL)""",
    auc_ctes("a", "te", "te", "y"),
) + f"""
SELECT te.seg, te.fold, count(*) AS n_val, round(max(te.te), 6) AS te,
       round(CASE WHEN max(a.P) > 0 AND max(a.N) > 0 AND max(a.nd) >= 2 THEN greatest(max(a.auc), 1 - max(a.auc)) END, 6) AS single_auc,
       coalesce(CASE WHEN max(a.P) > 0 AND max(a.N) > 0 AND max(a.nd) >= 2 THEN greatest(max(a.auc), 1 - max(a.auc)) END >= {LEAK_AUC_THRESHOLD}, false) AS leak_flag
FROM te CROSS JOIN a
GROUP BY te.seg, te.fold
"""


@register("flagship_oof_target_encoding", FLAGSHIP_SQL)
def flagship(spark, sf):
    p = prepared(spark, sf)
    te = target_encoding_seg().oof(p, k=K)
    auc = single_feature_auc(te.where(F.col("fold").isNotNull()), ["te"], "y", "row_id")
    per = (te.where(F.col("fold").isNotNull()).groupBy("seg", "fold")
           .agg(F.count(F.lit(1)).alias("n_val"), r6(F.max("te")).alias("te")))
    a = auc.select(r6("auc").alias("single_auc"), F.col("flag").alias("leak_flag"))
    return per.crossJoin(a)  # right side: one row


# --------------------------------------------------------------------------- target
@register("binarize_target", """
SELECT l_linestatus,
       CAST(CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN 0 ELSE 1 END AS INTEGER) AS y,
       count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def q_binarize_target(spark, sf):
    from foldwise.operators.target import binarize_target
    from foldwise.sources.tables import table
    li = table(spark, sf, "lineitem")
    return (li.withColumn("y", binarize_target(li, "l_linestatus"))
            .groupBy("l_linestatus", "y").agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------- splits
@register("holdout_temporal", with_base("""
tr AS (SELECT *, row_number() OVER (ORDER BY t, row_id) AS r, count(*) OVER () AS n FROM base)""") + f"""
SELECT CASE WHEN r <= round_even(n * (1 - {HOLDOUT_FRACTION}::DOUBLE), 0) THEN 'dev' ELSE 'holdout' END AS split,
       count(*) AS n, min(t) AS min_t, max(t) AS max_t
FROM tr GROUP BY 1""")
def q_holdout_temporal(spark, sf):
    s = holdout_temporal(base(spark, sf), "t", "row_id", HOLDOUT_FRACTION)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("min_t"),
                                  F.max("t").alias("max_t"))


@register("holdout_stratified", with_base() + """
SELECT split, y, count(*) AS n FROM prepared GROUP BY 1, 2""")
def q_holdout_stratified(spark, sf):
    return prepared(spark, sf).groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_folds", with_base() + """
SELECT fold, y, count(*) AS n FROM prepared WHERE fold IS NOT NULL GROUP BY 1, 2""")
def q_stratified_folds(spark, sf):
    p = prepared(spark, sf).where(F.col("fold").isNotNull())
    return p.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


@register("fold_audit", with_base("""
sizes AS (SELECT y, fold, count(*) AS c FROM prepared WHERE fold IS NOT NULL GROUP BY 1, 2)""") + f"""
SELECT (SELECT count(*) FROM prepared WHERE fold IS NOT NULL) AS n_rows,
       (SELECT count(*) FROM prepared WHERE fold BETWEEN 0 AND {K - 1}) AS n_assigned_once,
       (SELECT CAST(max(g) AS BIGINT) FROM (SELECT max(c) - min(c) AS g FROM sizes GROUP BY y)) AS max_class_gap""")
def q_fold_audit(spark, sf):
    return fold_audit(prepared(spark, sf), "row_id", "y", K)


# --------------------------------------------------------------------------- OOF features
_FOLDS = "(SELECT DISTINCT fold FROM prepared WHERE fold IS NOT NULL) f"


def _oof_mean_sql(key: str, value: str, default_sql: str, name: str = "value") -> str:
    return with_base(f"""
tr AS (SELECT f.fold, p.{key} AS k, avg(CAST(p.{value} AS DOUBLE)) AS m FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.{key} IS NOT NULL GROUP BY 1, 2)""", f"""
gl AS (SELECT f.fold, avg(CAST(p.{value} AS DOUBLE)) AS g FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold GROUP BY 1)""") + f"""
SELECT p.row_id, round(CASE WHEN p.fold IS NOT NULL THEN coalesce(tr.m, {default_sql}) END, 6) AS {name}
FROM prepared p LEFT JOIN tr ON p.{key} = tr.k AND p.fold = tr.fold LEFT JOIN gl ON p.fold = gl.fold"""


@register("oof_group_mean", _oof_mean_sql("seg", "price", "gl.g"))
def q_oof_group_mean(spark, sf):
    f = fx.GroupStat(name="value", key="seg", value="price", default="global")
    return f.oof(prepared(spark, sf), k=K).select("row_id", r6("value").alias("value"))


@register("oof_target_encoding", _oof_mean_sql("seg", "y", "0.5"))
def q_oof_target_encoding(spark, sf):
    f = fx.GroupStat(name="value", key="seg", value="y", uses_target=True, default=0.5)
    return f.oof(prepared(spark, sf), k=K).select("row_id", r6("value").alias("value"))


FREQ_SQL = with_base(f"""
tr AS (SELECT f.fold, p.pri AS k, count(*) AS c FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.pri IS NOT NULL GROUP BY 1, 2)""", f"""
nt AS (SELECT f.fold, count(*) AS n FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold GROUP BY 1)""") + """
SELECT p.row_id, round(CASE WHEN p.fold IS NOT NULL THEN coalesce(tr.c / nt.n::DOUBLE, 0.0) END, 6) AS value
FROM prepared p LEFT JOIN tr ON p.pri = tr.k AND p.fold = tr.fold LEFT JOIN nt ON p.fold = nt.fold"""


@register("oof_frequency_encoding", FREQ_SQL)
def q_oof_frequency_encoding(spark, sf):
    f = fx.GroupStat(name="value", key="pri", kind="frequency")
    return f.oof(prepared(spark, sf), k=K).select("row_id", r6("value").alias("value"))


@register("full_fit_params", with_base() + """
SELECT seg, round(avg(price), 6) AS value FROM prepared WHERE split = 'dev' AND seg IS NOT NULL GROUP BY seg
UNION ALL
SELECT NULL AS seg, round(avg(price), 6) AS value FROM prepared WHERE split = 'dev'""")
def q_full_fit_params(spark, sf):
    f = fx.GroupStat(name="gm_price_seg", key="seg", value="price", default="global")
    params = fx.full_fit(f, prepared(spark, sf), "row_id")
    return params.select(F.col("key").alias("seg"), r6("value").alias("value"))


@register("transform_holdout", with_base("""
pr AS (SELECT seg, avg(price) AS m FROM prepared WHERE split = 'dev' AND seg IS NOT NULL GROUP BY seg)""", """
gl AS (SELECT avg(price) AS g FROM prepared WHERE split = 'dev')""") + """
SELECT p.row_id, round(coalesce(pr.m, gl.g), 6) AS value
FROM prepared p LEFT JOIN pr ON p.seg = pr.seg CROSS JOIN gl WHERE p.split = 'holdout'""")
def q_transform_holdout(spark, sf):
    p = prepared(spark, sf)
    f = fx.GroupStat(name="value", key="seg", value="price", default="global")
    params = fx.full_fit(f, p, "row_id")
    out = fx.transform_new(f, p.where(F.col("split") == "holdout"), params, "row_id")
    return out.select("row_id", r6("value").alias("value"))


class GroupMedian(fx.Feature):
    """A fit that folds can't add up: the exact median price of the training rows of each segment."""

    name, required_columns = "value", ("seg", "price")

    def fit(self, train):
        return train.groupBy("seg").agg(F.median("price").alias("m"))

    def transform(self, rows, params):
        known = params.where("seg IS NOT NULL").select(F.col("seg").alias("k"), "m")
        return rows.join(known, rows["seg"] == known["k"], "left").withColumn("value", F.col("m")).drop("k", "m")


@register("feature_contract", with_base(f"""
tr AS (SELECT f.fold, p.seg AS k, median(p.price) AS m FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.seg IS NOT NULL GROUP BY 1, 2)""") + """
SELECT p.row_id, round(CASE WHEN p.fold IS NOT NULL THEN tr.m END, 6) AS value
FROM prepared p LEFT JOIN tr ON p.seg = tr.k AND p.fold = tr.fold""")
def q_feature_contract(spark, sf):
    """The generic contract path: validate, then k filtered fits and transforms in one union plan."""
    p, f = prepared(spark, sf), GroupMedian()
    fx.validate_feature(f, p, target_col="y")
    return fx.compute_oof(f, p, "row_id", K).select("row_id", r6("value").alias("value"))


ASSEMBLE_SQL = with_base(f"""
tr AS (SELECT f.fold, p.seg AS k, avg(CAST(p.y AS DOUBLE)) AS m FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.seg IS NOT NULL GROUP BY 1, 2)""", f"""
fr AS (SELECT f.fold, p.pri AS k, count(*) AS c FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.pri IS NOT NULL GROUP BY 1, 2)""", f"""
nt AS (SELECT f.fold, count(*) AS n FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold GROUP BY 1)""") + """
SELECT p.row_id, p.y, p.fold,
       round(CASE WHEN p.fold IS NOT NULL THEN coalesce(tr.m, 0.5) END, 6) AS te_seg,
       round(CASE WHEN p.fold IS NOT NULL THEN coalesce(fr.c / nt.n::DOUBLE, 0.0) END, 6) AS freq_pri,
       round(CASE WHEN p.bal = 0 THEN NULL ELSE p.price / p.bal END, 6) AS ratio_price_bal
FROM prepared p LEFT JOIN tr ON p.seg = tr.k AND p.fold = tr.fold
     LEFT JOIN fr ON p.pri = fr.k AND p.fold = fr.fold LEFT JOIN nt ON p.fold = nt.fold"""


def assembled_rows(p):
    """Every column of the prepared rows and the run's features."""
    feats = [fx.GroupStat(name="te_seg", key="seg", value="y", uses_target=True, default=0.5),
             fx.GroupStat(name="freq_pri", key="pri", kind="frequency")]
    return fx.assemble(fx.ratio("ratio_price_bal", "price", "bal").transform(p), "row_id", feats, K)


def assembled(spark, sf):
    return assembled_rows(prepared(spark, sf)).select("row_id", "y", "fold", "te_seg", "freq_pri", "ratio_price_bal")


@register("assemble_feature_frame", ASSEMBLE_SQL)
def q_assemble_feature_frame(spark, sf):
    a = assembled(spark, sf)
    return a.select("row_id", "y", "fold", r6("te_seg").alias("te_seg"), r6("freq_pri").alias("freq_pri"),
                    r6("ratio_price_bal").alias("ratio_price_bal"))


@register("oof_coverage", with_base("""
tr AS (SELECT f.fold, p.seg AS k, avg(p.price) AS m FROM prepared p, (SELECT DISTINCT fold FROM prepared WHERE fold IS NOT NULL) f
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold GROUP BY 1, 2)""", """
tg AS (SELECT f.fold, avg(p.price) AS g FROM prepared p, (SELECT DISTINCT fold FROM prepared WHERE fold IS NOT NULL) f
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold GROUP BY 1)""", """
v AS (SELECT p.row_id, p.fold, coalesce(tr.m, tg.g) AS value FROM prepared p LEFT JOIN tr ON p.fold = tr.fold AND p.seg = tr.k LEFT JOIN tg ON p.fold = tg.fold)""") + """
SELECT count(*) AS n_rows, count(DISTINCT row_id) AS n_ids, count(value) FILTER (WHERE fold IS NOT NULL) AS n_dev_valued,
       count(value) FILTER (WHERE fold IS NULL) AS n_holdout_valued FROM v""")
def q_oof_coverage(spark, sf):
    p = prepared(spark, sf)
    f = fx.GroupStat(name="value", key="seg", value="price", default="global")
    return fx.oof_coverage(fx.compute_oof(f, p, "row_id", K), p, "row_id", "value")


@register("feature_ratio", with_base() + """
SELECT row_id, round(CASE WHEN bal = 0 THEN NULL ELSE price / bal END, 6) AS value FROM base""")
def q_feature_ratio(spark, sf):
    f = fx.ratio("value", "price", "bal")
    return f.transform(base(spark, sf)).select("row_id", r6("value").alias("value"))


@register("feature_interaction", with_base(f"""
px AS (SELECT *, coalesce(seg, '__missing__') || '|' || coalesce(pri, '__missing__') AS cross_seg_pri FROM prepared)""", f"""
tr AS (SELECT f.fold, p.cross_seg_pri AS k, avg(CAST(p.y AS DOUBLE)) AS m
       FROM px p, (SELECT DISTINCT fold FROM prepared WHERE fold IS NOT NULL) f
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold GROUP BY 1, 2)""") + """
SELECT p.row_id, p.cross_seg_pri, round(p.price * p.bal, 4) AS price_x_bal,
       round(CASE WHEN p.fold IS NOT NULL THEN coalesce(tr.m, 0.5) END, 6) AS te_cross
FROM px p LEFT JOIN tr ON p.cross_seg_pri = tr.k AND p.fold = tr.fold""")
def q_feature_interaction(spark, sf):
    p = prepared(spark, sf)
    p = fx.cross("cross_seg_pri", "seg", "pri").transform(p)
    p = fx.product("price_x_bal", "price", "bal").transform(p)
    te = fx.GroupStat(name="te_cross", key="cross_seg_pri", value="y", uses_target=True, default=0.5).oof(p, k=K)
    return te.select("row_id", "cross_seg_pri", F.round("price_x_bal", 4).alias("price_x_bal"),
                     r6("te_cross").alias("te_cross"))


@register("feature_temporal", with_base(f"""
mins AS (SELECT fold, min(t) AS m FROM prepared WHERE fold IS NOT NULL GROUP BY fold)""", """
other AS (SELECT a.fold, min(b.m) AS t0 FROM mins a, mins b WHERE a.fold <> b.fold GROUP BY a.fold)""") + """
SELECT p.row_id, CAST(dayofweek(p.t) + 1 AS INTEGER) AS dow, CAST(month(p.t) AS INTEGER) AS month,
       round((epoch_us(p.t) - epoch_us(o.t0)) / 86400e6, 6) AS days_since_start
FROM prepared p JOIN other o ON p.fold = o.fold""")
def q_feature_temporal(spark, sf):
    p = prepared(spark, sf)
    d = fx.DaysSinceStart(name="days_since_start", time_col="t").oof(p)
    return (d.where(F.col("fold").isNotNull())
            .select("row_id", F.dayofweek("t").alias("dow"), F.month("t").alias("month"),
                    r6("days_since_start").alias("days_since_start")))


@register("feature_text", """
SELECT doc_id, substr(text, 1, 1) AS first_char, CAST(length(text) AS BIGINT) AS n_chars_text,
       CAST(len(string_split(text, ' ')) AS BIGINT) AS n_tokens,
       CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_newlines
FROM documents""")
def q_feature_text(spark, sf):
    from foldwise.sources.tables import table
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.substring("text", 1, 1).alias("first_char"),
                    F.length("text").cast("bigint").alias("n_chars_text"),
                    F.size(F.split("text", " ")).cast("bigint").alias("n_tokens"),
                    (F.length("text") - F.length(F.regexp_replace("text", "\n", ""))).cast("bigint")
                    .alias("n_newlines"))


LEAK_SQL = with_base("""
p0 AS (SELECT row_id AS k, avg(CAST(y AS DOUBLE)) AS m FROM prepared WHERE fold IS NOT NULL AND fold <> 0 GROUP BY row_id)""", """
lk AS (SELECT p.row_id, p.y, coalesce(p0.m, 0.5) AS v FROM prepared p LEFT JOIN p0 ON p.row_id = p0.k WHERE p.fold IS NOT NULL)""",
                     auc_ctes("a", "lk", "v", "y")) + f"""
SELECT round(CASE WHEN nd >= 2 AND P > 0 AND N > 0 THEN greatest(auc, 1 - auc) END, 6) AS auc_leaky,
       coalesce(CASE WHEN nd >= 2 AND P > 0 AND N > 0 THEN greatest(auc, 1 - auc) END >= {LEAK_AUC_THRESHOLD}, false) AS flag_leaky,
       CAST(NULL AS DOUBLE) AS auc_proper
FROM a"""


@register("leak_memoised_encoding", LEAK_SQL)
def q_leak_memoised_encoding(spark, sf):
    """F10 negative control: with the row id itself as key, reusing fold 0's params
    leaks the label into folds 1..4 and trips the single-feature AUC flag; the proper
    out-of-fold encoding never sees a row's own key and is constant (AUC null)."""
    p = prepared(spark, sf)
    leaky = fx.memoised_encoding(p, "row_id", "y", name="te_leaky")
    proper = fx.GroupStat(name="te_proper", key="row_id", value="y", uses_target=True, default=0.5).oof(leaky, k=K)
    dev = proper.where(F.col("fold").isNotNull())
    a = single_feature_auc(dev, ["te_leaky", "te_proper"], "y", "row_id")
    row = a.groupBy().agg(
        F.max(F.when(F.col("feature") == "te_leaky", F.col("auc"))).alias("auc_leaky"),
        F.max(F.when(F.col("feature") == "te_leaky", F.col("flag"))).alias("flag_leaky"),
        F.max(F.when(F.col("feature") == "te_proper", F.col("auc"))).alias("auc_proper"))
    return row.select(r6("auc_leaky").alias("auc_leaky"), "flag_leaky", r6("auc_proper").alias("auc_proper"))


SMOOTH_M = 10.0


@register("oof_target_encoding_smoothed", with_base(f"""
tr AS (SELECT f.fold, p.seg AS k, sum(CAST(p.y AS DOUBLE)) AS sy, count(*) AS n FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.seg IS NOT NULL GROUP BY 1, 2)""", f"""
gl AS (SELECT f.fold, avg(CAST(p.y AS DOUBLE)) AS prior FROM prepared p, {_FOLDS}
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold GROUP BY 1)""") + f"""
SELECT p.row_id, round(CASE WHEN p.fold IS NOT NULL THEN
         coalesce((tr.sy + {SMOOTH_M} * gl.prior) / (tr.n + {SMOOTH_M}), gl.prior) END, 6) AS value
FROM prepared p LEFT JOIN tr ON p.seg = tr.k AND p.fold = tr.fold LEFT JOIN gl ON p.fold = gl.fold""")
def q_oof_target_encoding_smoothed(spark, sf):
    """UDF4: the fit's last step in pandas over pre-aggregated (key, fold) rows."""
    f = fx.smoothed_target_encoding("value", "seg", "y", SMOOTH_M)
    return f.oof(prepared(spark, sf), k=K).select("row_id", r6("value").alias("value"))
