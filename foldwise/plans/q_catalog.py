"""Queries: catalog records, gate, promotion and reports (SRC5-7, PRJ10, PRJ12, JOIN8-11,
WIN4, WIN6, SRT1-2, SET2, SET4, GATE1-3, REP1-3, FN5-6).

The records come from a run over the labelled orders: seven candidate features in three iterations go through the
real checks (out-of-fold values and their coverage, single-feature AUC, serving replay), each iteration's model is
cross-validated and scored on the holdout, and stability is the worst dev-vs-holdout PSI of its candidates. They
are written to and read back from the catalog tables in the shared folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import h_duckdb
from foldwise.functions.scalar import LEAK_AUC_THRESHOLD, classify_psi
from foldwise.operators import features as fx
from foldwise.operators import gate
from foldwise.operators import models as ml
from foldwise.operators import parity as par
from foldwise.operators.longform import melt
from foldwise.operators.selection import lift_accept_reject, step_lifts
from foldwise.operators.stability import psi_numeric
from foldwise.operators.validation import Candidate, candidate_values, validate
from foldwise.plans.inputs import K, prepared
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import CLASSIFY, auc_ctes, edges_cte, psi_sql, with_base
from foldwise.session import checkpoint_dir, materialize
from foldwise.sources.catalog import Catalog

RUN = "r1"
SEED = 7
SIZES = [37]
LR = ml.ModelSpec(kind="logistic")


def candidates(spark) -> list[Candidate]:
    """What three iterations propose: encodings, raw and crossed columns, a rank over the rows of the call (F8), a copy of
    the label and a column of nothing."""
    te = fx.GroupStat(name="te_seg", key="seg", value="y", uses_target=True, default=0.5)
    freq = fx.GroupStat(name="freq_pri", key="pri", kind="frequency")
    return [
        Candidate("te_seg", 0, "mean label by segment", "target_encoding", par.lookup_feature("te_seg"), te),
        Candidate("rank_price", 0, "rank of the price", "rank", par.rank_in_call("rank_price", "price"), column="rank_price"),
        Candidate("price_raw", 1, "the price itself", "raw", par.row_feature("price_raw", ["price"], lambda pdf: pdf["price"]), column="price"),
        Candidate("freq_pri", 1, "share of the priority", "frequency", par.lookup_feature("freq_pri"), freq),
        Candidate("leak_y", 2, "the label in disguise", "raw", par.row_feature("leak_y", ["leak_y"], lambda pdf: pdf["leak_y"]), column="leak_y"),
        Candidate("nothing", 2, "a column without values", "raw", par.row_feature("nothing", ["nothing"], lambda pdf: pdf["nothing"]), column="nothing"),
        Candidate("price_x_bal", 2, "price times balance", "interaction",
                  par.row_feature("price_x_bal", ["price", "bal"], lambda pdf: pdf["price"].astype(float) * pdf["bal"].astype(float)), fx.product("price_x_bal", "price", "bal"))]


FEATS = ["te_seg", "rank_price", "price_raw", "freq_pri", "leak_y", "nothing", "price_x_bal"]
ITERATION = dict(zip(FEATS, [0, 0, 1, 1, 2, 2, 2], strict=True))
UNTRIED = [("h_ratio", 3, "price by balance", "ratio"), ("h_age", 3, "days since the first order", "temporal")]


def _u(parts):
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ shared records
def run_inputs(spark, sf):
    """(values, serving rows, candidates) of the run."""
    p = par.with_pct_rank(prepared(spark, sf), "price", "rank_price").withColumns({"leak_y": F.col("y") * 2.0, "nothing": F.lit(None).cast("double")})
    cands = candidates(spark)
    return *candidate_values(p, cands, "row_id", K), cands


def feature_results(spark, sf, inputs=None):
    values, serving, cands = inputs or run_inputs(spark, sf)
    r = validate(values, serving, cands, "row_id", "y", sizes=SIZES, seed=SEED)
    r = r.select(F.lit(RUN).alias("run_id"), "feature_name", F.concat(F.lit("h_"), F.col("feature_name")).alias("hypothesis_id"), "pos", "iteration", "auc",
                 "pct_missing", "leak_flag", "coverage_ok", "n_mismatch", "parity_ok", "final_status")
    return materialize(r, "results")  # a row a candidate: whoever reads it twice runs the checks once


_TE = """SELECT p.row_id, CASE WHEN p.fold IS NOT NULL THEN coalesce(t1.m, 0.5) ELSE coalesce(t2.m, 0.5) END AS v
  FROM prepared p LEFT JOIN te1 t1 ON p.seg = t1.k AND p.fold = t1.fold LEFT JOIN te2 t2 ON p.seg = t2.k"""
_FREQ = """SELECT p.row_id, CASE WHEN p.fold IS NOT NULL THEN coalesce(f1.c / n1.n::DOUBLE, 0.0) ELSE coalesce(f2.c / (SELECT count(*) FROM prepared WHERE fold IS NOT NULL)::DOUBLE, 0.0) END AS v
  FROM prepared p LEFT JOIN fr1 f1 ON p.pri = f1.k AND p.fold = f1.fold LEFT JOIN fr0 n1 ON p.fold = n1.fold LEFT JOIN fr2 f2 ON p.pri = f2.k"""
_FOLDS = "(SELECT DISTINCT fold FROM prepared WHERE fold IS NOT NULL) f"
FR_CTES = [
    f"te1 AS (SELECT f.fold, p.seg AS k, avg(p.y::DOUBLE) AS m FROM prepared p, {_FOLDS} WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.seg IS NOT NULL GROUP BY 1, 2)",
    "te2 AS (SELECT seg AS k, avg(y::DOUBLE) AS m FROM prepared WHERE fold IS NOT NULL AND seg IS NOT NULL GROUP BY 1)",
    f"fr1 AS (SELECT f.fold, p.pri AS k, count(*) AS c FROM prepared p, {_FOLDS} WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.pri IS NOT NULL GROUP BY 1, 2)",
    f"fr0 AS (SELECT f.fold, count(*) AS n FROM prepared p, {_FOLDS} WHERE p.fold IS NOT NULL AND p.fold <> f.fold GROUP BY 1)",
    "fr2 AS (SELECT pri AS k, count(*) AS c FROM prepared WHERE fold IS NOT NULL AND pri IS NOT NULL GROUP BY 1)",
    "rk AS (SELECT row_id, (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0) / count(*) OVER () AS v FROM prepared)",
    "fv AS (" + _u([f"SELECT 'te_seg' AS feature, * FROM ({_TE})", "SELECT 'rank_price', row_id, v FROM rk", "SELECT 'price_raw', row_id, price::DOUBLE FROM prepared",
                    f"SELECT 'freq_pri', * FROM ({_FREQ})", "SELECT 'leak_y', row_id, y * 2.0 FROM prepared", "SELECT 'nothing', row_id, NULL::DOUBLE FROM prepared",
                    "SELECT 'price_x_bal', row_id, price::DOUBLE * bal::DOUBLE FROM prepared"]) + ")",
    "lv AS (SELECT fv.feature, fv.row_id, fv.v, p.y, p.fold, p.split FROM fv JOIN prepared p USING (row_id))",
    "lf AS (SELECT * FROM lv WHERE fold IS NOT NULL)",
    auc_ctes("a", "lf", "v", "y", ["feature"]),
    "fl AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i}, {ITERATION[f]})" for i, f in enumerate(FEATS)) + ") t(feature_name, pos, iteration))",
    "ms AS (SELECT feature AS feature_name, count(v) > 0 AND count(*) = count(DISTINCT row_id) AS coverage_ok, (count(*) - count(v)) / count(*)::DOUBLE AS pct_missing FROM lf GROUP BY 1)",
    f"""rp AS (SELECT row_id, price, (row_number() OVER (ORDER BY {h_duckdb('row_id', SEED)}, row_id) - 1) // {SIZES[0]} AS batch FROM prepared)""",
    """ro AS (SELECT row_id, (rank() OVER (PARTITION BY batch ORDER BY price) + (count(*) OVER (PARTITION BY batch, price) - 1) / 2.0)
                / count(*) OVER (PARTITION BY batch) AS onl FROM rp)""",
    "mm AS (SELECT count(*) FILTER (WHERE NOT abs(rk.v - onl) <= 1e-12 + 1e-9 * abs(onl)) AS n FROM ro JOIN rk USING (row_id))",
    f"""fr AS (SELECT '{RUN}' AS run_id, fl.feature_name, 'h_' || fl.feature_name AS hypothesis_id, fl.pos, CAST(fl.iteration AS INTEGER) AS iteration,
                CASE WHEN a.P > 0 AND a.N > 0 AND a.nd >= 2 THEN greatest(a.auc, 1 - a.auc) END AS auc, ms.pct_missing, ms.coverage_ok,
                CASE WHEN fl.feature_name = 'rank_price' THEN (SELECT n FROM mm) ELSE 0 END AS n_mismatch
         FROM fl LEFT JOIN a ON a.feature = fl.feature_name LEFT JOIN ms ON ms.feature_name = fl.feature_name)""",
    f"""frs AS (SELECT *, coalesce(auc >= {LEAK_AUC_THRESHOLD}, false) AS leak_flag, n_mismatch = 0 AS parity_ok,
                CASE WHEN NOT coverage_ok OR auc IS NULL THEN 'dynamic_failed' WHEN auc >= {LEAK_AUC_THRESHOLD} THEN 'leakage_rejected'
                     WHEN n_mismatch > 0 THEN 'serving_mismatch' ELSE 'validated' END AS final_status FROM fr)"""]


def new_catalog(spark):
    root = os.path.join(checkpoint_dir(spark), "catalog-" + uuid.uuid4().hex)
    return Catalog(spark, root)


def iterations(results):
    """The iterations of a run's records, in order (numbers of a catalog)."""
    return sorted(r["iteration"] for r in results.select("iteration").distinct().collect())


def record_run(cat, spark, cands):
    """The run's hypotheses (two of them not tried yet) and the specs of those that were."""
    tried = [(RUN, f"h_{c.name}", c.iteration, i, c.description, c.kind) for i, c in enumerate(cands)]
    rows = tried + [(RUN, h, it, len(tried) + i, d, k) for i, (h, it, d, k) in enumerate(UNTRIED)]
    cat.append("hypotheses", spark.createDataFrame(rows, "run_id string, hypothesis_id string, iteration int, pos int, description string, feature_type string"))
    specs = [(RUN, f"h_{c.name}", c.name, 0, ",".join(c.serving.required_columns)) for c in cands]
    cat.append("feature_specs", spark.createDataFrame(specs, "run_id string, hypothesis_id string, feature_name string, codegen_attempt int, required_columns string"))


def written_results(spark, sf, inputs=None):
    cat, inputs = new_catalog(spark), inputs or run_inputs(spark, sf)
    fr = feature_results(spark, sf, inputs)
    record_run(cat, spark, inputs[2])
    for i in iterations(fr):  # one append per iteration, as a run records them
        cat.append("validation_results", fr.where(F.col("iteration") == i))
    return cat


HYPOTHESES_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    [f"('h_{f}', {ITERATION[f]}, {i}, '{d}', '{k}')" for i, (f, d, k) in enumerate(zip(
        FEATS, ["mean label by segment", "rank of the price", "the price itself", "share of the priority", "the label in disguise", "a column without values", "price times balance"],
        ["target_encoding", "rank", "raw", "frequency", "raw", "raw", "interaction"], strict=True))] +
    [f"('{h}', {it}, {len(FEATS) + i}, '{d}', '{k}')" for i, (h, it, d, k) in enumerate(UNTRIED)]) + ") t(hypothesis_id, iteration, pos, description, feature_type)) h"


@register("catalog_append", with_base(*FR_CTES) + """
SELECT run_id, iteration, feature_name, final_status, round(auc, 6) AS auc FROM frs""")
def q_catalog_append(spark, sf):
    cat = written_results(spark, sf)
    return cat.read("validation_results").select("run_id", "iteration", "feature_name", "final_status",
                                                 r6("auc").alias("auc"))


@register("catalog_filter_status", with_base(*FR_CTES) + f"""
SELECT feature_name, round(auc, 6) AS auc FROM frs WHERE run_id = '{RUN}' AND final_status = 'validated'""")
def q_catalog_filter_status(spark, sf):
    cat = written_results(spark, sf)
    return cat.by_run("validation_results", RUN, "validated").select("feature_name", r6("auc").alias("auc"))


@register("status_histogram", with_base(*FR_CTES) + "\nSELECT final_status, count(*) AS n FROM frs GROUP BY 1")
def q_status_histogram(spark, sf):
    return gate.status_histogram(written_results(spark, sf).read("validation_results"))


@register("catalog_listing", with_base(*FR_CTES) + """
SELECT run_id, iteration, feature_name, row_number() OVER (PARTITION BY run_id ORDER BY iteration, feature_name) AS listing_rank FROM frs""")
def q_catalog_listing(spark, sf):
    r = written_results(spark, sf).read("validation_results")
    w = Window.partitionBy("run_id").orderBy("iteration", "feature_name")  # one run's records
    return r.select("run_id", "iteration", "feature_name", F.row_number().over(w).cast("bigint").alias("listing_rank"))


@register("gate_status", with_base(*FR_CTES) + "\nSELECT feature_name, final_status FROM frs")
def q_gate_status(spark, sf):
    return feature_results(spark, sf).select("feature_name", "final_status")


@register("hypothesis_status", with_base(*FR_CTES) + f"""
SELECT h.hypothesis_id, coalesce(frs.final_status, 'pending') AS status FROM {HYPOTHESES_SQL} LEFT JOIN frs USING (hypothesis_id)""")
def q_hypothesis_status(spark, sf):
    cat = written_results(spark, sf)
    return gate.with_pending(cat.read("hypotheses").select("hypothesis_id"), cat.read("validation_results"))


@register("report_hypotheses", with_base(*FR_CTES) + f"""
SELECT CAST(h.iteration AS INTEGER) AS iteration, h.description, h.feature_type, coalesce(frs.final_status, 'pending') AS status
FROM {HYPOTHESES_SQL} LEFT JOIN frs USING (hypothesis_id)""")
def q_report_hypotheses(spark, sf):
    """REP3: what was tried, and what became of it."""
    cat = written_results(spark, sf)
    h = gate.with_pending(cat.read("hypotheses"), cat.read("validation_results"))
    return h.select("iteration", "description", "feature_type", "status")


MERGE_SQL = with_base(*FR_CTES, f"""
recs AS (
  SELECT feature_name, 1 AS seq,
         CASE WHEN auc IS NULL THEN 'dynamic_failed' WHEN auc >= {LEAK_AUC_THRESHOLD} THEN 'leakage_rejected' ELSE 'validated' END AS final_status,
         auc, CAST(NULL AS BOOLEAN) AS parity_ok FROM frs
  UNION ALL
  SELECT feature_name, 2, CASE WHEN NOT parity_ok THEN 'serving_mismatch' END, CAST(NULL AS DOUBLE), parity_ok FROM frs)""") + """
SELECT feature_name, arg_max(final_status, seq) FILTER (WHERE final_status IS NOT NULL) AS final_status,
       round(arg_max(auc, seq) FILTER (WHERE auc IS NOT NULL), 6) AS auc,
       arg_max(parity_ok, seq) FILTER (WHERE parity_ok IS NOT NULL) AS parity_ok
FROM recs GROUP BY feature_name"""


@register("merge_validation_results", MERGE_SQL)
def q_merge_validation_results(spark, sf):
    fr = feature_results(spark, sf)
    first = fr.select("feature_name", F.lit(1).alias("seq"),
                      gate.gate_status(F.lit(True), F.col("auc"), F.lit(True)).alias("final_status"),
                      "auc", F.lit(None).cast("boolean").alias("parity_ok"))
    second = fr.select("feature_name", F.lit(2).alias("seq"),
                       F.when(~F.col("parity_ok"), F.lit("serving_mismatch")).alias("final_status"),
                       F.lit(None).cast("double").alias("auc"), "parity_ok")
    m = gate.merge_results(first.unionByName(second), "feature_name", "seq", ["final_status", "auc", "parity_ok"])
    return m.select("feature_name", "final_status", r6("auc").alias("auc"), "parity_ok")


@register("dedupe_specs", with_base(*FR_CTES) + """
SELECT DISTINCT hypothesis_id, codegen_attempt, feature_name FROM (
  SELECT hypothesis_id, 0 AS codegen_attempt, feature_name FROM frs
  UNION ALL SELECT hypothesis_id, 0, feature_name FROM frs WHERE final_status = 'validated'
  UNION ALL SELECT hypothesis_id, 1, feature_name FROM frs WHERE final_status <> 'validated')""")
def q_dedupe_specs(spark, sf):
    fr = feature_results(spark, sf)
    cur = fr.select("hypothesis_id", F.lit(0).alias("codegen_attempt"), "feature_name")
    approved = fr.where(F.col("final_status") == "validated").select("hypothesis_id", F.lit(0).alias("codegen_attempt"),
                                                                       "feature_name")
    retried = fr.where(F.col("final_status") != "validated").select("hypothesis_id", F.lit(1).alias("codegen_attempt"),
                                                                      "feature_name")
    return gate.dedupe(cur, approved, retried, keys=["hypothesis_id", "codegen_attempt"])


@register("lift_accept_reject", with_base(*FR_CTES) + """
SELECT feature_name, round(auc - 0.5, 6) AS lift, coalesce(auc - 0.5 >= 0.001, false) AS accepted FROM frs""")
def q_lift_accept_reject(spark, sf):
    fr = feature_results(spark, sf).select("feature_name", (F.col("auc") - 0.5).alias("lift"))
    return lift_accept_reject(fr).select("feature_name", r6("lift").alias("lift"), "accepted")


@register("fn_run_digest", with_base(*FR_CTES) + f"""
SELECT '{RUN}' AS run_id, CASE WHEN length(d) > 8000 THEN substr(d, 1, 7980) || chr(10) || '... (truncated)' ELSE d END AS digest FROM (
  SELECT string_agg('- [iter ' || h.iteration || '] ' || h.description || ' -> status=' || coalesce(final_status, 'pending')
    || CASE WHEN auc IS NOT NULL THEN ', single_feature_auc=' || printf('%.3f', auc) ELSE '' END
    || CASE WHEN leak_flag THEN ', leakage_review=reject' WHEN NOT leak_flag THEN ', leakage_review=approve' ELSE '' END, chr(10) ORDER BY h.iteration, h.pos) AS d
  FROM {HYPOTHESES_SQL} LEFT JOIN frs USING (hypothesis_id))""")
def q_fn_run_digest(spark, sf):
    cat = written_results(spark, sf)
    return gate.run_digest(cat.read("hypotheses"), cat.read("validation_results"))


# ------------------------------------------------------------------ training metrics
MET_CTES = [
    *FR_CTES,
    # the sign of a one-column model's coefficient is that of the covariance of its training rows
    f"""sg AS (SELECT feature, i, CASE WHEN covar_pop(y, v) < 0 THEN -1.0 ELSE 1.0 END AS s
               FROM (SELECT feature, y, v, fold, i FROM lv, (SELECT unnest(range({K + 1})) AS i) WHERE fold IS NOT NULL AND fold <> i) GROUP BY 1, 2)""",
    "bv AS (SELECT 'bal' AS feature, row_id, bal::DOUBLE AS v, y, fold, split FROM prepared)",
    f"""sb AS (SELECT feature, i, CASE WHEN covar_pop(y, v) < 0 THEN -1.0 ELSE 1.0 END AS s
               FROM (SELECT feature, y, v, fold, i FROM bv, (SELECT unnest(range({K + 1})) AS i) WHERE fold IS NOT NULL AND fold <> i) GROUP BY 1, 2)""",
    "ov AS (SELECT * FROM lv WHERE feature NOT IN ('nothing', 'leak_y') UNION ALL SELECT * FROM bv)",
    "os AS (SELECT * FROM sg UNION ALL SELECT * FROM sb)",
    f"""sc AS (SELECT feature, 'val' AS kind, i, y, v * s AS v FROM ov JOIN os USING (feature) WHERE i < {K} AND fold = i
               UNION ALL SELECT feature, 'train', i, y, v * s FROM ov JOIN os USING (feature) WHERE i < {K} AND fold IS NOT NULL AND fold <> i
               UNION ALL SELECT feature, 'holdout', i, y, v * s FROM ov JOIN os USING (feature) WHERE i = {K} AND split = 'holdout')""",
    auc_ctes("m", "sc", "v", "y", ["feature", "kind", "i"]),
    """one AS (SELECT feature, avg(auc) FILTER (WHERE kind = 'val') AS auc_mean, stddev_pop(auc) FILTER (WHERE kind = 'val') AS auc_std,
                avg(auc) FILTER (WHERE kind = 'train') AS train_auc_mean, max(auc) FILTER (WHERE kind = 'holdout') AS holdout_auc FROM m GROUP BY 1)""",
    """pick AS (SELECT run_id, iteration, arg_min(feature_name, pos) AS first_one, arg_max(feature_name, auc) AS best_one
                FROM frs WHERE final_status = 'validated' GROUP BY 1, 2)""",
    "lm AS (SELECT run_id, iteration, one.* EXCLUDE (feature) FROM pick JOIN one ON one.feature = CASE WHEN iteration = 1 THEN best_one ELSE first_one END)"]


def metrics_catalog(spark, sf):
    """Cross-validated metrics of every iteration's model (its first validated candidate alone), then a re-run of iteration 1
    with its best one; the features-off baseline (one raw column) goes to the run's metadata."""
    inputs = run_inputs(spark, sf)
    cat = written_results(spark, sf, inputs)
    fr = cat.read("validation_results").drop("seq")
    good = fr.where("final_status = 'validated'")
    picks = good.groupBy("iteration").agg(F.min_by("feature_name", "pos").alias("first"), F.max_by("feature_name", "auc").alias("best")).orderBy("iteration").collect()  # a row an iteration
    sets = [("bal", -1)] + [(r["first"], r["iteration"]) for r in picks] + [(r["best"], r["iteration"]) for r in picks if r["iteration"] == 1]
    used = list(dict.fromkeys(f for f, _ in sets))
    design = ml.build_design(inputs[0], "row_id", "y", used, [], K, extra=["split"])
    records = materialize(ml.set_records(design, [[f] for f, _ in sets], spec=LR), "records")
    row = lambda n: records.where(F.col("set") == n).drop("set")
    cat.upsert("run_metadata", row(0).select(F.lit(RUN).alias("run_id"), F.lit("orders").alias("dataset_name"), F.col("auc_mean").alias("baseline_auc")))
    for n, (_, iteration) in list(enumerate(sets))[1:]:
        cat.upsert("training_metrics", row(n).withColumns({"run_id": F.lit(RUN), "iteration": F.lit(iteration)}))
    return cat, fr, inputs[1]


@register("catalog_upsert", with_base(*MET_CTES) + "\nSELECT run_id, iteration, round(auc_mean, 6) AS auc_mean FROM lm")
def q_catalog_upsert(spark, sf):
    cat, *_ = metrics_catalog(spark, sf)
    return cat.latest("training_metrics").select("run_id", "iteration", r6("auc_mean").alias("auc_mean"))


@register("catalog_latest_metrics", with_base(*MET_CTES) + """
SELECT run_id, iteration, round(auc_mean, 6) AS auc_mean FROM lm
WHERE (run_id, iteration) IN (SELECT (run_id, max(iteration)) FROM lm GROUP BY run_id)""")
def q_catalog_latest_metrics(spark, sf):
    cat, *_ = metrics_catalog(spark, sf)
    lm = cat.latest("training_metrics")
    s = lm.groupBy("run_id").agg(F.max_by(F.struct("iteration", "auc_mean"), "iteration").alias("s"))
    return s.select("run_id", F.col("s.iteration").alias("iteration"), r6("s.auc_mean").alias("auc_mean"))


@register("catalog_best_metrics", with_base(*MET_CTES) + """
SELECT iteration, round(auc_mean, 6) AS auc_mean FROM lm ORDER BY auc_mean DESC NULLS LAST LIMIT 1""")
def q_catalog_best_metrics(spark, sf):
    cat, *_ = metrics_catalog(spark, sf)
    return cat.best("training_metrics", "auc_mean").select("iteration", r6("auc_mean").alias("auc_mean"))


@register("report_performance", with_base(*MET_CTES) + """
SELECT iteration, round(train_auc_mean, 6) AS train_auc, round(auc_mean, 6) AS cv_auc, round(auc_std, 6) AS cv_auc_std, round(holdout_auc, 6) AS holdout_auc FROM lm""")
def q_report_performance(spark, sf):
    """REP1: train, cross-validated and holdout AUC of each iteration's model."""
    cat, *_ = metrics_catalog(spark, sf)
    m = cat.latest("training_metrics")
    return m.select("iteration", r6("train_auc_mean").alias("train_auc"), r6("auc_mean").alias("cv_auc"), r6("auc_std").alias("cv_auc_std"), r6("holdout_auc").alias("holdout_auc"))


STREAK_CTES = [*MET_CTES,
               """s1 AS (SELECT run_id, iteration, auc_mean,
                          auc_mean > coalesce(max(auc_mean) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS improved,
                          max(auc_mean) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM lm)""",
               """s2 AS (SELECT *, max(CASE WHEN improved THEN iteration END) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp,
                          min(iteration) OVER (PARTITION BY run_id) AS first_it FROM s1)"""]


def streak(spark, sf):
    cat, fr, served = metrics_catalog(spark, sf)
    return cat, fr, served, gate.improvement_streak(cat.latest("training_metrics"))


@register("improvement_streak", with_base(*STREAK_CTES) + """
SELECT iteration, round(best_so_far, 6) AS best_so_far,
       CAST(CASE WHEN last_imp IS NULL THEN iteration - first_it + 1 ELSE iteration - last_imp END AS INTEGER) AS since_improvement
FROM s2""")
def q_improvement_streak(spark, sf):
    *_, s = streak(spark, sf)
    return s.select("iteration", r6("best_so_far").alias("best_so_far"), "since_improvement")


# ------------------------------------------------------------------ stability + promotion
PROMO_CTES = [*STREAK_CTES,
              """lp AS (SELECT p.row_id, p.split, s.feature, s.v FROM prepared p JOIN (
                   SELECT 'te_seg' AS feature, row_id, coalesce(t2.m, 0.5) AS v FROM prepared p LEFT JOIN te2 t2 ON p.seg = t2.k
                   UNION ALL SELECT 'freq_pri', row_id, coalesce(c, 0) / (SELECT count(*) FROM prepared WHERE fold IS NOT NULL)::DOUBLE FROM prepared p LEFT JOIN fr2 ON p.pri = fr2.k
                   UNION ALL SELECT feature, row_id, v FROM fv WHERE feature NOT IN ('te_seg', 'freq_pri') AND v IS NOT NULL) s USING (row_id))""",
              edges_cte("pe", "(SELECT * FROM lp WHERE split = 'dev')", "v", 10, ["feature"]),
              """pb AS (SELECT lp.feature, lp.split, len(list_filter(pe.inner_e, lambda e: e <= lp.v)) AS bin FROM lp JOIN pe USING (feature))""",
              """pg AS (SELECT pe.feature, g.bin,
                         (SELECT count(*) FROM pb WHERE pb.feature = pe.feature AND pb.bin = g.bin AND pb.split = 'dev') AS ref_n,
                         (SELECT count(*) FROM pb WHERE pb.feature = pe.feature AND pb.bin = g.bin AND pb.split = 'holdout') AS cur_n
                        FROM pe, LATERAL (SELECT unnest(range(0, CAST(pe.n_bins AS BIGINT))) AS bin) g)""",
              f"fpsi AS ({psi_sql('pg', ['feature'])})",
              f"""st AS (SELECT frs.run_id, frs.iteration, {CLASSIFY.format(v='coalesce(max(fpsi.psi), 0.0)')} AS flag
                        FROM frs LEFT JOIN fpsi ON fpsi.feature = frs.feature_name GROUP BY 1, 2)""",
              """sel AS (SELECT run_id, iteration, CASE WHEN iteration = 1 THEN best_one ELSE first_one END AS feature_name FROM pick)""",
              """promo AS (SELECT frs.feature_name, frs.run_id, frs.iteration, s2.auc_mean FROM frs
                          JOIN s2 USING (run_id, iteration) JOIN st USING (run_id, iteration) JOIN sel USING (run_id, iteration, feature_name)
                          WHERE s2.improved AND st.flag <> 'unstable' AND frs.final_status = 'validated')"""]


def promoted(spark, sf):
    """Stability compares the served values (of the full fit) of dev and holdout rows."""
    cat, fr, served, s = streak(spark, sf)
    long = melt(served.select("row_id", "split", *FEATS), ["row_id", "split"], FEATS)
    fpsi = psi_numeric(long, "value", "row_id", F.col("split") == "dev", F.col("split") == "holdout", by=["feature"])
    st = (fr.join(fpsi.withColumnRenamed("feature", "feature_name"), "feature_name", "left")
          .groupBy("run_id", "iteration")
          .agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("csi"),
               F.collect_list(F.struct("feature_name", F.col("psi").alias("csi"))).alias("features"))
          .withColumn("overall_stability_flag", classify_psi("csi")))
    cat.upsert("stability_reports", st)
    pick = F.when(F.col("iteration") == 1, F.max_by("feature_name", "auc")).otherwise(F.min_by("feature_name", "pos"))
    sel = fr.where("final_status = 'validated'").groupBy("run_id", "iteration").agg(pick.alias("feature_name"))
    cand = gate.promotion_candidates(fr, s, cat.latest("stability_reports"), sel)
    for i in iterations(fr):  # promotion happens iteration by iteration; repeats are skipped
        cat.promote(cand.where(F.col("iteration") <= i).select("feature_name", "run_id", "iteration", "hypothesis_id",
                                                                "final_status", "auc_mean"))
    return cat


@register("promote_features", with_base(*PROMO_CTES) + """
SELECT feature_name, run_id, iteration, round(auc_mean, 6) AS auc_mean FROM promo""")
def q_promote_features(spark, sf):
    cat = promoted(spark, sf)
    return cat.read("promoted_features").select("feature_name", "run_id", "iteration", r6("auc_mean").alias("auc_mean"))


@register("promoted_detail", with_base(*PROMO_CTES) + """
SELECT promo.feature_name, frs.hypothesis_id, round(fpsi.psi, 6) AS csi
FROM promo JOIN frs USING (run_id, iteration, feature_name) LEFT JOIN fpsi ON fpsi.feature = promo.feature_name""")
def q_promoted_detail(spark, sf):
    cat = promoted(spark, sf)
    pr = cat.read("promoted_features")
    st = cat.latest("stability_reports").select("run_id", "iteration", F.explode("features").alias("f"))
    st = st.select("run_id", "iteration", F.col("f.feature_name").alias("feature_name"), F.col("f.csi").alias("csi"))
    return (pr.join(st, ["run_id", "iteration", "feature_name"], "left")
            .select("feature_name", "hypothesis_id", r6("csi").alias("csi")))


@register("report_summary", with_base(*PROMO_CTES) + f"""
SELECT (SELECT round(auc_mean, 6) FROM one WHERE feature = 'bal') AS baseline_auc, (SELECT round(max(auc_mean), 6) FROM lm) AS best_auc,
       (SELECT count(*) FROM {HYPOTHESES_SQL}) AS n_hypotheses,
       (SELECT count(*) FROM frs WHERE final_status = 'validated') AS n_validated,
       (SELECT count(*) FROM promo) AS n_promoted""")
def q_report_summary(spark, sf):
    cat = promoted(spark, sf)
    best = cat.latest("training_metrics").agg(r6(F.max("auc_mean")).alias("best_auc"))
    base_ = cat.latest("run_metadata").select(r6("baseline_auc").alias("baseline_auc"))
    n = lambda table, name, of=F.lit(True): cat.read(table).agg(F.count_if(of).alias(name))
    return (base_.crossJoin(best).crossJoin(n("hypotheses", "n_hypotheses")).crossJoin(n("validation_results", "n_validated", F.col("final_status") == "validated"))
            .crossJoin(n("promoted_features", "n_promoted")))  # 1-row frames


@register("selection_step_lift", with_base(*FR_CTES) + """
SELECT iteration, CAST(step AS INTEGER) AS step, feature_name AS feature, round(auc, 6) AS auc,
       round(auc - coalesce(lag(auc) OVER (PARTITION BY iteration ORDER BY step), 0.5), 6) AS lift
FROM (SELECT iteration, feature_name, auc, row_number() OVER (PARTITION BY iteration ORDER BY auc DESC, feature_name) - 1 AS step
      FROM frs WHERE auc IS NOT NULL)""")
def q_selection_step_lift(spark, sf):
    fr = feature_results(spark, sf).where(F.col("auc").isNotNull())
    trace = fr.groupBy("iteration").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("auc")).alias("k"), F.col("feature_name").alias("feature"),
                                             F.col("auc").alias("auc")))).alias("t"))
    trace = trace.select("iteration", F.lit(0.5).alias("baseline_auc"),
                         F.transform("t", lambda s: F.struct(s["feature"].alias("feature"), s["auc"].alias("auc")))
                         .alias("auc_trace"))
    s = step_lifts(trace)
    return s.select("iteration", F.col("step").cast("int").alias("step"), "feature", r6("auc").alias("auc"),
                    r6("lift").alias("lift"))
