"""The steps that many queries share: what they read, shuffle and repeat, and that their results stay exact."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import logit, models as ml, parity as par, rank, treeshap
from foldwise.operators.encoding import ordered_statistics
from foldwise.plans import q_catalog, q_features, q_models
from tests.conftest import SF_SMALL


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_results_of_the_checks_are_written_once(spark):
    """merge_validation_results reads them twice, dedupe_specs three times."""
    files = q_catalog.feature_results(spark, SF_SMALL).inputFiles()
    assert files and all("/results-" in f for f in files)


def test_values_and_serving_rows_are_one_table(spark):
    values, serving, cands = q_catalog.run_inputs(spark, SF_SMALL)
    assert set(values.inputFiles()) == set(serving.inputFiles())
    v, s = (d.select("row_id", "fold", "te_seg").toPandas().set_index("row_id").sort_index() for d in (values, serving))
    held = v["fold"].isna()
    assert (v.loc[held, "te_seg"] == s.loc[held, "te_seg"]).all() and (v.loc[~held, "te_seg"] != s.loc[~held, "te_seg"]).any()


def test_replay_of_a_frame_against_itself_joins_no_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, float(i)) for i in range(200)], "row_id long, x double, r double")
    df = df.withColumn("same", F.col("x"))
    features = [par.row_feature("same", ["x"], lambda pdf: pdf["x"]), par.rank_in_call("r", "x")]
    r = par.replay_all(df, features, df, "row_id", sizes=[7])
    assert optimized(r).count("Join") == 1  # the bucket offsets of the order
    got = {x["feature"]: x for x in r.collect()}
    assert got["same"]["n_checked"] == 200 and got["same"]["n_mismatch"] == 0 and got["r"]["n_mismatch"] > 100
    other = par.replay_all(df, features, df.select("*"), "row_id", sizes=[7]).collect()
    assert {x["feature"]: x for x in other} == got
    assert par.replay_all(df.where("row_id < 0"), features[:1], df, "row_id", sizes=[7]).collect() == []


def test_statistics_keep_columns_in_one_shuffle(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3, "ab"[i % 2], None if i % 7 else "z", float(i)) for i in range(300)], "row_id long, y int, fold int, c string, d string, x double")
    got = ordered_statistics(df, "row_id", "y", ["c", "d"], 3, keep=[F.col("x")])
    assert "Join" in optimized(got) and got._jdf.queryExecution().executedPlan().toString().count("REPARTITION") == 1
    rows = got.toPandas()
    assert len(rows) == 300 and (rows["x"] == rows["row_id"]).all() and rows["enc_fit"].map(len).eq(8).all()


def test_selection_frame_splits_the_rows_once(spark, monkeypatch):
    calls, real = [], q_models.prepared
    for module in (q_models, q_features):
        monkeypatch.setattr(module, "prepared", lambda *a: calls.append(1) or real(*a))
    frame = q_models.selection_frame(spark, SF_SMALL)
    assert len(calls) == 1 and {"te_seg", "freq_pri", "ratio_price_bal", "price", "seg", "fold", "score"} <= set(frame.columns)


def test_one_exponential_gives_both():
    m = np.array([-800.0, -30.0, -1.0, 0.0, 1.0, 30.0, 800.0])
    p, cost = logit.sigmoid_and_cost(m)
    assert p == pytest.approx(logit.sigmoid(m), abs=1e-300, rel=1e-14) and cost == pytest.approx(np.logaddexp(0, m), abs=1e-300, rel=1e-14)


def test_start_of_the_descent_changes_scans_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 2))
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-3 * x[:, 0] + x[:, 1] - 1))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(4000), "y": y, "fold": np.arange(4000) % 3, "a": x[:, 0], "b": x[:, 1]}))
    d = ml.build_design(df, "row_id", "y", ["a", "b"], [], 3)
    sets = [(i, ["a", "b"]) for i in range(4)]
    whole, scans = logit.fit_many(d.table, d.columns, sets, 0.01)
    monkeypatch.setattr(logit, "START_ROWS", 400)
    monkeypatch.setattr(logit, "START_SHARE", 2)
    near, fewer = logit.fit_many(d.table, d.columns, sets, 0.01)
    assert fewer < scans
    for m, n in zip(whole, near, strict=True):
        assert n.coef == pytest.approx(m.coef, abs=1e-9) and n.intercept == pytest.approx(m.intercept, abs=1e-9)


def test_quantiles_of_many_rows_use_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(rank, "QUANTILE_ROWS", 50)
    counts, real = [], rank.bucket_offsets
    monkeypatch.setattr(rank, "bucket_offsets", lambda c, by: counts.append(c.count()) or real(c, by))
    x = np.concatenate([np.random.default_rng(3).normal(size=4000), np.zeros(1000)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(5000), "x": x}))
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = rank.exact_quantiles(df, "x", probs, "id").orderBy("q_index").toPandas()["q"]
    assert got.to_numpy() == pytest.approx(np.quantile(x, probs), abs=1e-12) and counts[0] > 50


def test_trees_are_worked_out_once_a_way(monkeypatch):
    rng, n = np.random.default_rng(6), 63
    left = np.array([2 * i + 1 if i < 31 else -1 for i in range(n)])
    cover = np.zeros(n)
    cover[0] = 1000
    for i in range(31):
        share = rng.uniform(0.1, 0.9)
        cover[2 * i + 1], cover[2 * i + 2] = share * cover[i], (1 - share) * cover[i]
    t = treeshap.Tree(np.where(left >= 0, rng.integers(0, 3, n), -1), rng.uniform(size=n).round(1), [None] * n, left, np.where(left >= 0, left + 1, -1),
                      rng.normal(size=n), cover, list(range(n)), 0.1)
    x = rng.integers(0, 8, (5000, 3)) / 8
    seen, real = [], treeshap.tree_shap
    monkeypatch.setattr(treeshap, "tree_shap", lambda t, x: seen.append(len(x)) or real(t, x))
    assert (treeshap.shap_values([t], x) == real(t, x)).all() and seen[0] <= 512
    assert treeshap.shap_values([t], x[:0]).shape == (0, 3)


def test_permuted_rows_travel_without_what_follows_from_them(spark, monkeypatch):
    df = q_models.prepared(spark, SF_SMALL)
    cv = ml.cross_validate(df, "row_id", "y", ["price", "price_n"], ["seg"], 5, spec=q_models.LR)
    written, real = {}, ml.materialize
    monkeypatch.setattr(ml, "materialize", lambda d, name="table": written.setdefault(name, real(d, name)))
    ml.permutation_importance(cv, ["price", "seg"], n_repeats=1)
    assert written["validation"].select(F.max(F.size("x"))).first()[0] == 3  # two values, one statistic
