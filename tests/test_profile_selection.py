"""Profiling statistics, association and redundancy pruning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import profile as pf
from foldwise.functions.scalar import missing_category
from foldwise.operators.selection import forward_search, redundancy_clusters, redundancy_survivors, selection_round


def test_numeric_stats_match_population_moments(spark):
    rng = np.random.default_rng(12)
    x = rng.gamma(2.0, 2.0, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = pf.profile_numeric(df, ["x"]).first()
    m2 = np.mean((x - x.mean()) ** 2)
    assert r["std"] == pytest.approx(x.std(ddof=1), rel=1e-10)
    assert r["skew"] == pytest.approx(np.mean((x - x.mean()) ** 3) / m2 ** 1.5, rel=1e-9)
    assert r["kurtosis"] == pytest.approx(np.mean((x - x.mean()) ** 4) / m2 ** 2 - 3, rel=1e-9)


def test_small_columns_fall_back_to_zero(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    r = {x["column_name"]: x for x in pf.profile_numeric(df, ["a", "b"]).collect()}
    assert r["a"]["skew"] == 0.0 and r["a"]["kurtosis"] == 0.0 and r["a"]["std"] == pytest.approx(0.7071067811865476)
    assert r["b"]["mean"] == 0.0 and r["b"]["std"] == 0.0


def test_missing_and_distinct(spark):
    rows = [(float(i) if i % 20 else None, "A" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "age double, c string")
    m = {x["column_name"]: x for x in pf.profile_missing(df, ["age", "c"]).collect()}
    assert m["age"]["n_missing"] == 3 and m["age"]["pct_missing"] == pytest.approx(0.05)
    d = {x["column_name"]: x for x in pf.profile_distinct(df, ["c"]).collect()}
    assert d["c"]["n_unique"] == 1 and d["c"]["is_constant"]


def test_top_values_order_and_limit(spark):
    rows = [(f"v{i % 30:02d}",) for i in range(300)] + [("v05",)] * 5
    df = spark.createDataFrame(rows, "c string")
    t = pf.profile_top_values(df, ["c"]).orderBy("rk").toPandas()
    assert len(t) == 20 and t.loc[0, "value"] == "v05" and t.loc[1, "value"] == "v00"


def test_cramers_v_matches_textbook_chi_square(spark):
    rng = np.random.default_rng(13)
    c = rng.choice(["a", "b", "c"], 400)
    y = (rng.uniform(0, 1, 400) < np.where(c == "a", 0.7, 0.3)).astype(int)
    df = spark.createDataFrame([(str(a), int(b)) for a, b in zip(c, y)], "c string, y int")
    v = pf.cramers_v(pf.contingency(df, ["c"], "y"), "y").first()["v"]
    ct = pd.crosstab(pd.Series(c), pd.Series(y)).to_numpy().astype(float)
    exp = np.outer(ct.sum(1), ct.sum(0)) / ct.sum()
    chi2 = ((ct - exp) ** 2 / exp).sum()
    assert v == pytest.approx(np.sqrt(chi2 / ct.sum() / 1), rel=1e-10)


def test_corr_guard_for_constant_column(spark):
    df = spark.createDataFrame([(1.0, i % 2, float(i)) for i in range(30)], "k double, y int, x double")
    r = {x["column_name"]: x["corr"] for x in pf.assoc_numeric(df, ["k", "x"], "y").collect()}
    assert r["k"] is None and r["x"] is not None


def test_clusters_and_survivors(spark):
    rng = np.random.default_rng(14)
    a = rng.normal(size=200)
    rows = [(float(x), float(x * 1.001 + 1e-6 * rng.normal()), float(z)) for x, z in zip(a, rng.normal(size=200))]
    df = spark.createDataFrame(rows, "a double, dup double, b double")
    found = {(r["cluster"], r["feature"]) for r in redundancy_clusters(df, ["a", "dup", "b"], 0.95).collect()}
    assert found == {("a", "a"), ("a", "dup"), ("b", "b")}
    clusters = spark.createDataFrame([("a", "a"), ("a", "dup"), ("b", "b")], "cluster string, feature string")
    imp = spark.createDataFrame([("a", 0.1), ("dup", 0.5), ("b", 0.2)], "feature string, importance double")
    s = {r["cluster"]: r["survivor"] for r in redundancy_survivors(clusters, imp, ["a", "dup", "b"]).collect()}
    assert sorted(s.values()) == ["b", "dup"]


def test_forward_search_order_budget_and_threshold(spark):
    scores = {(): 0.5, ("x",): 0.6, ("x", "a"): 0.70, ("x", "b"): 0.70005, ("x", "a", "b"): 0.71}
    asked = []

    def auc(sets):
        asked.append(len(sets))
        return [scores[tuple(s)] for s in sets]

    steps = forward_search(spark, auc, ["x"], ["a", "b"]).collect()
    assert [(r["feature"], r["auc"], r["evals"]) for r in steps] == [(None, 0.6, 1), ("a", 0.70, 3), ("b", 0.71, 4)]
    assert asked == [1, 2, 1]  # a step's candidates are fitted together
    short = forward_search(spark, auc, ["x"], ["a", "b"], max_evals=2).collect()
    assert [(r["feature"], r["evals"]) for r in short] == [(None, 1), ("a", 2)]
    flat = forward_search(spark, lambda sets: [0.5] * len(sets), [], ["a", "b"]).collect()
    assert [(r["feature"], r["evals"]) for r in flat] == [(None, 0), (None, 2)]


def test_run_selection_keeps_baseline_over_redundant_candidate(spark):
    rng = np.random.default_rng(15)
    a = rng.normal(size=100)
    df = spark.createDataFrame([(float(x), float(x * 2), float(z)) for x, z in zip(a, rng.normal(size=100))],
                               "base1 double, cand_dup double, cand_new double")
    aucs = {("base1",): 0.6, ("base1", "cand_dup"): 0.62, ("base1", "cand_new"): 0.65,
            ("base1", "cand_new"): 0.65}
    r = selection_round(df, lambda sets: [aucs.get(tuple(s), 0.66) for s in sets], ["base1"], ["cand_dup", "cand_new"]).first()
    assert r["kept"] == ["base1", "cand_new"] and r["accepted"] == ["cand_dup", "cand_new"] and r["rejected"] == []
    assert r["clusters"] == [["base1", "cand_dup"], ["cand_new"]] and r["final_selected"] == ["base1", "cand_new"]
    assert [(x["feature"], x["auc"]) for x in r["auc_trace"]] == [("cand_new", 0.65)] and (r["baseline_auc"], r["final_auc"]) == (0.6, 0.65)
    none = selection_round(df, lambda sets: [0.6] * len(sets), ["base1"], ["cand_new"]).first()
    assert none["final_selected"] == ["base1"] and none["rejected"] == ["cand_new"] and none["auc_trace"] == []


def test_correlation_skips_missing_values_pair_by_pair(spark):
    rng = np.random.default_rng(18)
    X = rng.normal(size=(300, 5)) * [1, 1e6, 1e-6, 1, 1] + [0, 1e9, 0, 5, 0]
    X[:, 3] = X[:, 0] * 2 + 0.1 * X[:, 3]
    X[rng.random(X.shape) < 0.2] = np.nan
    cols = ["a", "b", "c", "d", "e", "k", "m"]
    frame = pd.DataFrame(X, columns=cols[:5]).assign(k=1.0, m=np.nan)
    rows = [tuple(None if i % 2 and np.isnan(v) else float(v) for v in r) for i, r in enumerate(frame.to_numpy())]  # nulls and NaN
    got = {(r["a"], r["b"]): r["corr"] for r in pf.correlation_pairs(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols).collect()}
    want = frame.corr()
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if "k" in (a, b) or "m" in (a, b):
                assert got.get((a, b)) is None
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_correlation_of_many_columns(spark):
    n = 400
    df = spark.range(200).select(*[F.when(F.rand(i) > 0.1, F.rand(1000 + i)).alias(f"c{i}") for i in range(n)])
    assert pf.correlation_pairs(df, df.columns).count() == n * (n - 1) // 2


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    r = pf.profile_distinct(df, ["x"]).first()
    assert (r["n_unique"], pf.profile_missing(df, ["x"]).first()["n_missing"]) == (2, 2)
    got = [r["v"] for r in df.select(missing_category("x", df).alias("v")).collect()]
    assert got == ["1.0", "2.0", "__missing__", "__missing__"]


def test_distinct_values_of_many_columns_in_one_shuffle(spark):
    nan = float("nan")
    rows = [(1.5, "x", True, None, "a" * 40), (-0.0, "x", None, None, "a" * 41), (0.0, "", False, None, "a" * 40), (nan, None, True, None, "b"), (None, "x", True, None, "")]
    df = spark.createDataFrame(rows, "d double, s string, b boolean, none string, long string").withColumn("arr", F.array("s", "long")).withColumn("bin", F.col("long").cast("binary"))
    got = {r["column_name"]: (r["n_unique"], r["is_constant"]) for r in pf.profile_distinct(df, df.columns).collect()}
    assert got == {"d": (2, False), "s": (2, False), "b": (2, False), "none": (0, True), "long": (4, False), "arr": (5, False), "bin": (4, False)}
    wide = spark.range(300).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(200)])
    out = pf.profile_distinct(wide, wide.columns)
    assert {r["column_name"]: r["n_unique"] for r in out.collect()} == {f"c{i}": i + 1 for i in range(200)}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
