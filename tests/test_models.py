"""Models over one design: encodings, batched logistic fits, boosted trees, permutation scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from foldwise.functions.hashing import TWO_POW_32, h
from foldwise.operators import models as ml
from foldwise.operators.encoding import ordered_statistics
from foldwise.operators.logit import added_up, fit_many
from foldwise.operators.scoring import binary_metrics

K = 3
SPEC = ml.ModelSpec(reg_param=0.02)


def frame(spark, n=900):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        a, b = float(rng.normal()), float(rng.normal())
        cat = ["hot"] * 3 + ["x", "y", None]
        c = cat[rng.integers(6)]
        y = int(rng.random() < 1 / (1 + np.exp(-(a - 0.5 * b + (c == "x")))))
        rows.append((i, y, None if i % 10 == 9 else i % K, None if i % 7 == 0 else a, float("nan") if i % 11 == 0 else b * 1e6 + 1e9, c, f"r{rng.integers(300)}"))
    return spark.createDataFrame(rows, "row_id long, y int, fold int, a double, b double, c string, rare string").repartition(3)


@pytest.fixture(scope="module")
def design(spark):
    return ml.build_design(frame(spark), "row_id", "y", ["a", "b"], ["c", "rare"], K)


def test_ordered_statistics_equal_a_walk_over_the_rows(spark):
    df = frame(spark, 400)
    rows = sorted((r["_h"], r["row_id"], r["y"], r["fold"], r["c"] or "__missing__", r["rare"]) for r in df.withColumn("_h", h("row_id", "ts42")).collect())
    got = {r["row_id"]: (r["enc_fit"], r["enc_apply"]) for r in ordered_statistics(df, "row_id", "y", ["c", "rare"], K).collect()}
    assert len(got) == 400
    for at in (4, 5):
        for model in range(K + 1):
            train = [r for r in rows if r[3] is not None and r[3] != model]
            prior = sum(r[2] for r in train) / len(train)
            total, seen = {}, {}
            for r in train:
                s, n = total.get(r[at], (0, 0))
                total[r[at]] = (s + r[2], n + 1)
            for r in rows:
                place = (at - 4) * (K + 1) + model
                s, n = seen.get(r[at], (0, 0))
                assert got[r[1]][0][place] == pytest.approx((s + prior) / (n + 1))
                if r[3] is not None and r[3] != model:
                    seen[r[at]] = (s + r[2], n + 1)
                s, n = total.get(r[at], (0, 0))
                assert got[r[1]][1][place] == pytest.approx((s + prior) / (n + 1))


def single_fit(design, model, features):
    picked = design.columns.of(features)
    train = design.table.where(F.col("fold").isNotNull() & (F.col("fold") != model))
    rows = train.select("label", array_to_vector(design.vector(model, picked, "enc_fit")).alias("x"))
    m = LogisticRegression(featuresCol="x", labelCol="label", regParam=SPEC.reg_param, tol=1e-12, maxIter=300).fit(rows)
    return m.coefficients.toArray(), m.intercept


def test_batched_fits_equal_single_fits(design):
    sets = [(i, f) for i in range(K + 1) for f in (["a"], ["a", "b", "c"], ["rare", "a"])]
    models, scans = fit_many(design.table, design.columns, sets, SPEC.reg_param)
    assert scans <= 15  # for twelve models
    for (i, f), m in zip(sets, models, strict=True):
        coef, intercept = single_fit(design, i, f)
        spread = design.moments[1][i][list(m.columns)]
        assert m.coef * spread == pytest.approx(coef * spread, abs=2e-5) and m.columns == tuple(design.columns.of(f))
        x = design.moments[0][i]
        assert m.margin(x[None, :])[0] == pytest.approx(coef @ x[list(m.columns)] + intercept, abs=2e-5)


def test_sums_of_many_tasks_are_added_in_two_levels(spark):
    rows = spark.range(300).select((F.col("id") % 2).cast("int").alias("model"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("sums"), F.col("id").cast("int").alias("part"))
    for tasks in (3, 300):
        got = added_up(rows, "model", tasks)
        assert {m: v.tolist() for m, v in got.items()} == {0: [sum(range(0, 300, 2)), 150.0], 1: [sum(range(1, 300, 2)), 150.0]}


def test_set_aucs_equal_each_sets_cross_validation(spark, design):
    sets = [["a"], [], ["a", "b"], ["c", "rare"]]
    got = ml.set_aucs(design, sets, SPEC)
    for s, auc in zip(sets, got, strict=True):
        if not s:
            assert auc == 0.5
            continue
        nums, cats = [c for c in s if c in ("a", "b")], [c for c in s if c not in ("a", "b")]
        r = ml.cross_validate(frame(spark), "row_id", "y", nums, cats, K, spec=SPEC)
        assert r.fold_metrics.where("fold = -1").first()["auc"] == pytest.approx(auc, abs=1e-9)
    assert got[2] > got[0] > 0.6


def test_oof_rows_are_scored_by_the_model_that_did_not_see_them(design):
    r = ml.cross_validate(design, "row_id", "y", ["a", "b"], ["c"], K, spec=SPEC)
    oof = r.oof.toPandas().set_index("row_id")
    assert len(oof) == 810 and oof["fold"].notna().all()
    table = design.table.where("fold IS NOT NULL").toPandas()
    for i, g in table.groupby("fold"):
        x = design.columns.matrix(np.stack(g["num"]), np.stack(g["enc_apply"]), int(i))
        assert oof.loc[g["row_id"], "proba"].tolist() == pytest.approx(r.models[int(i)].proba(x).tolist())
    seen = r.train_metrics.where("fold >= 0").toPandas()
    assert len(seen) == K and (seen["auc"] > 0.6).all()


def test_full_model_and_holdout(spark):
    df = frame(spark).withColumn("split", F.when(F.col("fold").isNull(), "holdout").otherwise("dev"))
    d, m = ml.fit(df, "row_id", "y", ["a", "b"], ["c"], SPEC)
    assert d.k == K and ml.predict(d, m).count() == 900
    h_ = ml.holdout_metrics(df, "row_id", "y", ["a", "b"], ["c"], spec=SPEC).first()
    direct = binary_metrics(ml.predict(d, m).where("split = 'holdout'"), "proba", "label").first()
    assert h_["auc"] == pytest.approx(direct["auc"]) and h_["auc"] > 0.6


def test_boosted_trees_score_as_spark_does(design):
    spec = ml.ModelSpec(kind="gbt", trees=4, depth=3)
    m = design.fit([(1, ["a", "b", "c"])], spec)[0]
    picked = design.columns.of(["a", "b", "c"])
    rows = design.table.where("fold IS NOT NULL").withColumn("x", array_to_vector(design.vector(1, picked, "enc_fit")))
    gbt = GBTClassifier(featuresCol="x", labelCol="label", maxIter=4, maxDepth=3, stepSize=spec.step, seed=spec.seed).fit(rows.where("fold <> 1"))
    want = gbt.transform(rows).select("num", "enc_fit", vector_to_array("probability").alias("p")).toPandas()
    x = design.columns.matrix(np.stack(want["num"]), np.stack(want["enc_fit"]), 1)
    assert m.proba(x).tolist() == pytest.approx([p[1] for p in want["p"]], abs=1e-9)


def auc(y, s):
    ranks = pd.Series(s).rank().to_numpy()
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_permutation_importance_equals_shuffling_directly(spark, design):
    r = ml.cross_validate(design, "row_id", "y", ["a", "b"], ["c"], K, spec=SPEC)
    got = {x["feature"]: x["importance"] for x in ml.permutation_importance(r, ["a", "c"], n_repeats=2, seed=5).collect()}
    t = design.table.where("fold IS NOT NULL")
    for rep in range(2):
        t = t.withColumn(f"a{rep}", h("row_id", f"a5_{rep}")).withColumn(f"b{rep}", h("row_id", f"b5_{rep}"))
    table, drops = t.toPandas(), {"a": [], "c": []}
    for i, g in table.groupby("fold"):
        x = design.columns.matrix(np.stack(g["num"]), np.stack(g["enc_apply"]), int(i))
        y, base = g["label"].to_numpy(), None
        base = auc(y, r.models[int(i)].proba(x))
        for c in drops:
            own = design.columns.of([c])
            for rep in range(2):
                to, frm = np.argsort(g[f"a{rep}"].to_numpy()), np.argsort(g[f"b{rep}"].to_numpy())
                z = x.copy()
                z[np.ix_(to, own)] = x[np.ix_(frm, own)]
                drops[c].append(base - auc(y, r.models[int(i)].proba(z)))
    assert got == pytest.approx({c: np.mean(v) for c, v in drops.items()}, abs=1e-9)


def test_models_take_any_number_of_categories(spark):
    """100,000 categories; trees of depth 6."""
    df = spark.range(120_000).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 100_000).alias("cat"), (F.col("id") % 97).cast("double").alias("x"),
                                     F.when(F.col("id") % 97 > 50, 1).otherwise(0).alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    design = ml.build_design(df, "row_id", "y", ["x"], ["cat"], 3)
    for spec in (ml.ModelSpec(kind="logistic"), ml.ModelSpec(kind="gbt", trees=2, depth=6)):
        r = ml.cross_validate(design, "row_id", "y", ["x"], ["cat"], 3, spec=spec)
        assert r.fold_metrics.where("fold = -1").first()["auc"] > 0.95


def test_shap_and_permutation_find_the_column_that_counts(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 5).alias("cat"), (F.hash("id") % 97).cast("double").alias("x"),
                                  F.when(F.col("id") % 5 >= 3, 1).otherwise(0).alias("y"), (F.abs(F.hash(F.col("id") + 7)) % 3).cast("int").alias("fold"))
    r = ml.cross_validate(df, "row_id", "y", ["x"], ["cat"], 3, spec=ml.ModelSpec(kind="gbt", trees=3, depth=3))
    shap = {x["feature"]: x["mean_abs_shap"] for x in ml.tree_shap_importance(r).collect()}
    assert shap["cat"] > 5 * shap["x"]
    imp = {x["feature"]: x["importance"] for x in ml.permutation_importance(r, ["x", "cat"], n_repeats=2).collect()}
    assert imp["cat"] > 0.2 and abs(imp["x"]) < 0.05


def test_constant_and_missing_columns_and_one_class(spark):
    rows = [(i, i % 2, i % 2, 1.0, None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, y int, fold int, one double, none double, c string")
    r = ml.cross_validate(df, "row_id", "y", ["one", "none"], ["c"], 2, spec=SPEC)
    assert r.oof.where("proba IS NULL OR isnan(proba)").count() == 0 and TWO_POW_32 > 0
