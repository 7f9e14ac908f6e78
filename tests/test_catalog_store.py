"""Catalog round trips, promotion refusal and the feature store."""

import os
import uuid

from pyspark.sql import functions as F

from foldwise.operators import gate
from foldwise.session import checkpoint_dir
from foldwise.sources.catalog import Catalog
from foldwise.sources.feature_store import FeatureStore, safe_name


def cat(spark):
    return Catalog(spark, os.path.join(checkpoint_dir(spark), "t-" + uuid.uuid4().hex))


def test_upsert_latest_best(spark):
    c = cat(spark)
    c.upsert("training_metrics", spark.createDataFrame([("r", 0, 0.6), ("r", 1, 0.7)], "run_id string, iteration int, auc_mean double"))
    c.upsert("training_metrics", spark.createDataFrame([("r", 1, 0.8)], "run_id string, iteration int, auc_mean double"))
    latest = {r["iteration"]: r["auc_mean"] for r in c.latest("training_metrics").collect()}
    assert latest == {0: 0.6, 1: 0.8}
    assert c.best("training_metrics", "auc_mean").first()["auc_mean"] == 0.8


def test_promote_refuses_bad_status_and_duplicates(spark):
    c = cat(spark)
    rows = spark.createDataFrame([("f1", "r", "validated"), ("f2", "r", "leakage_rejected")],
                                 "feature_name string, run_id string, final_status string")
    c.promote(rows)
    c.promote(rows)
    names = sorted(r["feature_name"] for r in c.read("promoted_features").collect())
    assert names == ["f1"] and c.is_promoted("f1") and not c.is_promoted("f2")


def test_by_run_and_status(spark):
    c = cat(spark)
    c.append("validation_results", spark.createDataFrame(
        [("r1", "a", "h", "validated"), ("r1", "b", "h", "dynamic_failed"), ("r2", "c", "h", "validated")],
        "run_id string, feature_name string, hypothesis_id string, final_status string"))
    assert [r["feature_name"] for r in c.by_run("validation_results", "r1", "validated").collect()] == ["a"]


def test_merge_and_pending(spark):
    recs = spark.createDataFrame([("a", 1, "validated", 0.7), ("a", 2, "serving_mismatch", None), ("b", 1, None, 0.6)],
                                 "feature string, seq int, final_status string, auc double")
    m = {r["feature"]: r for r in gate.merge_results(recs, "feature", "seq", ["final_status", "auc"]).collect()}
    assert m["a"]["final_status"] == "serving_mismatch" and m["a"]["auc"] == 0.7 and m["b"]["final_status"] is None
    hyp = spark.createDataFrame([("h1",), ("h2",)], "hypothesis_id string")
    res = spark.createDataFrame([("h1", "validated")], "hypothesis_id string, final_status string")
    s = {r["hypothesis_id"]: r["status"] for r in gate.with_pending(hyp, res).collect()}
    assert s == {"h1": "validated", "h2": "pending"}


def test_improvement_streak(spark):
    m = spark.createDataFrame([("r", 0, 0.6), ("r", 1, 0.55), ("r", 2, 0.58), ("r", 3, 0.7)],
                              "run_id string, iteration int, auc_mean double")
    s = gate.improvement_streak(m).orderBy("iteration").toPandas()
    assert s["since_improvement"].tolist() == [0, 1, 2, 0] and s["best_so_far"].tolist() == [0.6, 0.6, 0.6, 0.7]


def test_feature_store_roundtrip(spark):
    st = FeatureStore(spark, os.path.join(checkpoint_dir(spark), "fs-" + uuid.uuid4().hex))
    vals = spark.createDataFrame([(1, 0.5), (2, 1.5)], "row_id long, v double")
    st.save("run 1", "my/feat", vals, "row_id", "v")
    st.save("run 1", "other", vals, "row_id", "v")
    assert safe_name("my/feat") == "my_feat"
    assert sorted(r["value"] for r in st.load("run 1", "my/feat").collect()) == [0.5, 1.5]
    st.delete("run 1", "other")
    assert [r["feature_name"] for r in st.list_features("run 1").collect()] == ["my_feat"]
    assert st.exists("run 1", "my/feat") and not st.exists("run 1", "other")


def test_saved_columns_are_bound_without_a_shuffle(spark):
    root = os.path.join(checkpoint_dir(spark), "fs-" + uuid.uuid4().hex)
    st = FeatureStore(spark, root, buckets=6)
    ids = spark.range(500).select(F.col("id").alias("k"))
    for j in range(4):
        st.save("r", f"f{j}", ids.where(F.col("k") % (j + 2) != 0).select("k", (F.col("k") * j).cast("double").alias("v")), "k", "v")
    st.save_frame("r", "rows", ids.withColumn("y", F.col("k") % 2), "k")
    bound = st.bind("r", ["f0", "f1", "f2", "f3"], frame="rows")
    rows = {r["row_id"]: r for r in bound.collect()}
    assert len(rows) == 500
    assert all(rows[k][f"f{j}"] == (float(k * j) if k % (j + 2) else None) for k in range(500) for j in range(4))
    assert "Exchange" not in bound._jdf.queryExecution().executedPlan().toString()
    again = FeatureStore(spark, root)  # as a later session finds it
    spark.sql(f"DROP TABLE {st._name(st._path('r', 'f1'))}")
    assert again.buckets() == 6 and "Exchange" not in again.bind("r", ["f0", "f1"])._jdf.queryExecution().executedPlan().toString()
    st.save("r", "f1", ids.select("k", F.lit(1.0).alias("v")), "k", "v")
    assert again.load("r", "f1").agg(F.sum("value")).first()[0] == 500.0


def test_gate_status_ladder(spark):
    df = spark.createDataFrame([(None, True), (0.95, True), (0.7, False), (0.7, True)], "auc double, parity boolean")
    out = [r["s"] for r in df.select(gate.gate_status(F.lit(True), F.col("auc"), F.col("parity")).alias("s")).collect()]
    assert out == ["dynamic_failed", "leakage_rejected", "serving_mismatch", "validated"]


def test_promotion_says_what_became_of_each_candidate(spark):
    import tempfile

    from foldwise.sources.catalog import Catalog
    c = Catalog(spark, tempfile.mkdtemp(prefix="fw-cat-", dir="/tmp"))
    cols = "feature_name string, run_id string, iteration int, final_status string"
    one = c.promote(spark.createDataFrame([("a", "r", 2, "validated"), ("a", "r", 1, "validated"), ("b", "r", 0, "leakage_rejected"), ("c", "r", 0, None)], cols))
    assert {(r["feature_name"], r["iteration"]): r["outcome"] for r in one.collect()} == {("a", 2): "superseded", ("a", 1): "written", ("b", 0): "refused", ("c", 0): "refused"}
    empty = Catalog(spark, tempfile.mkdtemp(prefix="fw-cat-", dir="/tmp"))
    for _ in range(2):
        assert empty.promote(spark.createDataFrame([("a", "r", 2, "leakage_rejected")], cols)).first()["outcome"] == "refused"
    assert empty.read("promoted_features").count() == 0 and not empty.is_promoted("a")
    two = c.promote(spark.createDataFrame([("a", "r", 3, "validated"), ("b", "r", 3, "validated")], cols))
    assert {r["feature_name"]: r["outcome"] for r in two.collect()} == {"a": "present", "b": "written"}
    kept = c.read("promoted_features").collect()
    assert sorted((r["feature_name"], r["iteration"]) for r in kept) == [("a", 1), ("b", 3)]
    import json
    assert all(json.loads(r["data"])["feature_name"] == r["feature_name"] for r in kept)
