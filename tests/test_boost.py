"""Boosted trees of many folds: Spark's trees, in scans that don't follow the number of models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from foldwise.operators import boost, models as ml, treeshap
from foldwise.operators.treeshap import read_trees

K = 3
SPEC = ml.ModelSpec(kind="gbt", trees=3, depth=4)


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(8)
    n = 3000
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * a + b * b))).astype(int)
    pdf = pd.DataFrame({"row_id": range(n), "y": y, "fold": np.arange(n) % (K + 1), "a": np.where(rng.random(n) < 0.2, np.nan, a), "b": b, "one": 1.0,
                        "c": rng.choice(list("pqrst"), n)})
    df = spark.createDataFrame(pdf).withColumn("fold", F.when(F.col("fold") < K, F.col("fold"))).repartition(5)
    return ml.build_design(df, "row_id", "y", ["a", "b", "one"], ["c"], K)


def jobs(spark, run) -> int:
    spark.sparkContext.setJobGroup(name := f"group-{np.random.default_rng().integers(1 << 60)}", "")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_models_share_scans(spark, design):
    features = ["a", "b", "one", "c"]
    one = jobs(spark, lambda: design.fit([(0, features)], SPEC))
    assert jobs(spark, lambda: design.fit([(i, features) for i in range(K + 1)], SPEC)) == one


def test_trees_are_those_of_spark(spark, design):
    sets = [(0, ["a", "b", "one", "c"]), (K, ["a", "b", "one", "c"]), (1, ["b"]), (2, ["one"])]
    for (i, features), m in zip(sets, design.fit(sets, SPEC), strict=True):
        train = design.table.where(F.col("fold").isNotNull() & (F.col("fold") != i))
        rows = train.select("label", array_to_vector(design.vector(i, list(m.columns), "enc_fit")).alias("x"))
        want = read_trees(GBTClassifier(featuresCol="x", labelCol="label", maxIter=SPEC.trees, maxDepth=SPEC.depth, stepSize=SPEC.step, seed=SPEC.seed).fit(rows), spark)
        assert len(m.trees) == len(want)
        for t, w in zip(m.trees, want, strict=True):
            for part in ("feature", "left", "right", "cover"):
                assert getattr(t, part).tolist() == getattr(w, part).tolist()
            split = t.feature >= 0
            assert t.threshold[split] == pytest.approx(w.threshold[split]) and t.value[~split] == pytest.approx(w.value[~split], abs=1e-9)
            assert t.weight == w.weight and t.order == w.order


def test_candidate_splits_are_those_of_spark():
    rng = np.random.default_rng(9)
    for x in (rng.normal(size=5000), rng.normal(size=40), np.arange(32.0), np.arange(33.0), np.ones(50), np.append(np.zeros(4000), rng.normal(size=1000)), rng.poisson(30, 2000) * 1.0):
        found, counts = np.unique(x, return_counts=True)
        want, stride = [], len(x) / 32
        if len(found) <= 32:
            want = ((found[1:] + found[:-1]) / 2).tolist()
        else:
            current, target = counts[0], stride
            for at in range(1, len(found)):
                before, current = current, current + counts[at]
                if abs(before - target) < abs(current - target):
                    want.append((found[at - 1] + found[at]) / 2)
                    target += stride
        assert boost.thresholds(x).tolist() == want and len(want) < 32


def test_many_tasks_and_small_blocks_give_the_same_trees(design, monkeypatch):
    sets = [(0, ["a", "b", "c"]), (1, ["a", "c"])]
    whole = design.fit(sets, SPEC)
    for name, value in (("GROUP", 2), ("BLOCK_BYTES", 1), ("BATCH", 100), ("TOGETHER", 1)):
        monkeypatch.setattr(boost, name, value)
    for m, n in zip(whole, design.fit(sets, SPEC), strict=True):
        for t, u in zip(m.trees, n.trees, strict=True):
            assert t.feature.tolist() == u.feature.tolist() and t.cover.tolist() == u.cover.tolist() and t.value == pytest.approx(u.value, abs=1e-12)


def test_labels_are_two_classes(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, float(i)) for i in range(60)], "row_id long, y int, fold int, x double")
    with pytest.raises(Exception, match="0 and 1"):
        ml.build_design(df, "row_id", "y", ["x"], [], 2).fit([(0, ["x"])], SPEC)


def test_validation_rows_are_what_the_fold_models_score(design):
    r = ml.CVResult(design, {})
    rows = ml.validation_rows(r)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    got, table = rows.toPandas().set_index("id"), design.table.where("fold IS NOT NULL").toPandas()
    assert len(got) == len(table)
    for i, g in table.groupby("fold"):
        x = design.columns.matrix(np.stack(g["num"].to_numpy()), np.stack(g["enc_apply"].to_numpy()), int(i))
        assert (np.stack(got.loc[g["row_id"], "x"].to_numpy()) == x).all() and (got.loc[g["row_id"], "fold"] == i).all()


def test_few_and_many_nodes_group_rows_alike(monkeypatch):
    ways = [w for w in np.random.default_rng(10).random((12, 3000)) < 0.5]
    few, group = treeshap.same_ways(ways, 3000)
    monkeypatch.setattr(treeshap, "FEW", 0)
    many, other = treeshap.same_ways(ways, 3000)
    code = np.array(ways)
    assert (code[:, few][:, group] == code).all() and (code[:, many][:, other] == code).all() and len(few) == len(many)
    assert len(treeshap.same_ways([], 5)[0]) == 1 and len(treeshap.same_ways([w[:0] for w in ways], 0)[0]) == 0


def test_no_depth_and_deep_trees(design):
    flat = design.fit([(0, ["a", "b"])], ml.ModelSpec(kind="gbt", trees=2, depth=0))[0]
    labels = [r["label"] for r in design.table.where("fold IS NOT NULL AND fold <> 0").collect()]
    assert [t.feature.tolist() for t in flat.trees] == [[-1], [-1]] and flat.trees[0].value[0] == pytest.approx(2 * np.mean(labels) - 1)
    deep = design.fit([(0, ["a", "b", "c"])], ml.ModelSpec(kind="gbt", trees=1, depth=8))[0].trees[0]
    leaves = deep.left < 0
    assert leaves.sum() > 32 and deep.cover[leaves].sum() == len(labels) and (deep.cover[leaves] >= 1).all()
