"""Out-of-fold features: exact values, fold isolation and leakage negative control."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import features as fx
from foldwise.operators.scoring import single_feature_auc


def six_rows(spark):
    # 3 explicit folds of two rows each
    rows = [(0, "Earth", 10.0, 0), (1, "Mars", 20.0, 0), (2, "Earth", 30.0, 1), (3, "Mars", 40.0, 1),
            (4, "Earth", 50.0, 2), (5, "Mars", 60.0, 2)]
    return spark.createDataFrame(rows, "row_id long, HomePlanet string, RoomService double, fold int")


def test_oof_group_mean_exact(spark):
    f = fx.GroupStat(name="v", key="HomePlanet", value="RoomService", default="global")
    got = f.oof(six_rows(spark)).orderBy("row_id").toPandas()["v"].tolist()
    assert got == pytest.approx([40.0, 50.0, 30.0, 40.0, 20.0, 30.0])


def test_generic_k_fit_path_equals_fold_subtraction(spark):
    df = six_rows(spark)
    f = fx.GroupStat(name="v", key="HomePlanet", value="RoomService", default="global")
    generic = fx.Feature.__new__(fx.Feature)
    generic.name, generic.required_columns, generic.uses_target = "v", f.required_columns, False
    generic.fit, generic.transform = f.fit, f.transform
    got = fx.compute_oof(generic, df, "row_id", 3).orderBy("row_id").toPandas()["v"].tolist()
    assert got == pytest.approx([40.0, 50.0, 30.0, 40.0, 20.0, 30.0])


def test_transform_uses_params_and_default(spark):
    params = spark.createDataFrame([("Earth", 20.0), ("Mars", 5.0), (None, 10.0)], "key string, value double")
    rows = spark.createDataFrame([(0, "Earth"), (1, "Mars"), (2, "Venus"), (3, None)], "row_id long, HomePlanet string")
    f = fx.GroupStat(name="v", key="HomePlanet", value="RoomService")
    got = f.transform(rows, params).orderBy("row_id").toPandas()["v"].tolist()
    assert got == [20.0, 5.0, 10.0, 10.0]


def test_fit_never_sees_validation_rows(spark):
    # each row's own value is huge; if a row saw itself the OOF value would be huge too
    rows = [(i, "k", float(1e6 if i % 5 == 0 else 1.0), i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, k string, v double, fold int")
    f = fx.GroupStat(name="m", key="k", value="v")
    out = f.oof(df).toPandas()
    assert out.loc[out["fold"] == 0, "m"].max() == pytest.approx(1.0)


def test_frequency_and_target_encoding(spark):
    rows = [(i, "a" if i % 4 else "b", int(i % 4 == 0), (i // 4) % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, k string, y int, fold int")
    fr = fx.GroupStat(name="f", key="k", kind="frequency").oof(df).orderBy("row_id").toPandas()
    # fold 0 rows see fold 1 rows only: 20 rows, 5 of key b
    assert fr.loc[0, "f"] == pytest.approx(5 / 20)
    te = fx.GroupStat(name="t", key="k", value="y", uses_target=True, default=0.5).oof(df).orderBy("row_id").toPandas()
    assert te.loc[0, "t"] == pytest.approx(1.0) and te.loc[1, "t"] == pytest.approx(0.0)


def test_holdout_rows_have_no_oof_value(spark):
    rows = [(i, "a", 1.0, None if i < 3 else i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, k string, v double, fold int")
    out = fx.compute_oof(fx.GroupStat(name="m", key="k", value="v"), df, "row_id", 2)
    cov = fx.oof_coverage(out, df, "row_id", "m").first()
    assert cov["n_rows"] == cov["n_ids"] == 10 and cov["n_dev_valued"] == 7 and cov["n_holdout_valued"] == 0


def test_memoised_encoding_is_flagged_proper_is_not(spark):
    rng = np.random.default_rng(11)
    rows = [(i, f"c{i}", int(rng.uniform() < 0.5), i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, category_id string, y int, fold int")
    leaky = fx.memoised_encoding(df, "category_id", "y", name="leaky")
    proper = fx.GroupStat(name="proper", key="category_id", value="y", uses_target=True, default=0.5).oof(leaky)
    r = {x["feature"]: x for x in single_feature_auc(proper, ["leaky", "proper"], "y", "row_id").collect()}
    assert r["leaky"]["flag"] and r["leaky"]["auc"] > 0.9
    assert r["proper"]["auc"] is None and not r["proper"]["flag"]


def test_days_since_start_fold_min(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i), i % 3) for i in range(9)]
    df = spark.createDataFrame(rows, "row_id long, t timestamp, fold int")
    out = fx.DaysSinceStart(name="d", time_col="t").oof(df).orderBy("row_id").toPandas()
    # fold 0 rows (0, 3, 6) see the earliest of folds 1, 2 = day 1
    assert out.loc[0, "d"] == pytest.approx(-1.0) and out.loc[3, "d"] == pytest.approx(2.0)


def test_validate_feature_rejects_target_input(spark):
    df = six_rows(spark).withColumn("y", F.lit(1))
    with pytest.raises(ValueError):
        fx.validate_feature(fx.ratio("r", "RoomService", "y"), df, target_col="y")
    with pytest.raises(ValueError):
        fx.validate_feature(fx.ratio("r", "RoomService", "missing"), df)


def test_pandas_fit_matches_direct_smoothing_with_hot_key(spark):
    rng = np.random.default_rng(17)
    # a third of the rows share one key
    keys = ["hot" if i % 3 == 0 else f"k{i % 17}" for i in range(900)]
    rows = [(i, keys[i], int(rng.uniform() < 0.4), i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, k string, y int, fold int")
    got = fx.smoothed_target_encoding("v", "k", "y", m=10.0).oof(df, k=4).orderBy("row_id").toPandas()["v"]
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["row_id", "k", "y", "fold"])
    exp = []
    for _, r in pdf.iterrows():
        tr = pdf[pdf.fold != r.fold]
        prior = tr.y.mean()
        g = tr[tr.k == r.k]
        exp.append((g.y.sum() + 10.0 * prior) / (len(g) + 10.0) if len(g) else prior)
    assert got.tolist() == pytest.approx(exp, rel=1e-12)


def test_coerce_output_and_categorical_list(spark):
    df = spark.createDataFrame([("1.5", "a"), ("2", "b"), (None, None)], "n string, s string")
    assert dict(fx.coerce_output(df, "n").dtypes)["n"] == "double"
    assert dict(fx.coerce_output(df, "s").dtypes)["s"] == "string"
    feats = [fx.cross("c", "a", "b"), fx.ratio("r", "a", "b")]
    df2 = spark.createDataFrame([("x", "y", "z")], "seg string, c string, r string")
    assert fx.categorical_columns(df2, ["seg", "missing"], feats) == ["seg", "c"]


@pytest.mark.parametrize("big", [1e17, float("inf"), -1e300])
@pytest.mark.parametrize("make", [lambda: fx.GroupStat(name="v", key="k", value="x", default=0.0),
                                  lambda: fx.PandasFit(name="v", key="k", partials={"s": F.sum("x"), "n": F.count("x").cast("double")},
                                                       finish=lambda train, glob: train["s"] / train["n"])])
def test_own_fold_never_touches_the_others_sum(spark, big, make):
    df = spark.createDataFrame([(0, "a", big, 0), (1, "a", 0.1, 1), (2, "a", 0.3, 2)], "row_id long, k string, x double, fold int")
    got = make().oof(df, k=3).where("fold = 0").first()["v"]
    assert got == pytest.approx(0.2, abs=1e-12)


def test_features_of_two_keys_take_two_aggregates_and_no_id_join(spark):
    df = spark.createDataFrame([(i, f"a{i % 3}", f"b{i % 4}", float(i), i % 2, i % 5) for i in range(60)],
                               "row_id long, a string, b string, x double, y int, fold int")
    feats = [fx.GroupStat(name=f"{key}{j}", key=key, value="x" if j % 2 else "y", default=float(j)) for key in "ab" for j in range(10)]
    out = fx.assemble(df, "row_id", feats, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3 and "row_id" not in "".join(x for x in plan.splitlines() if "Join" in x)  # two keys and the fallback
    one = out.orderBy("row_id").toPandas()
    for f in feats[::7]:
        assert one[f.name].tolist() == pytest.approx(f.oof(df, k=5).orderBy("row_id").toPandas()[f.name].tolist())


def test_contract_lists_all_that_is_wrong(spark):
    class Odd:
        name, required_columns, transform = "odd", ("nope", "fold"), None

    with pytest.raises(ValueError, match="fit is not callable; transform is not callable; the table lacks nope; it reads the target fold"):
        fx.validate_feature(Odd(), six_rows(spark), target_col="fold")
