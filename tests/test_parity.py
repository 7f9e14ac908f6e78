"""Replay checks: compliant lookup passes, order-dependent transforms fail, job batching
carries open jobs across Arrow batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import parity as par
from foldwise.operators import scan
from foldwise.operators.scan import RowState


def frame(spark, n=120):
    rows = [(i, ["Earth", "Mars", "Europa"][i % 3], float((i * 37) % 101), i) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, HomePlanet string, RoomService double, t long")


def test_transform_many_jobs(spark):
    rows = spark.createDataFrame([(0, "Earth", 0.0, 0, 0), (1, "Mars", 0.0, 1, 1), (2, "Earth", 0.0, 1, 2)],
                                 "row_id long, HomePlanet string, RoomService double, job long, pos long")
    params = spark.createDataFrame([("Earth", 20.0), ("Mars", 5.0), (None, 10.0)], "key string, value double")
    out = par.transform_many(par.join_params(rows, params, "HomePlanet", "v"), par.lookup_feature("v"), "row_id", ["job"]).orderBy("row_id").toPandas()
    assert out["value"].tolist() == [20.0, 5.0, 20.0]


def test_transform_many_carries_open_job_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(i, i // 25, i, float(1)) for i in range(200)],
                                     "row_id long, job long, pos long, x double")
        f = par.PandasFeature("c", ("x",), lambda pdf: pdf["x"].cumsum())  # generic, per-job path
        out = par.transform_many(rows, f, "row_id", ["job"], n_parts=3).toPandas()
        # inside each 25-row job the running sum restarts: values 1..25
        assert sorted(out["value"].tolist()) == sorted(list(range(1, 26)) * 8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_compliant_lookup_passes_iid_and_temporal(spark):
    df = frame(spark)
    params = spark.createDataFrame([("Earth", 12.0), ("Mars", 7.0), (None, 3.0)], "key string, value double")
    df = par.join_params(df, params, "HomePlanet", "v")
    f = par.lookup_feature("v")
    offline = df.select("row_id", F.coalesce(
        F.when(F.col("HomePlanet") == "Earth", 12.0).when(F.col("HomePlanet") == "Mars", 7.0), F.lit(3.0)).alias("offline"))
    for time_col in (None, "t"):
        s = par.summarize(par.replay(df, f, offline, "row_id", time_col=time_col)).toPandas()
        assert (s["n_mismatch"] == 0).all() and (s["n_checked"] == 120).all()


def test_rank_in_call_fails_shuffled_replay(spark):
    df = frame(spark)
    offline = par.offline_pct_rank(df, "row_id", "RoomService")
    s = par.summarize(par.replay(df, par.rank_in_call("r", "RoomService"), offline, "row_id")).toPandas()
    assert (s["n_mismatch"] > 0).all()
    whole = offline.toPandas().set_index("row_id")["offline"].sort_index()
    exp = df.toPandas().set_index("row_id")["RoomService"].rank(pct=True).sort_index()
    assert whole.tolist() == pytest.approx(exp.tolist(), rel=1e-12)


def test_cumsum_fails_both_replays(spark):
    df = frame(spark)
    offline = par.offline_cumsum(df, "row_id", "t", "RoomService")
    f = par.cumsum_in_call("c", "RoomService")
    temporal = par.summarize(par.replay(df, f, offline, "row_id", time_col="t")).toPandas().set_index("batch_size")
    # batches smaller than the frame restart the sum; a 500-row batch is the whole frame
    assert temporal.loc[1, "n_mismatch"] > 0 and temporal.loc[50, "n_mismatch"] > 0
    assert temporal.loc[500, "n_mismatch"] == 0
    iid = par.summarize(par.replay(df, f, offline, "row_id")).toPandas()
    assert (iid["n_mismatch"] > 0).all()
    whole = par.temporal_replay(df, f, offline, "row_id", "t").first()
    assert whole["n_checked"] == 3 * 120 + 120 and whole["n_mismatch"] == temporal["n_mismatch"].sum()


def test_examples_are_first_ten(spark):
    df = frame(spark)
    offline = par.offline_pct_rank(df, "row_id", "RoomService")
    d = par.replay(df, par.rank_in_call("r", "RoomService"), offline, "row_id")
    ex = par.examples(d, "row_id").toPandas()
    assert len(ex) == 10 and (ex["batch_size"] == 1).all() and ex["pos"].is_monotonic_increasing


def test_values_of_any_type_are_compared(spark):
    from foldwise.operators.parity import compare
    inf = float("inf")
    for kind, rows, want in (("double", [(1, 1.0, 1.0 + 1e-12), (2, inf, inf), (3, inf, -inf), (4, None, float("nan")), (5, 1.0, None), (6, inf, 1.0)], [1, 1, 0, 1, 0, 0]),
                             ("string", [(1, "a", "a"), (2, "a", "b"), (3, None, None), (4, None, "a")], [1, 0, 1, 0]), ("boolean", [(1, True, True), (2, True, False)], [1, 0])):
        df = spark.createDataFrame(rows, f"row_id long, offline {kind}, value {kind}")
        got = compare(df.select("row_id", "offline"), df.select("row_id", "value"), "row_id").orderBy("row_id").collect()
        assert [int(r["matched"]) for r in got] == want


def states(col):
    return [par.rank_in_call("rank", col), par.cumsum_in_call("sum", col), par.mean_in_call("mean", col),
            par.PandasFeature("shift", (col,), lambda pdf: pdf[col].shift(), state=RowState(
                lambda probes: (None, None), lambda s, rows, probes: tuple(([*s, *rows[col].tolist()])[-2:]),
                lambda a, b: tuple(([*a, *[x for x in b if x is not None]])[-2:]), lambda s, probes, i: s[0]))]


def test_declared_states_equal_the_transform():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"x": rng.integers(0, 6, 60).astype(float)})
    rows.loc[[4, 17, 59], "x"] = np.nan
    for f in states("x")[:3]:
        for n in (1, 2, 5, 18, 40, 60):
            window = rows.iloc[:n]
            want = f.fn(window).iloc[-1]
            for cut in (0, n // 3, n):
                assert scan.state_value(f.state, window, cut) == pytest.approx(want, nan_ok=True)


def test_truncated_replay_equals_every_window(spark):
    """Also a state whose merge isn't commutative, and ties in time."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"row_id": np.arange(400), "t": rng.integers(0, 40, 400), "x": rng.integers(0, 9, 400).astype(float)})
    order = pdf.sort_values(["t", "row_id"], ignore_index=True)
    df = spark.createDataFrame(pdf).repartition(5)
    for f in states("x"):
        for m in (7, 200):
            got = scan.truncated_replay(df, f, "row_id", "t", m).toPandas().sort_values("pos", ignore_index=True)
            at = sorted({int(i * 400 / m) for i in range(m)})
            assert got["pos"].tolist() == at and got["row_id"].tolist() == order["row_id"].iloc[at].tolist()
            assert got["value"].tolist() == pytest.approx([f.fn(order.iloc[:p + 1]).iloc[-1] for p in at], nan_ok=True)


def test_truncated_replay_of_few_rows_and_without_a_state(spark):
    df = spark.createDataFrame([(1, 3, 2.0), (2, 1, None)], "row_id long, t long, x double")
    got = scan.truncated_replay(df, par.cumsum_in_call("c", "x"), "row_id", "t").orderBy("pos").collect()
    assert [(r["pos"], r["row_id"]) for r in got] == [(0, 2), (1, 1)] and got[1]["value"] == 2.0
    assert scan.truncated_replay(df.limit(0), par.cumsum_in_call("c", "x"), "row_id", "t").count() == 0
    with pytest.raises(ValueError, match="declares no state"):
        scan.truncated_replay(df, par.PandasFeature("p", ("x",), lambda pdf: pdf["x"]), "row_id", "t")
