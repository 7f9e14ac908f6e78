"""Structured Streaming: parity of micro-batch transforms and closed-window PSI."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from foldwise.operators import features as fx
from foldwise.operators import stability as st
from foldwise.session import checkpoint_dir
from foldwise.streaming.drift import late_rows, run_stream_psi
from foldwise.streaming.parity import looked_up, run_stream_parity, stream_source


def _write_events(spark, n_days=5, per_day=50):
    folder = os.path.join(checkpoint_dir(spark), "ev-" + uuid.uuid4().hex)
    base = dt.datetime(2024, 1, 1)
    rows = [(d * per_day + i, base + dt.timedelta(days=d, minutes=10 * i), "a" if i % 3 else "b",
             float(i + (5 * d if d >= 3 else 0))) for d in range(n_days) for i in range(per_day)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    df.coalesce(1).write.parquet(folder)
    return folder, spark.read.parquet(folder)


def test_stream_psi_emits_closed_windows_only(spark):
    folder, e = _write_events(spark)
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    ref = e.where(day == F.lit("2024-01-01").cast("timestamp")).select("event_id", "value")
    edges = st.bin_edges(ref, "value", "event_id")
    ref_counts = st.with_bins(ref, edges, "value").groupBy("bin").agg(F.count(F.lit(1)).alias("ref_n"))
    out = run_stream_psi(stream_source(spark, folder), "ts", "value", edges, ref_counts).toPandas()
    assert len(out) == 4  # the last day never closes in append mode
    by_day = out.sort_values("window_start")["psi"].tolist()
    assert by_day[0] < 1e-9 and by_day[-1] > by_day[1]


def test_missing_values_and_late_rows(spark):
    folder, e = _write_events(spark)
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    ref = e.where(day == F.lit("2024-01-01").cast("timestamp")).select("event_id", "value")
    edges = st.bin_edges(ref, "value", "event_id")
    ref_counts = st.with_bins(ref, edges, "value").groupBy("bin").agg(F.count(F.lit(1)).alias("ref_n"))
    work = os.path.join(folder, "_work")
    first = run_stream_psi(stream_source(spark, folder), "ts", "value", edges, ref_counts, work_dir=work).toPandas()
    assert late_rows(spark, work).first().asDict() == {"entered": 250, "emitted": 200, "open": 50, "late": 0}
    base = dt.datetime(2024, 1, 1)
    more = [(900 + i, base + dt.timedelta(days=d), "a", v) for i, (d, v) in enumerate([(0, 1.0), (1, 2.0), (1, float("nan")), (2, None), (4.5, 3.0), (4.6, float("nan"))])]
    spark.createDataFrame(more, e.schema).coalesce(1).write.mode("append").parquet(folder)
    again = run_stream_psi(stream_source(spark, folder), "ts", "value", edges, ref_counts, work_dir=work)
    assert again.count() == len(first) == 4 and again.agg(F.sum("rows")).first()[0] == 200
    assert late_rows(spark, work).first().asDict() == {"entered": 253, "emitted": 200, "open": 51, "late": 2}


def _pairs(spark, tmp_path, online, offline, kind):
    ids = f"row_id long, t timestamp, {kind}"
    out = []
    for name, rows in (("online", online), ("offline", offline)):
        path = f"{tmp_path}/{name}"
        if rows:
            spark.createDataFrame(rows, ids.replace(kind, f"{name} {kind}")).coalesce(1).write.mode("append").parquet(path)
        out.append(stream_source(spark, path))
    return out


def test_stream_parity_pairs_rows_across_restarts(spark, tmp_path):
    """Values arrive on either side first; a row that stays alone goes out when its state expires."""
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    work = f"{tmp_path}/work"
    on, off = _pairs(spark, tmp_path, [(1, t(0), "x"), (2, t(1), "y"), (3, t(1), None)], [(1, t(0), "x"), (4, t(1), "only")], "string")
    got = run_stream_parity(on, off, "row_id", "t", expiry="2 hours", work_dir=work)
    assert {(r["row_id"], r["status"]) for r in got.collect()} == {(1, "matched")}
    on, off = _pairs(spark, tmp_path, [(5, t(50), "z")], [(2, t(1), "Y"), (3, t(1), None), (6, t(50), "z")], "string")
    got = run_stream_parity(on, off, "row_id", "t", expiry="2 hours", work_dir=work)
    want = {(1, "matched"), (2, "mismatch"), (3, "matched"), (4, "only_offline")}
    assert {(r["row_id"], r["status"]) for r in got.collect()} == want
    on, off = _pairs(spark, tmp_path, [(7, t(90), "q")], [(7, t(90), "q")], "string")
    got = run_stream_parity(on, off, "row_id", "t", expiry="2 hours", work_dir=work)
    assert {(r["row_id"], r["status"]) for r in got.collect()} == want | {(7, "matched"), (5, "only_online"), (6, "only_offline")}


def test_stream_parity_of_booleans_and_numbers(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    on, off = _pairs(spark, tmp_path / "b", [(1, t, True), (2, t, None), (3, t, False)], [(1, t, True), (2, t, None), (3, t, True)], "boolean")
    got = {r["row_id"]: r["status"] for r in run_stream_parity(on, off, "row_id", "t").collect()}
    assert got == {1: "matched", 2: "matched", 3: "mismatch"}
    nan = float("nan")
    on, off = _pairs(spark, tmp_path / "d", [(1, t, 1.0), (2, t, nan), (3, t, 1.0)], [(1, t, 1.0 + 1e-13), (2, t, None), (3, t, 1.1)], "double")
    got = {r["row_id"]: r["status"] for r in run_stream_parity(on, off, "row_id", "t").collect()}
    assert got == {1: "matched", 2: "matched", 3: "mismatch"}


def test_stream_parity_matches_batch(spark):
    folder, e = _write_events(spark)
    f = fx.GroupStat(name="offline", key="event_type", value="value", default="global")
    params = f.fit(e)
    offline = f.transform(e.select("event_id", "event_type"), params).join(e.select("event_id", "ts"), "event_id")
    offline.write.parquet(folder + "-offline")
    online = looked_up(stream_source(spark, folder), "event_type", params)
    d = run_stream_parity(online, stream_source(spark, folder + "-offline"), "event_id", "ts")
    assert {r["status"]: r["count"] for r in d.groupBy("status").count().collect()} == {"matched": 250}
