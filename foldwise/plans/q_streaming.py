"""Queries: Structured Streaming parity and drift (STR1, STR2)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from foldwise.operators import features as fx
from foldwise.operators import stability as st
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import edges_cte, psi_sql
from foldwise.session import checkpoint_dir, materialize
from foldwise.sources.tables import table
from foldwise.streaming.drift import late_rows, run_stream_psi
from foldwise.streaming.parity import looked_up, run_stream_parity, stream_source


PARITY_SQL = """
WITH f AS (SELECT event_id, event_type, ts, avg(value) OVER (PARTITION BY event_type) AS off FROM events),
p AS (SELECT event_type, avg(value) AS onl FROM events GROUP BY event_type),
j AS (SELECT f.event_id, CASE WHEN event_id % 50 = 0 THEN off + 1 ELSE off END AS off, onl FROM f JOIN p ON f.event_type IS NOT DISTINCT FROM p.event_type),
d AS (SELECT event_id, CASE WHEN abs(off - onl) <= 1e-12 + 1e-9 * abs(onl) THEN 'matched' ELSE 'mismatch' END AS status FROM j)
"""


@register("stream_parity", PARITY_SQL + "SELECT status, count(*) AS n FROM d GROUP BY status")
def q_stream_parity(spark, sf):
    """Online values from a stream of events, offline values from a stream of the feature's table, in which every 50th
    value is off by one."""
    e = table(spark, sf, "events")
    f = fx.GroupStat(name="offline", key="event_type", value="value", default="global")
    params = materialize(f.fit(e), "params")
    offline = f.transform(e.select("event_id", "event_type"), params).join(e.select("event_id", "ts"), "event_id")
    planted = offline.withColumn("offline", F.when(F.col("event_id") % 50 == 0, F.col("offline") + 1).otherwise(F.col("offline")))
    folder = os.path.join(checkpoint_dir(spark), "offline-" + uuid.uuid4().hex)
    planted.select("event_id", "ts", "offline").write.parquet(folder)
    online = looked_up(stream_source(spark, sf, "events.parquet"), "event_type", params)
    d = run_stream_parity(online, stream_source(spark, folder), "event_id", "ts")
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


STREAM_PSI_SQL = "WITH e AS (SELECT ts, value AS x, date_trunc('day', ts) AS d FROM events WHERE value IS NOT NULL),\n" + \
    "d1 AS (SELECT * FROM e WHERE d = (SELECT min(d) FROM e)),\n" + edges_cte("ed", "d1", "x").strip() + """,
b AS (SELECT e.d, len(list_filter(ed.inner_e, lambda v: v <= e.x)) AS bin FROM e, ed),
closed AS (SELECT DISTINCT d FROM e WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)),
ref AS (SELECT bin, count(*) AS ref_n FROM b WHERE d = (SELECT min(d) FROM e) GROUP BY bin),
cur AS (SELECT d, bin, count(*) AS cur_n FROM b GROUP BY d, bin),
grid AS (SELECT closed.d, g.bin FROM closed, (SELECT unnest(range(0, CAST(n_bins AS BIGINT))) AS bin FROM ed) g),
fullg AS (SELECT grid.d, grid.bin, coalesce(ref.ref_n, 0) AS ref_n, coalesce(cur.cur_n, 0) AS cur_n FROM grid
         LEFT JOIN ref ON ref.bin = grid.bin LEFT JOIN cur ON cur.d = grid.d AND cur.bin = grid.bin),
ps AS (""" + psi_sql("fullg", ["d"]) + """)
SELECT d AS window_start, round(psi, 6) AS psi FROM ps"""


def reference(spark, sf):
    """(edges, counts) of the first day."""
    e = table(spark, sf, "events").where(F.col("value").isNotNull())
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    first = e.select(F.min(day).alias("d1"))
    ref = e.join(F.broadcast(first), day == F.col("d1")).select("event_id", "value")
    edges = st.bin_edges(ref, "value", "event_id")
    return edges, st.with_bins(ref, edges, "value").groupBy("bin").agg(F.count(F.lit(1)).alias("ref_n"))


@register("stream_psi", STREAM_PSI_SQL)
def q_stream_psi(spark, sf):
    out = run_stream_psi(stream_source(spark, sf, "events.parquet"), "ts", "value", *reference(spark, sf))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), r6("psi").alias("psi"))


@register("stream_late_rows", """
WITH a AS (SELECT * FROM events WHERE event_id % 9 <> 0), b AS (SELECT * FROM events WHERE event_id % 9 = 0),
m AS (SELECT max(ts) AS mark FROM a),
late AS (SELECT count(*) AS n FROM b, m WHERE value IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark),
m2 AS (SELECT greatest((SELECT mark FROM m), (SELECT max(ts) FROM b)) AS mark)
SELECT (SELECT count(*) FROM events WHERE value IS NOT NULL) AS entered,
  (SELECT count(*) FROM events WHERE value IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT mark FROM m2)) - (SELECT n FROM late) AS emitted,
  (SELECT count(*) FROM events WHERE value IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT mark FROM m2)) AS open,
  (SELECT n FROM late) AS late""")
def q_stream_late_rows(spark, sf):
    """Every ninth event arrives after all others: those of days that are closed by then are late, and counted."""
    e = table(spark, sf, "events")
    folder = os.path.join(checkpoint_dir(spark), "arrivals-" + uuid.uuid4().hex)
    for part in (e.where(F.col("event_id") % 9 != 0), e.where(F.col("event_id") % 9 == 0)):
        part.write.mode("append").parquet(folder)
        work = os.path.join(folder, "_work")
        run_stream_psi(stream_source(spark, folder), "ts", "value", *reference(spark, sf), work_dir=work)
    return late_rows(spark, work)
