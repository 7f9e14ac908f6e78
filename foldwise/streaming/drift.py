"""Streaming drift (STR2): PSI of each event-time window against a fixed reference histogram.

Rows are binned on the reference edges and counted per tumbling window with a watermark in append mode. A
window's counts of all bins are one row of state, so the PSI is an expression of that row and the stream
itself emits it when the window closes. Rows that come after their window has closed are dropped by the
watermark; how many is kept beside the windows: the rows that entered (observed by the stream), less those in
emitted windows, less those in windows still open (read from the state). The operator's own metric counts
partial aggregates, not rows, and isn't used."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import known, left_closed_bin, psi_term
from foldwise.session import checkpoint_dir, path_exists

POLL_SECONDS = 2


def run_stream_psi(stream: DataFrame, time_col: str, value_col: str, edges: DataFrame, ref_counts: DataFrame,
                   window: str = "1 day", watermark: str = "0 seconds",
                   work_dir: str | None = None) -> DataFrame:
    """``edges``: one row (inner, n_bins) of the reference; ``ref_counts``: (bin, ref_n). Returns (window_start, rows,
    psi) of the windows closed so far; a later run with the same ``work_dir`` goes on. Missing values (null and NaN)
    take no part."""
    spark = stream.sparkSession
    work_dir = work_dir or os.path.join(checkpoint_dir(spark), "stream-psi-" + uuid.uuid4().hex)
    e = edges.first()  # the reference: at most bins + 1 numbers
    bins = int(e["n_bins"])
    found = {r["bin"]: r["ref_n"] for r in ref_counts.collect()}  # a row a bin
    total = max(sum(found.values()), 1)
    inner = F.array(*[F.lit(float(v)) for v in e["inner"]]) if e["inner"] else F.array().cast("array<double>")
    ts = F.col(time_col).cast("timestamp")  # watermarks need TIMESTAMP, not TIMESTAMP_NTZ
    value = known(stream, value_col)
    rows = (stream.where(value.isNotNull()).select(ts.alias("_ts"), left_closed_bin(value, inner).alias("bin"))
            .observe("entered", F.count(F.lit(1)).alias("rows")))
    counts = rows.withWatermark("_ts", watermark).groupBy(F.window("_ts", window).alias("w")).agg(
        *[F.count_if(F.col("bin") == j).alias(f"n{j}") for j in range(bins)])
    n = sum([F.col(f"n{j}") for j in range(bins)], F.lit(0))
    psi = sum([psi_term(F.lit(found.get(j, 0) / total), F.col(f"n{j}") / F.greatest(n, F.lit(1))) for j in range(bins)], F.lit(0.0))
    emitted = counts.select(F.col("w.start").alias("window_start"), n.cast("bigint").alias("rows"), psi.alias("psi"))
    sink, ckpt = os.path.join(work_dir, "windows"), os.path.join(work_dir, "_checkpoint")
    q = (emitted.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    entered, done = {}, False
    while not done:  # the query keeps only its latest progress records
        done = q.awaitTermination(POLL_SECONDS)
        for p in q.recentProgress:
            if "entered" in (p.observedMetrics or {}):
                entered[p.batchId] = p.observedMetrics["entered"]["rows"]
    # a batch repeated after a failure is recorded under its own number again
    log = spark.createDataFrame([(int(b), int(v)) for b, v in entered.items()], "batch long, rows long")
    log.coalesce(1).write.mode("append").parquet(os.path.join(work_dir, "entered"))
    return spark.read.schema("window_start timestamp, rows long, psi double").parquet(sink)


def late_rows(spark: SparkSession, work_dir: str) -> DataFrame:
    """``(entered, emitted, open, late)`` of a ``run_stream_psi`` work folder: rows with a value that came in, that are in
    closed windows, in windows still open, and that came too late."""
    log = spark.read.parquet(os.path.join(work_dir, "entered")).groupBy("batch").agg(F.max("rows").alias("rows"))
    entered = log.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("entered"))
    sink = spark.read.schema("window_start timestamp, rows long, psi double").parquet(os.path.join(work_dir, "windows"))
    closed = sink.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("emitted"))
    ckpt = os.path.join(work_dir, "_checkpoint")
    open_ = spark.range(1).select(F.lit(0).cast("bigint").alias("open"))
    if path_exists(spark, os.path.join(ckpt, "state")):
        state = spark.read.format("statestore").load(ckpt).select("value")
        names = [f"n{j}" for j in range(len(state.schema["value"].dataType.fields))]  # a count a bin, all of one name
        state = state.select(F.col("value").cast("struct<" + ",".join(f"{n}:bigint" for n in names) + ">").alias("v"))
        open_ = state.agg(F.coalesce(F.sum(sum([F.col("v")[n] for n in names], F.lit(0))), F.lit(0)).alias("open"))
    one = entered.crossJoin(closed).crossJoin(open_)  # one row each
    return one.select("entered", "emitted", "open", (F.col("entered") - F.col("emitted") - F.col("open")).alias("late"))
