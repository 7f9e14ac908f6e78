"""Streaming parity (STR1): online and offline values are two streams of rows, paired by id as both arrive.

A stream-stream full outer join keeps each side's rows as keyed state until their partner comes or both
streams are ``expiry`` past their time; then a row goes out alone, and its state is dropped. So a
micro-batch works on its own rows and the open ones, whatever the size of the offline table, and what is
kept is bounded by the expiry. The pairs are compared in the stream and written by an exactly-once file sink;
a restarted query goes on from its checkpoint with the rows it still holds."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import same_value
from foldwise.session import checkpoint_dir


def stream_source(spark: SparkSession, folder: str, file_glob: str = "*.parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the Parquet files of ``folder`` matching ``file_glob`` (new
    files are picked up as they land), with the schema of the files present now. A micro-batch takes
    all new files, unless ``max_files_per_trigger`` is given."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return (reader if max_files_per_trigger is None else reader.option("maxFilesPerTrigger", max_files_per_trigger)).parquet(folder)


def looked_up(stream: DataFrame, key_col: str, params: DataFrame, out: str = "online") -> DataFrame:
    """The serving transform on a stream: ``key -> value`` params (default on the null key) as ``out``."""
    keyed = params.where(F.col("key").isNotNull()).select(F.col("key").alias("_pk"), F.col("value").alias("_pv"))
    dflt = params.where(F.col("key").isNull()).select(F.col("value").alias("_pd"))
    # params are one row per key; the planner broadcasts them only if they are small
    return (stream.join(keyed, F.col(key_col) == F.col("_pk"), "left").crossJoin(F.broadcast(dflt))
            .withColumn(out, F.coalesce(F.col("_pv"), F.col("_pd"))).drop("_pk", "_pv", "_pd"))


def run_stream_parity(online: DataFrame, offline: DataFrame, id_col: str, time_col: str, online_col: str = "online", offline_col: str = "offline",
                      expiry: str = "1 day", apart: str = "0 seconds", work_dir: str | None = None) -> DataFrame:
    """Pairs rows of the streams ``online`` (id, time, value) and ``offline`` (id, time, value) whose times are at most ``apart``
    from each other, and returns the table so far: (id, offline, online, status), status ``matched``, ``mismatch``,
    ``only_online`` or ``only_offline``. Values of any type compare as in ``parity.compare``. A row waits for its partner until
    both streams are ``expiry`` past its time; then it is written alone, and what comes still later is dropped."""
    spark = online.sparkSession
    work_dir = work_dir or os.path.join(checkpoint_dir(spark), "stream-parity-" + uuid.uuid4().hex)
    sink, ckpt = os.path.join(work_dir, "diffs"), os.path.join(work_dir, "_checkpoint")
    side = lambda df, value, p: df.select(F.col(id_col).alias(f"_{p}id"), F.col(time_col).cast("timestamp").alias(f"_{p}t"), F.col(value).alias(value),
                                          F.lit(True).alias(f"_{p}here")).withWatermark(f"_{p}t", expiry)
    gap = F.expr(f"INTERVAL {apart}")
    on, off = side(online, online_col, "n"), side(offline, offline_col, "f")
    near = (F.col("_nid") == F.col("_fid")) & (F.col("_nt") >= F.col("_ft") - gap) & (F.col("_nt") <= F.col("_ft") + gap)
    pairs = on.join(off, near, "full_outer")
    status = (F.when(F.col("_nhere").isNull(), "only_offline").when(F.col("_fhere").isNull(), "only_online")
              .when(same_value(pairs, offline_col, online_col), "matched").otherwise("mismatch"))
    out = pairs.select(F.coalesce("_nid", "_fid").alias(id_col), F.col(offline_col), F.col(online_col), status.alias("status"))
    q = (out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
