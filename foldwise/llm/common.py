"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import checkpoint_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` also changes other scripts)."""
    return F.translate(col, UPPER, UPPER.lower())


def id_remainder(col: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; it goes when the session's
    JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_up_to(written: DataFrame, rows: int) -> DataFrame:
    """``written`` (a written table of narrow rows) marked for a broadcast, if it has at most ``rows``
    rows; else as it is, for a shuffle join."""
    return F.broadcast(written) if written.count() <= rows else written


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for ``path``, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


BATCH_ROWS = 500
_ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, and hand texts over in Arrow batches of at most
    ``BATCH_ROWS`` rows: documents are kilobytes each, and the default of 10,000 of them is held several
    times over on either side."""
    ship_package(spark)
    rows = int(spark.conf.get(_ROWS_PER_BATCH))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_ROWS_PER_BATCH, str(BATCH_ROWS))
