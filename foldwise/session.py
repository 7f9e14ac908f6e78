"""Session settings and the shared checkpoint folder.

Everything in the library takes a ``SparkSession`` from the caller; this module only
offers a local builder for tests/bench and a helper that resolves the checkpoint folder
from ``spark.checkpoint.dir`` (set by the cluster) before falling back to a caller
supplied one.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the library relies on. AQE is on so shuffle partition counts are re-planned
# at run time and skewed joins are split; the session time zone is pinned so timestamp
# arithmetic is identical on every executor.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "foldwise",
                  extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("FOLDWISE_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for lineage cuts and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (a cluster names a shared, durable
    folder there). Only when it is unset is ``fallback`` used and registered, which is
    what tests do with a scratch folder. A local-mode session without either gets a
    scratch folder of its own; a cluster session without the setting is an error, since
    a machine-local folder is not visible to other executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        import tempfile
        fallback = tempfile.mkdtemp(prefix="foldwise-ckpt-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in whatever store it is; other errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def materialize(df, name: str = "table"):
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and continue
    from the written copy: later branches read it (with column pruning, filter pushdown
    and real size statistics for the planner) instead of recomputing the lineage, plans
    stay small, and a lost executor costs a re-read, not a recomputation."""
    import os
    import uuid
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)  # goes with the session's JVM
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 * 2**20) -> dict:
    """Settings sized to the data: shuffle partitions so that a shuffle partition holds
    about ``target_partition_bytes`` (at least two waves of tasks), file splits of the
    same size, AQE advisory size and skew thresholds derived from it, and a broadcast
    threshold that keeps broadcast sides well inside executor memory. The rank and
    prefix-sum helpers use the shuffle partition count as their bucket count."""
    import math
    slots = max(1, executors * cores_per_executor)
    parts = max(2 * slots, math.ceil(input_bytes / target_partition_bytes))
    mb = target_partition_bytes // 2**20
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": f"{mb}m",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * mb}m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    }


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make this package importable in the Python workers of any master: it is zipped once for each
    application and added with ``addPyFile`` (the archive stays, since the driver serves it)."""
    import os
    import tempfile
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in sorted(os.walk(package)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
