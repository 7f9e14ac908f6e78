"""Feature store: computed feature columns as Parquet files bucketed and sorted by the row id, one folder a
(run, feature) in the shared folder (SRC3, SRC4, JOIN5).

All columns of a store share one bucket layout (the number is written beside them once), so any number of
saved columns are bound to each other, or to a saved frame, without a shuffle: the planner reads bucket by bucket.
Spark knows a layout only for tables of its catalog, so a feature is registered there under a name made of its
path, with its files outside; a later session registers it again from the files. A load opens one folder, a save
replaces one."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import UNSAFE_NAME_PATTERN
from foldwise.session import checkpoint_dir, path_exists, shuffle_partitions

_UNSAFE = re.compile(UNSAFE_NAME_PATTERN)


def safe_name(name: str) -> str:
    return _UNSAFE.sub("_", name)


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        """``buckets`` counts only when the store is first written to."""
        self.spark = spark
        self.root = root or os.path.join(checkpoint_dir(spark), "feature_store")
        self._wanted = buckets

    # ------------------------------------------------------------------ layout

    def buckets(self) -> int:
        path = f"{self.root}/_layout"
        if not path_exists(self.spark, path):
            n = self._wanted or shuffle_partitions(self.spark)
            self.spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("ignore").parquet(path)
        return self.spark.read.schema("buckets int").parquet(path).first()["buckets"]

    def _path(self, run_id: str, *feature_name: str) -> str:
        return "/".join([self.root, f"run_id={safe_name(run_id)}", *[f"feature_name={safe_name(f)}" for f in feature_name]])

    def _name(self, path: str) -> str:
        return "feature_" + hashlib.sha256(path.encode()).hexdigest()[:32]

    def _write(self, frame: DataFrame, id_col: str, path: str) -> None:
        n, name = self.buckets(), self._name(path)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # files outside of the warehouse stay
        self._remove(path)
        # the shuffle is the one of the buckets, so a task writes one sorted file
        (frame.select(F.col(id_col).alias("row_id"), *[c for c in frame.columns if c != id_col]).repartition(n, "row_id")
         .write.bucketBy(n, "row_id").sortBy("row_id").format("parquet").option("path", path).saveAsTable(name))

    def _read(self, path: str) -> DataFrame:
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):
            schema = self.spark.read.parquet(path).schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') "
                           f"CLUSTERED BY (row_id) SORTED BY (row_id) INTO {self.buckets()} BUCKETS")
        return self.spark.table(name)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(p):
            fs.delete(p, True)

    # ------------------------------------------------------------------ columns

    def save(self, run_id: str, feature_name: str, values: DataFrame, id_col: str, value_col: str) -> None:
        """Replace the feature's values, ``(row_id, value)``."""
        self._write(values.select(F.col(id_col), F.col(value_col).alias("value")), id_col, self._path(run_id, feature_name))

    def load(self, run_id: str, feature_name: str) -> DataFrame:
        return self._read(self._path(run_id, feature_name))

    def save_frame(self, run_id: str, name: str, frame: DataFrame, id_col: str) -> None:
        """Keep a labelled frame in the store's layout, for ``bind``."""
        self._write(frame, id_col, f"{self.root}/run_id={safe_name(run_id)}/frame={safe_name(name)}")

    def bind(self, run_id: str, features: Sequence[str], frame: str | None = None) -> DataFrame:
        """JOIN5: the rows of ``frame`` (of the first feature, if None) with a column of each feature's values, null where it
        has none. Both sides of each join are read in the same buckets, so nothing is shuffled."""
        first, *rest = [(f, self.load(run_id, f).withColumnRenamed("value", safe_name(f))) for f in features]
        out = first[1]
        if frame is not None:
            out, rest = self._read(f"{self.root}/run_id={safe_name(run_id)}/frame={safe_name(frame)}"), [first, *rest]
        for _, values in rest:
            out = out.join(values.hint("merge"), "row_id", "left")
        return out

    def exists(self, run_id: str, feature_name: str) -> bool:
        return path_exists(self.spark, self._path(run_id, feature_name))

    def delete(self, run_id: str, feature_name: str) -> None:
        path = self._path(run_id, feature_name)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")
        self._remove(path)

    def list_features(self, run_id: str) -> DataFrame:
        """Sorted feature names of a run, from its partition folders; no data is read."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(run_id))
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        names = sorted(f.removeprefix("feature_name=") for f in folders if f.startswith("feature_name="))
        return self.spark.createDataFrame([(n,) for n in names], "feature_name string")
