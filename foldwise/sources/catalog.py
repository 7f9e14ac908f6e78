"""Catalog of run records as Parquet tables in a shared folder (SRC5-SRC7, WIN6, SRT1-2,
PRJ12, JOIN8-11).

Each table holds a few key columns plus the full record as JSON text (``data``), is
partitioned by ``run_id`` (so per-run reads prune partitions) and is append-only.
"Insert or replace" tables keep every version with a write sequence number and are read
through a latest-per-key view, which survives retried writes without an update.
"""

from __future__ import annotations

import os
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.session import checkpoint_dir, materialize, path_exists

# key columns per table (the rest of a record travels in ``data``)
TABLE_KEYS = {
    "hypotheses": ["id"],
    "feature_specs": ["hypothesis_id", "codegen_attempt"],
    "validation_results": ["run_id", "feature_name", "hypothesis_id"],
    "training_metrics": ["run_id", "iteration"],
    "stability_reports": ["run_id", "iteration"],
    "feature_selection_rounds": ["run_id", "iteration"],
    "run_metadata": ["run_id"],
    "promoted_features": ["feature_name"],
}
UPSERT_TABLES = {"training_metrics", "stability_reports", "feature_selection_rounds", "run_metadata"}
PROMOTABLE = ("validated", "promoted")


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or os.path.join(checkpoint_dir(spark), "catalog")
        self._seq = int(time.time() * 1e6)

    def path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def _next_seq(self) -> int:
        self._seq += 1
        return self._seq

    def append(self, table: str, df: DataFrame) -> None:
        """SRC5: append records with the whole record as JSON (``data``), the write sequence ``seq`` and
        ``created_at``."""
        whole = df if "data" in df.columns else df.withColumn("data", F.to_json(F.struct(*df.columns)))
        out = whole.withColumn("seq", F.lit(self._next_seq()).cast("bigint")) \
            .withColumn("created_at", F.current_timestamp())
        if not path_exists(self.spark, f"{self.path(table)}/_schema"):  # what an empty table is read by
            out.limit(0).write.mode("ignore").parquet(f"{self.path(table)}/_schema")
        writer = out.write.mode("append")
        if "run_id" in out.columns:
            writer = writer.partitionBy("run_id")
        writer.parquet(self.path(table))

    def upsert(self, table: str, df: DataFrame) -> None:
        """SRC6: insert-or-replace on the table key = append a newer version."""
        self.append(table, df)

    def read(self, table: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        names = [f.getPath().getName() for f in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        empty = all(n.startswith(("_", ".")) for n in names)
        return self.spark.read.parquet(f"{self.path(table)}/_schema" if empty else self.path(table))

    def latest(self, table: str, keys: Sequence[str] | None = None) -> DataFrame:
        """WIN6: newest version per key (``row_number() over (partition by key order by
        seq desc) = 1``). Keys are record keys, so each window group is tiny."""
        keys = list(keys or TABLE_KEYS[table])
        w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
        return self.read(table).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    def current(self, table: str) -> DataFrame:
        return self.latest(table) if table in UPSERT_TABLES else self.read(table)

    def by_run(self, table: str, run_id: str, status: str | None = None) -> DataFrame:
        """PRJ12: predicate by run (partition pruning) and optionally by status."""
        df = self.current(table).where(F.col("run_id") == run_id)
        if status is not None:
            df = df.where(F.col("final_status") == status)
        return df

    def best(self, table: str, metric: str, run_id: str | None = None) -> DataFrame:
        """SRT1: ``order by metric desc limit 1``."""
        df = self.current(table)
        if run_id is not None:
            df = df.where(F.col("run_id") == run_id)
        return df.orderBy(F.col(metric).desc_nulls_last()).limit(1)

    def promote(self, candidates: DataFrame) -> DataFrame:
        """SRC7/JOIN10: candidates with ``outcome``: refused (status neither validated nor promoted),
        present (the name is promoted already, by an anti join on the primary key), superseded (an earlier
        iteration of the same name is written) or written; the written ones are appended."""
        fits = F.coalesce(F.col("final_status").isin(*PROMOTABLE), F.lit(False))
        done = self.read("promoted_features").select("feature_name").distinct() if self._exists("promoted_features") \
            else self.spark.createDataFrame([], "feature_name string")
        seen = done.select(F.col("feature_name").alias("_done"))
        order = [F.col(c).asc_nulls_last() for c in ("iteration", "run_id") if c in candidates.columns] or [F.lit(0)]
        first = F.row_number().over(Window.partitionBy("feature_name", "_fits").orderBy(*order)) == 1
        marked = candidates.withColumn("_fits", fits).join(seen, F.col("feature_name") == F.col("_done"), "left")
        outcome = F.when(~F.col("_fits"), "refused").when(F.col("_done").isNotNull(), "present").when(first, "written").otherwise("superseded")
        marked = materialize(marked.withColumn("outcome", outcome).drop("_fits", "_done"), "promotion")  # judged before it is appended
        self.append("promoted_features", marked.where("outcome = 'written'").drop("outcome"))
        return marked

    def _exists(self, table: str) -> bool:
        return path_exists(self.spark, self.path(table))

    def is_promoted(self, name: str) -> bool:
        if not self._exists("promoted_features"):
            return False
        return bool(self.read("promoted_features").where(F.col("feature_name") == name).limit(1).count())
