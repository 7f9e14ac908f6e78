"""A run's checks of candidate features: coverage, single-feature AUC, serving replay (GATE1), cross-validated metrics of
the iterations' models (GATE2, REP1).

Every check is a job over the rows for all candidates together: the values of all candidates are columns of one written
frame, one aggregate counts what they cover, one histogram job gives their AUCs, one pass replays them, and
the models of all iterations are fitted in the same scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import LEAK_AUC_THRESHOLD, known
from foldwise.operators import features as fx
from foldwise.operators import parity as par
from foldwise.operators.gate import gate_status
from foldwise.operators.scoring import single_feature_auc
from foldwise.session import materialize


@dataclass
class Candidate:
    """A feature that an iteration proposes. ``feature`` gives its values (out of fold on dev rows, by the full fit on
    others); ``column``, in its place, names a column that already holds them. ``serving`` is what runs in production."""

    name: str
    iteration: int
    description: str
    kind: str
    serving: par.PandasFeature
    feature: fx.Feature | None = None
    column: str | None = None


def candidate_values(df: DataFrame, candidates: Sequence[Candidate], id_col: str, k: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """``(values, serving)``: the rows with a column of every candidate's values, and the rows with the offline value of the
    full fit and whatever the serving transforms look up."""
    dev = df.where(F.col(fold_col).isNotNull())
    stats = [c for c in candidates if isinstance(c.feature, fx.GroupStat)]
    rows = fx.oof_group_stats(df, [c.feature for c in stats], fold_col, k) if stats else df
    for c in candidates:
        if c in stats:
            rows = par.join_params(rows, materialize(c.feature.fit(dev), "params"), c.feature.key, c.name)
            full = F.coalesce(f"_{c.name}_value", f"_{c.name}_default")
            rows = rows.withColumns({f"_full_{c.name}": full, c.name: F.when(F.col(fold_col).isNull(), full).otherwise(F.col(c.name))})
        elif c.feature is not None:
            rows = c.feature.transform(rows, None)
        else:
            rows = rows.withColumn(c.name, F.col(c.column))
    rows = materialize(rows, "values")  # both frames are columns of one written table
    served = [f"_{c.name}_{part}" for c in stats for part in ("value", "default")]
    full = {c.name: f"_full_{c.name}" for c in stats}
    return rows.drop(*served, *full.values()), rows.select(*[F.col(full.get(c, c)).alias(c) for c in rows.columns if c not in full.values()])


def validate(values: DataFrame, serving: DataFrame, candidates: Sequence[Candidate], id_col: str, label: str, fold_col: str = "fold",
             time_col: str | None = None, sizes: Sequence[int] | None = None, seed: int = 0, threshold: float = LEAK_AUC_THRESHOLD) -> DataFrame:
    """``(feature_name, pos, iteration, coverage_ok, pct_missing, auc, leak_flag, n_mismatch, parity_ok, final_status)``, a row a
    candidate. Coverage: one row an id, and a value on some dev row at least."""
    names, spark = [c.name for c in candidates], values.sparkSession
    dev = values.where(F.col(fold_col).isNotNull())
    counts = dev.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"), *[F.count(known(dev, c)).alias(f"v__{c}") for c in names])
    covered = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col("n") == F.col("ids")) & (F.col(f"v__{c}") > 0)).alias("coverage_ok"),
                                                        (1 - F.try_divide(F.col(f"v__{c}").cast("double"), F.col("n"))).alias("pct_missing")) for c in names])))
    aucs = single_feature_auc(dev, names, label, id_col, threshold).withColumnRenamed("flag", "leak_flag")
    replayed = par.replay_all(serving, [c.serving for c in candidates], serving, id_col, time_col, sizes, seed).select("feature", "n_mismatch")
    order = spark.createDataFrame([(c.name, i, c.iteration) for i, c in enumerate(candidates)], "feature string, pos int, iteration int")  # names
    out = F.broadcast(order).join(covered, "feature").join(aucs, "feature").join(replayed, "feature", "left")
    out = out.withColumn("parity_ok", F.col("n_mismatch") == 0)
    return out.withColumn("final_status", gate_status(F.col("coverage_ok"), F.col("auc"), F.col("parity_ok"), threshold)).withColumnRenamed("feature", "feature_name")
