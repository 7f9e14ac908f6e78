"""Holdout splits, stratified folds, time windows and replay batches (SPL1-4, WIN1-2,
SRT6). Every assignment is a pure function of (row id, seed) or of the stable
(time, row id) order, computed with the distributed rank, never a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import TWO_POW_32, h
from foldwise.operators.rank import dist_rank

DEV, HOLDOUT = "dev", "holdout"


def holdout_temporal(df: DataFrame, time_col: str, id_col: str, fraction: float,
                     split_col: str = "split") -> DataFrame:
    """Last ``fraction`` of rows by stable (time, id) order are holdout (SPL1). The cut
    is ``round(n * (1 - fraction))`` half-to-even, as Python's ``round``."""
    r = dist_rank(df, [time_col, id_col], rank_col="_tr", total_col="_tn")
    cutoff = F.bround(F.col("_tn") * F.lit(1.0 - fraction), 0)
    return (r.withColumn(split_col, F.when(F.col("_tr") <= cutoff, F.lit(DEV)).otherwise(F.lit(HOLDOUT)))
            .drop("_tr", "_tn"))


def stratified_assign(df: DataFrame, id_col: str, y_col: str, seed: int = 42,
                      holdout_fraction: float | None = 0.15, k: int | None = 5,
                      split_col: str = "split", fold_col: str = "fold") -> DataFrame:
    """Stratified holdout (SPL2) and stratified k folds over the dev rows (SPL3) from
    one per-class rank by (h(id, seed), id).

    Within each class the first ``round(n_c * fraction)`` rows in hash order are
    holdout; the remaining dev rows get ``fold = (dev_rank - 1) % k``, so each dev row
    is validated exactly once and class counts per fold differ by at most one."""
    hashed = df.withColumn("_h", h(id_col, seed))
    r = dist_rank(hashed, ["_h", id_col], by=[y_col], rank_col="_cr", total_col="_cn",
                  uniform_max=TWO_POW_32)
    frac = float(holdout_fraction or 0.0)
    n_hold = F.bround(F.col("_cn") * F.lit(frac), 0).cast("bigint")
    out = r.withColumn("_nh", n_hold)
    if holdout_fraction is not None:
        out = out.withColumn(split_col, F.when(F.col("_cr") <= F.col("_nh"), F.lit(HOLDOUT))
                             .otherwise(F.lit(DEV)))
    if k is not None:
        out = out.withColumn(fold_col, F.when(F.col("_cr") > F.col("_nh"),
                                              ((F.col("_cr") - F.col("_nh") - 1) % k).cast("int")))
    return out.drop("_h", "_cr", "_cn", "_nh")


def fold_audit(df: DataFrame, id_col: str, y_col: str, k: int, fold_col: str = "fold") -> DataFrame:
    """SPL4: every dev row is a validation row exactly once (one fold in [0, k), id
    unique) and so a training row k-1 times; per class, fold sizes differ by at most
    one. One shuffle by id (no k-fold row expansion). One row out."""
    dev = df.where(F.col(fold_col).isNotNull())
    per_id = dev.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"),
                                     F.min(F.col(fold_col).between(0, k - 1)).alias("_ok"))
    once = per_id.agg(F.sum("_n").cast("bigint").alias("n_rows"),
                      F.count_if((F.col("_n") == 1) & F.col("_ok")).alias("n_assigned_once"))
    sizes = dev.groupBy(y_col, fold_col).count()
    gap = sizes.groupBy(y_col).agg((F.max("count") - F.min("count")).alias("_gap")) \
        .agg(F.max("_gap").cast("bigint").alias("max_class_gap"))
    return once.crossJoin(gap)  # 1 x 1 rows


def ntile_index(rank: Column, n_rows: Column, n: int) -> Column:
    """0-based ``ntile(n)`` / ``array_split`` window of a 1-based rank: the first
    ``N % n`` windows hold one extra row (WIN1, T14)."""
    q = F.floor(n_rows / F.lit(n))
    rem = n_rows % F.lit(n)
    big = (q + 1) * rem
    return F.when(rank <= big, F.floor((rank - 1) / (q + 1))) \
        .otherwise(rem + F.floor((rank - 1 - big) / q)).cast("int")


def time_windows(df: DataFrame, time_col: str, id_col: str, n: int,
                 window_col: str = "window") -> DataFrame:
    r = dist_rank(df, [time_col, id_col], rank_col="_wr", total_col="_wn")
    return r.withColumn(window_col, ntile_index(F.col("_wr"), F.col("_wn"), n)).drop("_wr", "_wn")


def sample_positions(n_rows: Column, max_rows: int) -> Column:
    """SRT6: array of at most ``max_rows`` evenly spread positions ``int(i * n / m)``
    (all positions when n <= m), as a Column of ``array<bigint>``."""
    m = F.lit(max_rows)
    all_pos = F.sequence(F.lit(0).cast("bigint"), (n_rows - 1).cast("bigint"))
    step = n_rows.cast("double") / m.cast("double")
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1),
                                          lambda i: F.floor(i * step).cast("bigint")))
    return F.when(n_rows <= m, all_pos).otherwise(F.array_sort(spread))
