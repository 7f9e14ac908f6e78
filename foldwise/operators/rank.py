"""Distributed ranks, prefix sums and exact quantiles (helper X1).

A window without ``partitionBy`` moves every row into one task, so the library never
uses one on row data. Instead:

* ``dist_rank`` cuts the order key into buckets that are a pure function of the row
  (``splitters``: bounds from a bounded hash sample; a value held by so many rows that it fills several
  buckets is cut into as many pieces on the tie-breaker), numbers rows with a window partitioned by
  bucket, and adds bucket offsets from a count table of at most 2 x buckets rows a group. The offsets
  are summed in two levels, and the planner chooses how they meet the rows.
* ``prefix_sums`` runs over histograms (one row per distinct key, so no hot key can
  exist): sampled bounds split the key range into buckets, a window
  partitioned by bucket sums locally and the table of bucket totals supplies offsets.
* ``exact_quantiles`` finds the buckets that hold the wanted positions from the count table and ranks
  the rows of those alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators import splitters
from foldwise.operators.splitters import Splitters, find_splitters
from foldwise.session import materialize, shuffle_partitions

BLOCK = 1024  # buckets summed in one task of the first level
QUANTILE_ROWS = 10_000  # rows in a bucket of ``exact_quantiles``, up to ``splitters.LEAVES`` buckets


def _as_double(df: DataFrame, c: str) -> Column:
    t = dict(df.dtypes)[c]
    if t.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    if t == "date":
        return F.unix_date(F.col(c)).cast("double")
    return F.col(c).cast("double")


def is_ordinal(df: DataFrame, c: str) -> bool:
    """Whether the values of a column can be placed on a line by ``_as_double``."""
    return isinstance(df.schema[c].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))


def tie_number(df: DataFrame, tie: str) -> Column:
    """What a hot value is cut on: the tie-breaker itself, or a hash of it where it is no number or time
    (ties are then ordered by that hash, see ``order_by``)."""
    return _as_double(df, tie) if is_ordinal(df, tie) else F.xxhash64(tie).cast("double")


def order_by(df: DataFrame, order_cols: Sequence[str]) -> list[Column]:
    lead, tie = list(order_cols[:-1]), order_cols[-1]
    hashed = [] if is_ordinal(df, tie) or not lead else [tie_number(df, tie).asc_nulls_last()]
    return [*[F.col(c).asc_nulls_last() for c in lead], *hashed, F.col(tie).asc_nulls_last()]


def rank_buckets(df: DataFrame, order_cols: Sequence[str], n_buckets: int | Callable[[int], int],
                 uniform_max: float | None = None) -> DataFrame:
    """Adds ``_b1``, ``_b2``: a bucket key that is a pure function of the row's values and
    increases with the (order_cols) order. ``_b1`` cuts the leading column at sampled bounds
    (or directly, when it is a uniform hash in [0, uniform_max)). A value that fills c > 1 buckets,
    and the null group if it would fill as many, is cut into c pieces ``_b2`` on the last
    (tie-breaking) column. The c of all values add up to the buckets, so there are at most
    2 * n_buckets keys, and no bucket holds a hot group whole."""
    lead, tie = order_cols[0], order_cols[-1]
    x = _as_double(df, lead)
    if uniform_max is not None:
        out = df.withColumn("_b1", F.floor(x * F.lit(n_buckets / uniform_max)).cast("int"))
        return out.withColumn("_b2", F.lit(0))
    t = tie_number(df, tie) if len(order_cols) > 1 else None
    cut = find_splitters(df, x, n_buckets, t)
    out = cut.assign(df, x, "_b1")
    if cut.hot is None or t is None:
        return out.withColumn("_b2", F.lit(0))
    value = F.when(~F.isnan(x), x)  # NaN lies in the bucket of nulls and is cut like them
    out = out.join(F.broadcast(cut.hot), value.eqNullSafe(F.col("_hv")), "left")  # at most n_buckets / 2 rows
    finer = find_splitters(out.where("_hc IS NOT NULL"), t, cut.pieces) if cut.pieces > splitters.LEAVES else Splitters(cut.ties)
    out = finer.assign(out, t, "_bt")
    place = F.least(F.floor(F.col("_bt") * F.col("_hc") / F.lit((len(finer.bounds) + 1) * finer.inner)), F.col("_hc") - 1)
    after = F.when(x.isNull(), F.col("_hc") + place).otherwise(place)  # NaN sorts before null
    return out.withColumn("_b2", F.when(F.col("_hc").isNotNull(), 1 + after).otherwise(0).cast("int")).drop("_hv", "_hc", "_bt")


def bucket_offsets(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``counts`` (by, _b1, _b2, _cnt) with ``_off``, the rows of the group in earlier buckets, and
    ``_all``, the rows of the group. Blocks of buckets are summed by themselves and then offset by the
    totals of earlier blocks (buckets / BLOCK rows a group)."""
    by = list(by)
    blocks = counts.withColumn("_blk", F.floor(F.col("_b1") / BLOCK))
    inside = Window.partitionBy(*by, "_blk").orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*by, "_blk").agg(F.sum("_cnt").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_blk"]], F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"),
                           F.sum("_t").over(Window.partitionBy(*by)).alias("_all"))
    blocks = blocks.withColumn("_in", F.coalesce(F.sum("_cnt").over(inside), F.lit(0)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.col("_blk") == F.col("_k__blk"))
    return blocks.join(totals, same).select(*by, "_b1", "_b2", "_cnt", (F.col("_in") + F.col("_o")).alias("_off"), "_all")


def _with_offsets(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "_b1", "_b2"]
    o = offsets.withColumnsRenamed({c: f"_o_{c}" for c in keys})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by], (F.col("_b1") == F.col("_o__b1")) & (F.col("_b2") == F.col("_o__b2")))
    return rows.join(o, same).drop(*[f"_o_{c}" for c in keys])


def dist_rank(df: DataFrame, order_cols: Sequence[str], by: Sequence[str] = (),
              rank_col: str = "rank", total_col: str | None = None,
              n_parts: int | None = None, uniform_max: float | None = None) -> DataFrame:
    """1-based ``row_number() over (partition by by order by order_cols)`` without a
    global window. ``order_cols`` must be unique within each ``by`` group (end with a row
    id of any type; ties are ordered by a hash of ids that are no numbers); the leading column is
    numeric or a time; nulls sort last.

    Buckets are deterministic in the row values (see ``rank_buckets``), so a recomputed
    branch after executor loss, or a second branch of the same plan, sees the same
    buckets. Optionally adds ``total_col`` = rows in the row's group."""
    by, order_cols = list(by), list(order_cols)
    b = rank_buckets(df, order_cols, n_parts or shuffle_partitions(df.sparkSession), uniform_max)
    local = b.withColumn("_lr", F.row_number().over(Window.partitionBy(*by, "_b1", "_b2").orderBy(*order_by(df, order_cols))))
    # written, so that the planner knows its size and does not shuffle the rows once more for a few numbers
    offsets = materialize(bucket_offsets(b.groupBy(*by, "_b1", "_b2").agg(F.count(F.lit(1)).alias("_cnt")), by), "offsets")
    out = _with_offsets(local, offsets, by).withColumn(rank_col, (F.col("_lr") + F.col("_off")).cast("bigint"))
    if total_col:
        out = out.withColumn(total_col, F.col("_all"))
    return out.drop("_b1", "_b2", "_lr", "_off", "_cnt", *([] if total_col == "_all" else ["_all"]))


def prefix_sums(hist: DataFrame, order_col: str, sum_cols: Sequence[str], by: Sequence[str] = (),
                inclusive: bool = True, n_buckets: int | None = None,
                total_suffix: str = "_total") -> DataFrame:
    """Running sums of ``sum_cols`` in ``order_col`` order within ``by`` groups.

    ``hist`` must hold one row per (by, order_col) (a histogram), so buckets cannot be
    skewed by repeated keys. Adds ``cum_<c>`` (inclusive or strictly-before) and
    ``<c>_total`` per group."""
    by = list(by)
    n_buckets = n_buckets or shuffle_partitions(hist.sparkSession)
    x = F.col(order_col).cast("double")
    b = find_splitters(hist, x, n_buckets, also=[F.col(c) for c in by]).assign(hist, x, "_bkt")
    frame_end = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy(*by, "_bkt").orderBy(order_col)
               .rowsBetween(Window.unboundedPreceding, frame_end))
    for c in sum_cols:
        b = b.withColumn(f"_lc_{c}", F.coalesce(F.sum(c).over(w_local), F.lit(0)))
    tot = b.groupBy(*by, "_bkt").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    w_b = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    for c in sum_cols:
        tot = (tot.withColumn(f"_bo_{c}", F.coalesce(F.sum(f"_bt_{c}").over(w_b), F.lit(0)))
               .withColumn(f"{c}{total_suffix}", F.sum(f"_bt_{c}").over(w_all)))
    tot = tot.drop(*[f"_bt_{c}" for c in sum_cols])
    ren = {c: f"_t_{c}" for c in [*by, "_bkt"]}
    t = materialize(tot.withColumnsRenamed(ren), "totals")  # at most groups x n_buckets rows; the planner chooses the join by their size
    cond = F.col("_bkt") == F.col("_t__bkt")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    out = b.join(t, cond, "inner")
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_lc_{c}") + F.col(f"_bo_{c}"))
    drop = ["_bkt", *ren.values(), *[f"_lc_{c}" for c in sum_cols], *[f"_bo_{c}" for c in sum_cols]]
    return out.drop(*drop)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], id_col: str,
                    by: Sequence[str] = (), prob_col: str = "prob",
                    out_col: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles ((n-1)*p positions, pandas / ``quantile_cont``)
    of ``value_col`` per ``by`` group. The count table of the buckets says which of them hold the wanted
    positions; only their rows are sorted and numbered, so many rows are cut into more buckets than there are shuffle
    partitions: few of them are wanted. Nulls and NaN are skipped. One row per (by, prob)."""
    by = list(by)
    x = F.col(value_col)
    there = x.isNotNull() & ~F.isnan(x) if isinstance(df.schema[value_col].dataType, (T.DoubleType, T.FloatType)) else x.isNotNull()
    clean = df.select(*by, value_col, id_col).where(there)
    parts = shuffle_partitions(df.sparkSession)
    cut = rank_buckets(clean, [value_col, id_col], lambda n: max(parts, min(splitters.LEAVES, n // QUANTILE_ROWS)))
    offsets = materialize(bucket_offsets(cut.groupBy(*by, "_b1", "_b2").agg(F.count(F.lit(1)).alias("_cnt")), by), "offsets")
    levels = F.inline(F.array(*[F.struct(F.lit(i).alias("_qi"), F.lit(float(q)).alias(prob_col)) for i, q in enumerate(probs)]))
    need = offsets.select(*by, "_all").distinct().select(*by, "_all", levels).withColumn("_pos", (F.col("_all") - 1) * F.col(prob_col))
    need = need.withColumns({"_lo": F.floor("_pos").cast("bigint"), "_hi": F.ceil("_pos").cast("bigint")})  # groups x probs rows
    ends = need.select(*[F.col(c).alias(f"_n_{c}") for c in by], "_qi", F.inline(F.array(
        F.struct(F.lit(0).alias("_side"), F.col("_lo").alias("_k")), F.struct(F.lit(1).alias("_side"), F.col("_hi").alias("_k")))))
    groups = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in by]
    inside = (F.col("_k") >= F.col("_off")) & (F.col("_k") < F.col("_off") + F.col("_cnt"))
    wanted = materialize(offsets.join(F.broadcast(ends), reduce(and_, groups, inside)).select(*by, "_b1", "_b2", "_off", "_qi", "_side", "_k"), "wanted")
    some = _with_offsets(cut, wanted.select(*by, "_b1", "_b2", "_off").distinct(), by)
    ranked = some.withColumn("_r", F.col("_off") + F.row_number().over(Window.partitionBy(*by, "_b1", "_b2").orderBy(*order_by(clean, [value_col, id_col]))) - 1)
    picks = wanted.select(*[F.col(c).alias(f"_n_{c}") for c in by], "_qi", "_side", F.col("_k").alias("_r2"))
    hit = ranked.join(F.broadcast(picks), reduce(and_, groups, F.col("_r") == F.col("_r2")))  # groups x probs x 2 rows
    vals = hit.groupBy(*by, "_qi").agg(F.max(F.when(F.col("_side") == 0, x)).alias("_vlo"), F.max(F.when(F.col("_side") == 1, x)).alias("_vhi"))
    v = vals.withColumnsRenamed({c: f"_v_{c}" for c in [*by, "_qi"]})
    out = need.join(v, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in by], F.col("_qi") == F.col("_v__qi")))
    q = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_pos") - F.col("_lo"))
    return out.select(*by, F.col("_qi").alias("q_index"), prob_col, q.alias(out_col))
