"""Online/offline parity replay (PAR1, PAR2, PAR4, UDF2, UDF3, JOIN7, FN3, SRT4, F8, F9; PAR3 is in ``scan``).

A feature's ``transform`` must be a pure row-wise function of its own rows and params.
The replay re-runs the transform on small, isolated row subsets ("jobs": batches of a
shuffled or time-ordered replay) and diffs every row with the offline value.

``transform_many`` is the batching engine: rows are hash-partitioned by job id and
sorted by (job, position) inside partitions, then one ``mapInPandas`` walks the Arrow
batches, calls the pandas transform once per complete job, and carries the last, still
open job over to the next Arrow batch. Thousands of tiny jobs thus cost one Python
worker pass instead of one task per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.hashing import TWO_POW_32, h
from foldwise.functions.scalar import known, same_value
from foldwise.operators.rank import dist_rank
from foldwise.operators.scan import MAX_TRUNCATED_POSITIONS, RowState, mean_of_call, rank_of_call, row_only, running_sum, truncated_replay
from foldwise.session import materialize

# Fixed values of the replay.
IID_BATCH_SIZES = [1, 5, 37]
TEMPORAL_BATCH_SIZES = [1, 50, 500]
MAX_MISMATCH_EXAMPLES = 10


@dataclass
class PandasFeature:
    """UDF3: vectorised transform ``fn(pdf) -> Series`` over the call's rows. ``grouped``,
    when given, computes the same values for many jobs at once
    (``grouped(pdf, job_cols) -> Series``), which keeps one-row jobs cheap. ``state`` is what
    the truncated replay folds the rows into (``scan``)."""

    name: str
    required_columns: tuple[str, ...]
    fn: Callable[[pd.DataFrame], pd.Series]
    grouped: Callable[[pd.DataFrame, list[str]], pd.Series] | None = None
    output_type: str = "double"
    state: RowState | None = None


def replay_order(df: DataFrame, id_col: str, time_col: str | None = None, seed: int = 0) -> DataFrame:
    """0-based replay position: shuffled by ``h(id, seed)`` (PAR1) or stable time order
    (PAR2, SRT5)."""
    if time_col is None:
        hashed = df.withColumn("_ord", h(id_col, seed))
        r = dist_rank(hashed, ["_ord", id_col], rank_col="_p", uniform_max=TWO_POW_32).drop("_ord")
    else:
        r = dist_rank(df, [time_col, id_col], rank_col="_p")
    return r.withColumn("pos", F.col("_p") - 1).drop("_p")


def assign_batches(ordered: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """WIN2/SET3: one row per (row, batch size) with ``batch = pos div size``."""
    size = F.explode(F.array(*[F.lit(int(s)) for s in sizes])).alias("batch_size")
    return (ordered.select("*", size)
            .withColumn("batch", F.floor(F.col("pos") / F.col("batch_size")).cast("bigint")))


def transform_many(rows: DataFrame, feature: PandasFeature, id_col: str, job_cols: Sequence[str],
                   order_col: str = "pos", extra_cols: Sequence[str] = (),
                   n_parts: int | None = None, outputs: Sequence[str] = ("value",)) -> DataFrame:
    """UDF2: run ``feature`` separately on every job (rows sharing ``job_cols``), in
    ``order_col`` order inside each job. Returns (id, job_cols..., extra..., value); with several ``outputs``
    the feature gives a frame of as many columns."""
    from foldwise.session import ship_package
    ship_package(rows.sparkSession)
    job_cols = list(job_cols)
    keep = list(dict.fromkeys([id_col, *job_cols, order_col, *extra_cols, *feature.required_columns]))
    n_parts = n_parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = rows.select(*keep).repartition(n_parts, *job_cols).sortWithinPartitions(*job_cols, order_col)
    out_fields = [f for f in part.schema.fields if f.name in [id_col, *job_cols, *extra_cols]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_fields)
    schema += "".join(f", `{o}` {feature.output_type}" for o in outputs)
    out_names = [f.name for f in out_fields]
    fn, grouped = feature.fn, feature.grouped

    def run_jobs(pdf: pd.DataFrame) -> pd.DataFrame:
        if grouped is not None:
            vals = grouped(pdf, job_cols)
        else:
            parts = []
            for _, g in pdf.groupby(job_cols, sort=False):
                parts.append(fn(g.reset_index(drop=True)).set_axis(g.index))
            vals = pd.concat(parts) if parts else pd.Series(dtype="float64")
        res = pdf[out_names].copy()
        vals = (vals.to_frame() if isinstance(vals, pd.Series) else vals).reindex(pdf.index)
        for i, o in enumerate(outputs):
            res[o] = vals.iloc[:, i].to_numpy()
        return res

    def per_partition(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for pdf in it:
            if carry is not None and len(carry):
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf[job_cols].iloc[-1]
            open_mask = (pdf[job_cols] == last.values).all(axis=1)
            done, carry = pdf[~open_mask], pdf[open_mask].reset_index(drop=True)
            if len(done):
                yield run_jobs(done.reset_index(drop=True))
        if carry is not None and len(carry):
            yield run_jobs(carry)

    return part.mapInPandas(per_partition, schema)


def compare(offline: DataFrame, online: DataFrame, id_col: str, offline_col: str = "offline",
            online_col: str = "value") -> DataFrame:
    """JOIN7 + FN3: join offline and online values by row id; ``matched`` uses
    isclose(rtol=1e-9, atol=1e-12) for numbers and equality for text and booleans, missing
    == missing; ``abs_diff`` when both are numbers."""
    j = online.join(offline.select(id_col, offline_col), id_col, "inner")
    numeric = all(isinstance(j.schema[c].dataType, T.NumericType) for c in (offline_col, online_col))
    diff = F.abs(known(j, offline_col) - known(j, online_col)) if numeric else F.lit(None).cast("double")
    return j.withColumns({"matched": same_value(j, offline_col, online_col), "abs_diff": diff})


def summarize(diffs: DataFrame, by: Sequence[str] = ("batch_size",)) -> DataFrame:
    """PAR4: rows checked, mismatches, max abs diff per group."""
    return diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_checked"),
                                  F.count_if(~F.col("matched")).alias("n_mismatch"),
                                  F.max("abs_diff").alias("max_abs_diff"))


def examples(diffs: DataFrame, id_col: str, k: int = MAX_MISMATCH_EXAMPLES) -> DataFrame:
    """SRT4: the first k mismatches by (batch size, replay position)."""
    return (diffs.where(~F.col("matched"))
            .orderBy("batch_size", "pos", id_col).limit(k))


def replay(df: DataFrame, feature: PandasFeature, offline: DataFrame, id_col: str,
           time_col: str | None = None, sizes: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """PAR1 (iid, shuffled) / PAR2 (time order) batch replay; returns per-row diffs."""
    sizes = sizes or (TEMPORAL_BATCH_SIZES if time_col else IID_BATCH_SIZES)
    batches = assign_batches(replay_order(df, id_col, time_col, seed), sizes)
    online = transform_many(batches, feature, id_col, ["batch_size", "batch"], "pos", extra_cols=["pos"])
    return compare(offline, online, id_col)


def together(features: Sequence[PandasFeature]) -> PandasFeature:
    """Features of numbers as one that gives a frame with a column for each: a replay runs them all in one pass."""
    columns = tuple(dict.fromkeys(c for f in features for c in f.required_columns))
    stack = lambda series, index: pd.DataFrame({i: s.astype("float64") for i, s in enumerate(series)}, index=index)

    def fn(pdf: pd.DataFrame) -> pd.Series:
        return stack([f.fn(pdf) for f in features], pdf.index)

    def grouped(pdf: pd.DataFrame, job_cols: list[str]) -> pd.Series:
        return stack([f.grouped(pdf, job_cols) for f in features], pdf.index)

    return PandasFeature("together", columns, fn, grouped if all(f.grouped for f in features) else None)


def replay_all(df: DataFrame, features: Sequence[PandasFeature], offline: DataFrame, id_col: str, time_col: str | None = None,
               sizes: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """PAR1/PAR2 of several features of numbers in one pass: ``(feature, n_checked, n_mismatch, max_abs_diff)``; ``offline``
    has a column by each feature's name. The offline values travel with the rows, so where ``offline`` is ``df`` itself nothing
    is joined."""
    sizes, numbers = sizes or (TEMPORAL_BATCH_SIZES if time_col else IID_BATCH_SIZES), range(len(features))
    expected = [F.col(f.name).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    rows = df.select("*", *expected) if offline is df else df.join(offline.select(id_col, *expected), id_col)
    batches = assign_batches(replay_order(rows, id_col, time_col, seed), sizes)
    j = transform_many(batches, together(features), id_col, ["batch_size", "batch"], "pos", extra_cols=[f"_f{i}" for i in numbers], outputs=[f"_n{i}" for i in numbers])
    counts = j.agg(F.count(F.lit(1)).alias("n_checked"), *[F.count_if(~same_value(j, f"_f{i}", f"_n{i}")).alias(f"m{i}") for i in numbers],
                   *[F.max(F.abs(known(j, f"_f{i}") - known(j, f"_n{i}"))).alias(f"d{i}") for i in numbers])
    each = [F.struct(F.lit(f.name).alias("feature"), "n_checked", F.col(f"m{i}").alias("n_mismatch"), F.col(f"d{i}").alias("max_abs_diff")) for i, f in enumerate(features)]
    return counts.where("n_checked > 0").select(F.inline(F.array(*each)))


def temporal_replay(df: DataFrame, feature: PandasFeature, offline: DataFrame, id_col: str, time_col: str,
                    sizes: Sequence[int] | None = None, max_positions: int = MAX_TRUNCATED_POSITIONS) -> DataFrame:
    """PAR2 and PAR3 as one check: ``(feature, n_checked, n_mismatch, max_abs_diff)`` over the batches of the time
    order and the truncated positions."""
    batches = replay(df, feature, offline, id_col, time_col, sizes)
    seen = compare(offline, truncated_replay(df, feature, id_col, time_col, max_positions), id_col)
    both = batches.select("matched", "abs_diff").unionByName(seen.select("matched", "abs_diff"))
    return summarize(both.withColumn("feature", F.lit(feature.name)), by=["feature"])


# ----------------------------------------------------------------------------------
# features used by the replay checks


def join_params(df: DataFrame, params: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the looked-up value of its key (``_<name>_value``) and the default (``_<name>_default``) of a
    ``(key, value)`` params table whose null key holds the default. The table joins in Spark at any size."""
    known_keys = params.where("key IS NOT NULL").select(F.col("key").alias("_key"), F.col("value").alias(f"_{name}_value"))
    default = params.where("key IS NULL").agg(F.max("value").alias(f"_{name}_default"))  # one row
    return df.join(known_keys, df[key] == known_keys["_key"], "left").drop("_key").crossJoin(default)


def lookup_feature(name: str, output_type: str = "double") -> PandasFeature:
    """Compliant: a row's looked-up value, else the default (rows of ``join_params``)."""
    value, default = f"_{name}_value", f"_{name}_default"

    def fn(pdf: pd.DataFrame) -> pd.Series:
        return pdf[value].where(pdf[value].notna(), pdf[default])

    return PandasFeature(name, (value, default), fn, lambda pdf, job_cols: fn(pdf), output_type, row_only(fn))


def row_feature(name: str, columns: Sequence[str], fn: Callable[[pd.DataFrame], pd.Series]) -> PandasFeature:
    """Compliant: a function of the row's own columns."""
    return PandasFeature(name, tuple(columns), fn, lambda pdf, job_cols: fn(pdf), state=row_only(fn))


def rank_in_call(name: str, col: str) -> PandasFeature:
    """F8 negative control: percentile rank inside the call (average ties)."""
    def fn(pdf: pd.DataFrame) -> pd.Series:
        return pdf[col].rank(pct=True)

    def grouped(pdf: pd.DataFrame, job_cols: list[str]) -> pd.Series:
        return pdf.groupby(job_cols, sort=False)[col].rank(pct=True)
    return PandasFeature(name, (col,), fn, grouped, state=rank_of_call(col))


def cumsum_in_call(name: str, col: str) -> PandasFeature:
    """F9 negative control: running sum inside the call (rows in replay order)."""
    def fn(pdf: pd.DataFrame) -> pd.Series:
        return pdf[col].cumsum()

    def grouped(pdf: pd.DataFrame, job_cols: list[str]) -> pd.Series:
        return pdf.groupby(job_cols, sort=False)[col].cumsum()
    return PandasFeature(name, (col,), fn, grouped, state=running_sum(col))


def mean_in_call(name: str, col: str) -> PandasFeature:
    """Negative control: the mean of the call's rows."""
    def fn(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series(pdf[col].mean(), index=pdf.index)

    def grouped(pdf: pd.DataFrame, job_cols: list[str]) -> pd.Series:
        return pdf.groupby(job_cols, sort=False)[col].transform("mean")
    return PandasFeature(name, (col,), fn, grouped, state=mean_of_call(col))


def with_pct_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the whole-frame value of ``rank_in_call``: (rows below + (ties + 1) / 2) / n, from a written
    histogram and prefix sums (no global window)."""
    from foldwise.operators.rank import prefix_sums
    hist = materialize(df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("c")), "histogram")
    ps = prefix_sums(hist, "_v", ["c"], inclusive=True)
    avg_rank = (F.col("cum_c") - F.col("c")) + (F.col("c") + 1) / 2.0
    ranks = ps.select("_v", (avg_rank / F.col("c_total")).alias(out))
    return df.join(ranks, F.col(col).cast("double") == F.col("_v"), "left").drop("_v")


def offline_pct_rank(df: DataFrame, id_col: str, col: str, out: str = "offline") -> DataFrame:
    """(id, ``out``) of ``with_pct_rank``."""
    return with_pct_rank(df, col, out).select(id_col, out)


def offline_cumsum(df: DataFrame, id_col: str, time_col: str, col: str, out: str = "offline") -> DataFrame:
    """Whole-frame value of ``cumsum_in_call`` in (time, id) order via distributed rank and
    bucketed prefix sums."""
    from foldwise.operators.rank import prefix_sums
    r = dist_rank(df.select(id_col, time_col, col), [time_col, id_col], rank_col="_r")
    ps = prefix_sums(r.select(id_col, F.col("_r").cast("double").alias("_rd"), F.col(col).alias("_v")),
                     "_rd", ["_v"], inclusive=True)
    return ps.select(id_col, F.col("cum__v").alias(out))
