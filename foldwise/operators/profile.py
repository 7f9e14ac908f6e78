"""Profiling and target association (PROF1-PROF8, ASSOC1-ASSOC4, PRJ2-3, REP4).

Per-column statistics are computed in one wide aggregation (a single pass over the
table, partial aggregation on every executor) and reshaped to one row per column on the
1-row result. Statistics that need values rather than moments use the long form:
exact quantiles through the distributed rank, top values through a salted two-stage
top-k (no single task ever sorts a whole high-cardinality column).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.scalar import days_between, known
from foldwise.operators.longform import melt
from foldwise.operators.rank import exact_quantiles
from foldwise.operators.target import column_kind
from foldwise.session import materialize, ship_package, shuffle_partitions

# Fixed values of the profile.
QUANTILE_LEVELS = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
TOP_VALUES_LIMIT = 20
MIN_ROWS_FOR_CORRELATION = 10


def _reshape(one_row: DataFrame, cols: Sequence[str], fields: dict[str, str],
             name_col: str = "column_name") -> DataFrame:
    """Turn a 1-row wide aggregate with columns ``{stat}__{col}`` into one row per col."""
    structs = [F.struct(F.lit(c).alias(name_col),
                        *[F.col(f"`{s}__{c}`").cast(t).alias(s) for s, t in fields.items()])
               for c in cols]
    return one_row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: column_kind(f.dataType) for f in df.schema.fields}


def profile_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PROF1: n, n_missing (null or NaN), pct_missing (0 when empty)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        miss = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(F.col(c))
        aggs.append(F.count_if(miss).alias(f"n_missing__{c}"))
    share = lambda c: F.coalesce(F.try_divide(F.col(f"n_missing__{c}").cast("double"), F.col("n").cast("double")), F.lit(0.0))
    row = df.agg(*aggs).select("*", *[F.col("n").alias(f"n__{c}") for c in cols], *[share(c).alias(f"pct_missing__{c}") for c in cols])
    return _reshape(row, cols, {"n": "bigint", "n_missing": "bigint", "pct_missing": "double"})


SHORT = 32  # bytes of a value that stands for itself


def value_key(df: DataFrame, c: str) -> Column:
    """A column's value as bytes, equal for equal values only: short ones as they are, longer ones by their SHA-256 in
    hexadecimal (which is longer than any short one). Null for missing values."""
    v, kind = known(df, c), df.schema[c].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = v + F.lit(0.0).cast(kind)  # -0.0 is 0.0
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        v = F.to_json(v)
    data = v if isinstance(kind, T.BinaryType) else v.cast("string").cast("binary")
    return F.when(F.octet_length(data) <= SHORT, data).otherwise(F.sha2(data, 256).cast("binary"))


def profile_distinct(df: DataFrame, cols: Sequence[str], approx: bool = False,
                     rsd: float = 0.01) -> DataFrame:
    """PROF2: non-null distinct count and ``is_constant`` (<= 1). The (column, value) pairs of all columns are made unique
    in one shuffle, those of a task before it, so a row makes narrow pairs and no copies of itself whatever the
    number of columns. ``approx`` uses HyperLogLog++."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(known(df, c), rsd).alias(f"n_unique__{c}") for c in cols])
        row = row.select("*", *[(F.col(f"n_unique__{c}") <= 1).alias(f"is_constant__{c}") for c in cols])
        return _reshape(row, cols, {"n_unique": "bigint", "is_constant": "boolean"})
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value_key(df, c).alias("v")) for i, c in enumerate(cols)])).alias("p"))
    found = pairs.select("p.i", "p.v").where("v IS NOT NULL").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, column_name string")  # column names
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return F.broadcast(names).join(found, "i", "left").select("column_name", n.alias("n_unique"), (n <= 1).alias("is_constant"))


def profile_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PROF3: min, max, mean, sample std (0 below 2 rows), biased skew (0 below 3),
    excess kurtosis (0 below 4); an empty column is all zeros (Q4, Q5)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
        aggs += [F.count(x).alias(f"_n__{c}"), F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"),
                 F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"_std__{c}"),
                 F.skewness(x).alias(f"_skew__{c}"), F.kurtosis(x).alias(f"_kurt__{c}")]
    needs = {"min": ("min", 0), "max": ("max", 0), "mean": ("mean", 0), "std": ("_std", 1), "skew": ("_skew", 2), "kurtosis": ("_kurt", 3)}
    row = df.agg(*aggs).select(*[F.when(F.col(f"_n__{c}") > least, F.col(f"{source}__{c}")).otherwise(0.0).alias(f"{stat}__{c}")
                                 for c in cols for stat, (source, least) in needs.items()])
    return _reshape(row, cols, {s: "double" for s in ("min", "max", "mean", "std", "skew", "kurtosis")})


def profile_quantiles(df: DataFrame, cols: Sequence[str], id_col: str, approx: bool = False,
                      accuracy: int = 10000) -> DataFrame:
    """PROF4: p1, p25, p50, p75, p99 with linear interpolation. Exact by default through
    the distributed rank (no per-group value map); ``approx`` uses ``percentile_approx``
    in one wide pass."""
    names, probs = list(QUANTILE_LEVELS), list(QUANTILE_LEVELS.values())
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(f"_q__{c}")
                       for c in cols])
        row = row.select(*[F.col(f"_q__{c}")[i].alias(f"{nm}__{c}") for c in cols for i, nm in enumerate(names)])
        return _reshape(row, cols, {nm: "double" for nm in names})
    long = melt(df, [id_col], cols, feature_col="column_name")
    q = exact_quantiles(long, "value", probs, id_col, by=["column_name"])
    wide = q.groupBy("column_name").pivot("q_index", list(range(len(probs)))).agg(F.first("q"))
    return wide.select("column_name", *[F.col(str(i)).alias(nm) for i, nm in enumerate(names)])


def top_k(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
          salt_col: str | None = None, salt_buckets: int | None = None, rank_col: str = "rk") -> DataFrame:
    """Exact top-k per group in two stages: top-k inside (group, salt) sub-groups, then
    top-k of those candidates per group. A group with a huge number of rows is sorted in
    ``salt_buckets`` pieces (as many as there are shuffle partitions, unless given); the second stage
    sees at most salt_buckets * k rows."""
    group_cols = list(group_cols)
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salt_buckets or shuffle_partitions(df.sparkSession))) if salt_col else F.lit(0)
    s1 = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    cand = s1.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def value_counts(df: DataFrame, cols: Sequence[str], id_col: str | None = None) -> DataFrame:
    """``(column_name, value, n)`` for text-cast values, nulls excluded (Q21)."""
    ids = [id_col] if id_col else []
    long = melt(df.select(*ids, *cols), ids, cols, value_type="string", feature_col="column_name")
    return (long.where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def profile_top_values(df: DataFrame, cols: Sequence[str], k: int = TOP_VALUES_LIMIT) -> DataFrame:
    """PROF5/SRT3: top-k values per column by count desc, value asc."""
    vc = value_counts(df, cols)
    return top_k(vc, ["column_name"], [F.col("n").desc(), F.col("value").asc()], k, salt_col="value")


def profile_datetime(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PROF6: min, max, span in days."""
    row = df.agg(*[e for c in cols for e in (F.min(c).alias(f"min_ts__{c}"), F.max(c).alias(f"max_ts__{c}"))])
    row = row.select("*", *[days_between(F.col(f"max_ts__{c}"), F.col(f"min_ts__{c}")).alias(f"span_days__{c}") for c in cols])
    ts_type = df.schema[cols[0]].dataType.simpleString() if cols else "timestamp"
    return _reshape(row, cols, {"min_ts": ts_type, "max_ts": ts_type, "span_days": "double"})


def assoc_numeric(df: DataFrame, cols: Sequence[str], y_col: str,
                  min_rows: int = MIN_ROWS_FOR_CORRELATION) -> DataFrame:
    """ASSOC1: point-biserial correlation = Pearson corr(x, y) over complete pairs; null
    below ``min_rows`` complete rows, or when x or y has fewer than two levels. Built from
    population co-moments with ``try_divide``, so constant columns give null instead of
    raising under ANSI mode (T1)."""
    y = F.col(y_col).cast("double")
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
        xp = F.when(y.isNotNull(), x)
        yp = F.when(x.isNotNull(), y)
        aggs += [F.count(xp).alias(f"_n__{c}"), F.covar_pop(xp, yp).alias(f"_cov__{c}"),
                 F.var_pop(xp).alias(f"_vx__{c}"), F.var_pop(yp).alias(f"_vy__{c}"),
                 (F.min(xp) < F.max(xp)).alias(f"_vx2__{c}"), (F.min(yp) < F.max(yp)).alias(f"_vy2__{c}")]
    ok = lambda c: (F.col(f"_n__{c}") >= min_rows) & F.col(f"_vx2__{c}") & F.col(f"_vy2__{c}")
    r = lambda c: F.try_divide(F.col(f"_cov__{c}"), F.sqrt(F.col(f"_vx__{c}") * F.col(f"_vy__{c}")))
    row = df.agg(*aggs).select(*[F.when(ok(c), r(c)).alias(f"corr__{c}") for c in cols])
    return _reshape(row, cols, {"corr": "double"})


def contingency(df: DataFrame, cols: Sequence[str], y_col: str) -> DataFrame:
    """ASSOC2: long-form crosstab ``(column_name, value, y, n)`` over complete pairs."""
    long = melt(df.select(y_col, *cols), [y_col], cols, value_type="string", feature_col="column_name")
    return (long.where(F.col("value").isNotNull() & F.col(y_col).isNotNull())
            .groupBy("column_name", "value", y_col).agg(F.count(F.lit(1)).alias("n")))


def cramers_v(ct: DataFrame, y_col: str, min_rows: int = MIN_ROWS_FOR_CORRELATION) -> DataFrame:
    """ASSOC3: Cramer's V from an uncorrected chi-square,
    ``chi2 = n * (sum O^2 / (R * C) - 1)``, ``V = sqrt(chi2 / n / min(r-1, k-1))``; null when
    either side has fewer than two levels or fewer than ``min_rows`` rows (Q22)."""
    ct = materialize(ct, "contingency")  # read for the cells and both margins
    rm = ct.groupBy("column_name", "value").agg(F.sum("n").alias("R"))
    cm = ct.groupBy("column_name", y_col).agg(F.sum("n").alias("C"))
    j = ct.join(rm, ["column_name", "value"]).join(cm, ["column_name", y_col])
    agg = j.groupBy("column_name").agg(
        F.sum("n").alias("_n"),
        F.sum(F.col("n").cast("double") * F.col("n") / (F.col("R").cast("double") * F.col("C"))).alias("_s"),
        F.count_distinct("value").alias("_r"), F.count_distinct(y_col).alias("_k"))
    chi2 = F.col("_n") * (F.col("_s") - 1)
    denom = F.least(F.col("_r") - 1, F.col("_k") - 1)
    v = F.when((F.col("_r") >= 2) & (F.col("_k") >= 2) & (F.col("_n") >= min_rows),
               F.sqrt(F.greatest(chi2, F.lit(0.0)) / F.col("_n") / denom))
    return agg.select("column_name", v.alias("v"))


def profile_record(df: DataFrame, cols: Sequence[str], id_col: str, y_col: str | None = None) -> DataFrame:
    """PROF8: everything known about each column in one row: counts, distinct values, moments, quantiles and
    association with the target of numbers; the most frequent value and association of categories; range
    of times. Fields that a kind of column doesn't have are null. The joins are of one row per column."""
    kind = {c: k for c, k in kinds(df).items() if c in cols}
    of = {k: [c for c in cols if kind[c] == k] for k in ("numeric", "categorical", "datetime")}
    out = df.sparkSession.createDataFrame([(c, kind[c]) for c in cols], "column_name string, kind string")
    parts = [profile_missing(df, cols), profile_distinct(df, cols)]
    association = []
    if of["numeric"]:
        parts += [profile_numeric(df, of["numeric"]), profile_quantiles(df, of["numeric"], id_col)]
        if y_col:
            association.append(assoc_numeric(df, of["numeric"], y_col).select("column_name", F.col("corr").alias("association")))
    if of["categorical"]:
        top = profile_top_values(df, of["categorical"], 1)
        parts.append(top.select("column_name", F.col("value").alias("top_value"), F.col("n").alias("top_n")))
        if y_col:
            association.append(cramers_v(contingency(df, of["categorical"], y_col), y_col).select("column_name", F.col("v").alias("association")))
    if of["datetime"]:
        parts.append(profile_datetime(df, of["datetime"]))
    if association:
        parts.append(reduce(DataFrame.unionByName, association))
    return reduce(lambda left, right: left.join(right, "column_name", "left"), parts, out)


NO_VARIANCE = 1e-12  # of a column's own variance; below it the rows of a pair count as constant


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ASSOC4: Pearson correlation of every pair a < b (in the given order) over the rows that have both,
    long output (a, b, corr); null where either is constant there. Missing: null and NaN.

    One method at any width: columns are standardised, and each task adds up the products of blocks of
    rows with their masks of present values (sums, squares, products and counts of all pairs at once),
    so that a task sends one row for each pair and the plan has no expression for each pair."""
    cols = list(cols)
    values = df.select(*[known(df, c).cast("double").alias(c) for c in cols])
    some = values.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    mean = np.array([some[f"m{i}"] or 0.0 for i in range(len(cols))])
    scale = np.array([some[f"s{i}"] or 0.0 for i in range(len(cols))])
    ship_package(df.sparkSession)
    sums = values.toDF(*[f"c{i}" for i in range(len(cols))]).mapInArrow(partial(pair_sums, mean=mean, scale=scale), PAIR_SUMS)
    total = sums.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in ("n", "si", "sj", "qi", "qj", "p")])
    cov = F.col("p") / F.col("n") - F.col("si") * F.col("sj") / F.col("n") / F.col("n")
    var = lambda s, q: F.col(q) / F.col("n") - F.pow(F.col(s) / F.col("n"), 2)
    vi, vj = var("si", "qi"), var("sj", "qj")
    r = F.when((vi > NO_VARIANCE) & (vj > NO_VARIANCE), cov / F.sqrt(vi * vj))
    label = lambda k: F.element_at(F.array(*map(F.lit, cols)), F.col(k) + 1)
    return total.where("n > 0").select(label("i").alias("a"), label("j").alias("b"), r.alias("corr"))


PAIR_SUMS = "i int, j int, n double, si double, sj double, qi double, qj double, p double"
PAIR_ROWS = 4096


def pair_sums(batches, mean, scale):
    """The sums of all pairs of columns over a task's rows, as rows of ``PAIR_SUMS``."""
    k = len(mean)
    total = np.zeros((6, k, k))
    for b in batches:
        for at in range(0, b.num_rows, PAIR_ROWS):
            x = np.column_stack([b.column(i).slice(at, PAIR_ROWS).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)])
            there = ~np.isnan(x)
            z = np.divide(np.where(there, x, mean) - mean, scale, out=np.zeros_like(x), where=scale > 0)
            m = there.astype(np.float64)
            sums, squares = z.T @ m, (z * z).T @ m
            total += np.stack([m.T @ m, sums, sums.T, squares, squares.T, z.T @ z])
    i, j = np.triu_indices(k, 1)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in total]],
                                     names=["i", "j", "n", "si", "sj", "qi", "qj", "p"])
