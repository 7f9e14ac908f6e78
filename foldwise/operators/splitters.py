"""Bucket bounds from a bounded hash sample (helper X1).

Order keys are cut into buckets of about equal size. The bounds come from a sample of the rows with a small
hash, about ``PER_BUCKET`` rows a bucket: a pure function of the rows, so a recomputed branch sees the same
buckets, and ranks stay exact whatever the bounds are, because the rows of every bucket are counted. Up to
``LEAVES`` buckets the sample (at most about PER_BUCKET * LEAVES pairs of numbers) is sorted on the driver.
Beyond, it is written and cut in two levels: ``LEAVES`` bounds from a part of it, and inside each of their
ranges the finer bounds by a task of its own; those are a table of one row a range, which is broadcast (a number
a bucket). No quantile is merged in one task, and the plan holds at most ``LEAVES`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.session import materialize

LEAVES = 4096
PER_BUCKET = 64


def bucketize(df: DataFrame, x: Column, bounds: Sequence[float], out_col: str) -> DataFrame:
    """Adds ``out_col``: the number of ``bounds`` below ``x`` (nulls and NaN get ``len(bounds) + 1``), by
    binary search: a value equal to a bound stays the top of the lower bucket."""
    bounds = sorted(set(float(b) for b in bounds))
    if not bounds:
        return df.withColumn(out_col, F.when(x.isNull(), 1).otherwise(0).cast("int"))
    tmp, found = f"_bx_{out_col}", f"_bo_{out_col}"
    splits = [float("-inf"), *[float(np.nextafter(b, np.inf)) for b in bounds], float("inf")]
    search = Bucketizer(splits=splits, inputCol=tmp, outputCol=found, handleInvalid="keep")
    out = search.transform(df.withColumn(tmp, F.coalesce(x, F.lit(float("nan")))))
    return out.withColumn(out_col, F.col(found).cast("int")).drop(tmp, found)


def quantile_cuts(values: np.ndarray, n: int) -> np.ndarray:
    """The distinct upper ends of n - 1 of n equal parts of sorted ``values``."""
    if not len(values) or n < 2:
        return np.zeros(0)
    return np.unique(values[np.maximum(-(-np.arange(1, n) * len(values) // n) - 1, 0)])


def hot_values(values: np.ndarray, per_bucket: float) -> list[tuple[float, int]]:
    """(value, buckets that it fills) of the values that fill two or more."""
    v, c = np.unique(values, return_counts=True)
    return [(float(a), int(b // per_bucket)) for a, b in zip(v, c, strict=True) if b >= 2 * per_bucket]


@dataclass
class Splitters:
    """``bounds`` of the first level; ``leaves`` (leaf, cuts) of the second, with less than ``inner`` cuts each; ``hot``
    (value or None for missing ones, pieces), at most a row for two buckets, the largest of ``pieces``; ``ties`` cut the
    tie-breaker of hot values into at most ``LEAVES``."""

    bounds: list[float]
    leaves: DataFrame | None = None
    inner: int = 1
    hot: DataFrame | None = None
    pieces: int = 0
    ties: Sequence[float] = ()

    def assign(self, df: DataFrame, x: Column, out_col: str) -> DataFrame:
        """``df`` with the bucket of ``x``."""
        out = bucketize(df, x, self.bounds, out_col)
        if self.leaves is None:
            return out
        out = out.join(F.broadcast(self.leaves), F.col(out_col) == F.col("leaf"), "left")  # a number a bucket in all
        inside = F.coalesce(F.size(F.filter("cuts", lambda c: c < x)), F.lit(0))
        return out.withColumn(out_col, F.col(out_col) * F.lit(self.inner) + F.greatest(inside, F.lit(0))).drop("leaf", "cuts")


def find_splitters(df: DataFrame, x: Column, n_buckets: int | Callable[[int], int], tie: Column | None = None, also: Sequence[Column] = ()) -> Splitters:
    """The splitters of ``x`` (a double) for ``n_buckets`` (a number, or what gives it for the number of rows); ``also`` are
    further columns that tell rows apart."""
    n = df.count()
    n_buckets = n_buckets(n) if callable(n_buckets) else n_buckets
    if not n or n_buckets < 2:
        return Splitters([])
    t = tie if tie is not None else F.lit(0.0)
    number = F.xxhash64(x, t, *also)
    every = max(1, n // (PER_BUCKET * n_buckets))
    missing = x.isNull() | F.isnan(x)
    sample = df.select(F.when(~missing, x).alias("x"), t.cast("double").alias("t"), number.alias("g")).where(F.pmod(number, F.lit(every)) == 0)
    deep = n_buckets > LEAVES
    if deep:
        sample = materialize(sample, "sample")
        thin = -(-n_buckets // LEAVES)
        top = sample.where(F.pmod(F.xxhash64("g"), F.lit(thin)) == 0)
    else:
        top = sample
    rows = top.select("x", "t").toPandas()  # about PER_BUCKET * min(n_buckets, LEAVES) rows
    values = np.sort(rows["x"].dropna().to_numpy(float))
    parts = min(n_buckets, LEAVES)
    per_bucket = max(len(rows) / parts, 1.0)
    bounds, hot = quantile_cuts(values, parts), hot_values(values, per_bucket)
    scale = n_buckets / parts
    gone = int(rows["x"].isna().sum() / per_bucket * scale)
    pieces = [(None, gone)] if gone > 1 else []
    spark, schema = df.sparkSession, "_hv double, _hc int"
    chosen = rows["x"].isin([v for v, _ in hot]) | (rows["x"].isna() if gone > 1 else False)
    ties = quantile_cuts(np.sort(rows.loc[chosen, "t"].dropna().to_numpy(float)), parts).tolist() if tie is not None else []
    if not deep:
        bounds = np.union1d(bounds, [v for v, _ in hot])  # a hot value is the top of its bucket
        pieces += hot
        return Splitters(bounds.tolist(), None, 1, spark.createDataFrame(pieces, schema) if pieces else None, max((c for _, c in pieces), default=0), ties)
    each, fill = thin, max(sample.count() / n_buckets, 1.0)

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(g["x"].to_numpy(float))
        found = hot_values(v, fill)
        cuts = np.union1d(quantile_cuts(v, each), [a for a, _ in found])
        return pd.DataFrame({"leaf": [g["leaf"].iloc[0]], "cuts": [cuts.tolist()], "values": [[a for a, _ in found]], "pieces": [[b for _, b in found]]})

    inside = bucketize(sample.where("x IS NOT NULL").select("x"), F.col("x"), bounds.tolist(), "leaf")
    inside = inside.groupBy("leaf").applyInPandas(lambda g: cut(g), "leaf int, cuts array<double>, values array<double>, pieces array<int>")
    inside = materialize(inside, "leaves")
    widest = inside.agg(F.max(F.size("cuts"))).first()[0] or 0
    found = inside.select(F.explode(F.arrays_zip("values", "pieces")).alias("h")).select(F.col("h.values").alias("_hv"), F.col("h.pieces").alias("_hc"))
    found = found.unionByName(spark.createDataFrame(pieces, schema)) if pieces else found
    return Splitters(bounds.tolist(), inside.select("leaf", "cuts"), widest + 1, found, found.agg(F.max("_hc")).first()[0] or 0, ties)
