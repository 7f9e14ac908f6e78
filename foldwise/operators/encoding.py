"""Ordered target statistics of categorical columns (model input).

A row's training value of a category is the smoothed mean label of the rows of that category that come
before it in a hash order, so no row sees its own label; a row that a model didn't train on sees all
training rows. ``k + 1`` models share one pass: model i trains on every fold but i, model k on all folds.

The sums before a row are segmented prefix sums: rows are cut into buckets by ranges of the (uniform) hash,
summed by windows over (category, bucket), column by column, and offset by the totals of the category's earlier
buckets. A category that holds a third of the rows is thus spread over all buckets, and there may be any
number of categories; none is hashed onto another. All windows lie inside a bucket, so the rows are
shuffled once, by bucket, with whatever else of them is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import TWO_POW_32, h
from foldwise.functions.scalar import missing_category
from foldwise.session import materialize, shuffle_partitions

PRIOR_WEIGHT = 1.0
BUCKETS = 4  # buckets for each shuffle partition, which evens out the partitions


def model_priors(df: DataFrame, label: str, k: int, fold_col: str = "fold") -> list[float]:
    """Mean label of the rows that each of the models 0..k trains on."""
    rows = df.where(F.col(fold_col).isNotNull() & F.col(label).isNotNull()).groupBy(fold_col).agg(
        F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).collect()  # k rows
    out = []
    for i in range(k + 1):
        s, n = (sum(r[c] for r in rows if r[fold_col] != i) for c in ("s", "n"))
        out.append(float(s) / n if n else 0.0)
    return out


def ordered_statistics(df: DataFrame, id_col: str, label: str, categorical: Sequence[str], k: int, fold_col: str = "fold",
                       seed: int = 42, priors: Sequence[float] | None = None, keep: Sequence[Column] = ()) -> DataFrame:
    """``(id, keep..., enc_fit, enc_apply)``: arrays of (column, model) values, column by column with k + 1 models each.
    ``enc_fit`` is what a model trains on (null-free also where it doesn't); ``enc_apply`` what it scores with:
    all its training rows. Rows without a fold (a holdout) belong to no training set."""
    priors = list(priors) if priors is not None else model_priors(df, label, k, fold_col)
    buckets = BUCKETS * shuffle_partitions(df.sparkSession)
    kept = [F.struct(*keep).alias("_keep")] if keep else []
    cats = [f"_v{n}" for n in range(len(categorical))]
    rows = df.select(F.col(id_col).alias("_id"), F.col(fold_col).alias("_f"), F.col(label).cast("double").alias("_y"), h(id_col, f"ts{seed}").alias("_h"),
                     *[missing_category(c, df).alias(v) for c, v in zip(categorical, cats, strict=True)], *kept)
    rows = rows.withColumn("_b", F.floor(F.col("_h") * F.lit(buckets / TWO_POW_32)).cast("int"))
    here = [F.coalesce((F.col("_f") == j) & F.col("_y").isNotNull(), F.lit(False)) for j in range(k)]
    parts = {f"n{j}": F.when(here[j], 1.0).otherwise(0.0) for j in range(k)} | {f"s{j}": F.when(here[j], F.col("_y")).otherwise(0.0) for j in range(k)}
    earlier = Window.partitionBy("_tv").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)

    def smoothed(i: int, total: bool) -> Column:
        others = [j for j in range(k) if j != i]
        value = lambda p: sum([F.col(f"t{p}{j}") if total else F.col(f"l{p}{j}") + F.col(f"o{p}{j}") for j in others], F.lit(0.0))
        return (value("s") + PRIOR_WEIGHT * priors[i]) / (value("n") + PRIOR_WEIGHT)

    out = rows.repartition("_b")
    for v in cats:
        totals = rows.groupBy(F.col(v).alias("_tv"), F.col("_b").alias("_tb")).agg(*[F.sum(c).alias(p) for p, c in parts.items()])
        totals = totals.select("_tv", "_tb", *[F.coalesce(F.sum(p).over(earlier), F.lit(0.0)).alias(f"o{p}") for p in parts],
                               *[F.sum(p).over(Window.partitionBy("_tv")).alias(f"t{p}") for p in parts])
        before = Window.partitionBy(v, "_b").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"l{p}": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for p, c in parts.items()})
        # written, so that the planner knows its size: a row a category and bucket
        out = out.join(materialize(totals, "categories"), (F.col(v) == F.col("_tv")) & (F.col("_b") == F.col("_tb")))
        out = out.withColumns({f"a{v}": F.array(*[smoothed(i, False) for i in range(k + 1)]), f"b{v}": F.array(*[smoothed(i, True) for i in range(k + 1)])})
        out = out.drop("_tv", "_tb", *[f"{x}{p}" for x in "lot" for p in parts])
    flat = lambda part: F.concat(*[F.col(f"{part}{v}") for v in cats])
    return out.select(F.col("_id").alias(id_col), *(["_keep.*"] if keep else []), flat("a").alias("enc_fit"), flat("b").alias("enc_apply"))
