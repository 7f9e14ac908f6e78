"""Score metrics from histograms (SCORE1-7).

Every rank metric is a function of the per-score histogram ``(score, pos, neg)`` and its
running sums, so one ``groupBy(by, score)`` with map-side partial aggregation replaces a
sort of the rows, and ties are handled exactly:

* AUC = sum(pos * (neg strictly below + neg equal / 2)) / (P * N)
* average precision = sum over scores descending of pos/P * TP/(TP+FP) at that cut
* KS = max |cum_pos/P - cum_neg/N| over scores ascending

The running sums come from ``prefix_sums`` (bucketed, no global window). All metrics for
all groups (folds, features) are one job.

Where only AUCs are wanted, of many scores a row (``packed_aucs``), tasks send the sorted scores of each group
packed by ranges, about eight bytes a score, and a range's AUC terms are added up in numpy: one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.scalar import LEAK_AUC_THRESHOLD, clip_proba
from foldwise.operators.rank import prefix_sums
from foldwise.session import materialize, ship_package

RANGE_ROWS = 400_000  # rows of a group in one range of scores
RANGE_SAMPLE = 100  # sampled rows for each range's bound
HELD = 4_000_000  # scores a task holds before it sends them
PACKED = "set int, fold int, bucket int, pos binary, pos_n binary, neg binary, neg_n binary"

#: (group's number, fold, scores, labels) of a batch; NaN labels are left out.
Pieces = Callable[[pa.RecordBatch], list[tuple[int, int, np.ndarray, np.ndarray]]]


def histogram(df: DataFrame, score_col: str, y_col: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., score, pos, neg)``; rows with a null score or label are dropped."""
    y = F.col(y_col).cast("int")
    return (df.where(F.col(score_col).isNotNull() & F.col(y_col).isNotNull())
            .groupBy(*by, F.col(score_col).cast("double").alias("score"))
            .agg(F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("neg")))


def rank_metrics(hist: DataFrame, by: Sequence[str] = (), n_buckets: int | None = None,
                 materialize_hist: bool = True) -> DataFrame:
    """AUC, average precision and KS per ``by`` group from a histogram. The histogram is
    written once to the checkpoint folder (``materialize_hist``): the bucket-bounds pass
    and the prefix-sum pass then read it instead of recomputing the scores twice."""
    by = list(by)
    if materialize_hist:
        hist = materialize(hist)
    c = prefix_sums(hist, "score", ["pos", "neg"], by=by, inclusive=True, n_buckets=n_buckets)
    P, N = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    neg_below = (F.col("cum_neg") - F.col("neg")).cast("double")
    # descending cut at this score: everything >= score
    tp = P - (F.col("cum_pos") - F.col("pos"))
    fp = N - (F.col("cum_neg") - F.col("neg"))
    terms = c.select(
        *by, "pos_total", "neg_total",
        (F.col("pos") * (neg_below + F.col("neg") / 2.0)).alias("_auc_t"),
        F.when(F.col("pos") > 0, (F.col("pos") / P) * (tp / (tp + fp))).otherwise(0.0).alias("_ap_t"),
        F.abs(F.col("cum_pos") / P - F.col("cum_neg") / N).alias("_ks_t"),
        F.lit(1).alias("_one"))
    agg = terms.groupBy(*by).agg(
        F.first("pos_total").alias("P"), F.first("neg_total").alias("N"),
        F.sum("_auc_t").alias("_auc_s"), F.sum("_ap_t").alias("_ap"),
        F.max("_ks_t").alias("_ks"), F.sum("_one").alias("n_distinct"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        *by, "P", "N", "n_distinct",
        F.when(both, F.col("_auc_s") / (F.col("P").cast("double") * F.col("N"))).alias("auc"),
        F.when(F.col("P") > 0, F.col("_ap")).alias("pr_auc"),
        F.when(both, F.col("_ks")).otherwise(F.lit(0.0)).alias("ks"))


def packed(held: dict, bounds: dict) -> pa.RecordBatch:
    """Rows of ``PACKED`` from the held (scores, labels) of each group: each label's distinct scores in order, and how
    often they stand there (empty: once each), by range."""
    rows = []
    for (number, fold), parts in held.items():
        x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        cuts, sides = bounds.get((number, fold), np.zeros(0)), []
        for label in (1, 0):
            v, n = np.unique(x[y == label], return_counts=True)
            sides.append((v, n, np.concatenate([[0], np.searchsorted(v, cuts, "right"), [len(v)]])))
        for b in range(len(cuts) + 1):
            row = [number, fold, b]
            for v, n, ends in sides:
                own, times = v[ends[b]:ends[b + 1]], n[ends[b]:ends[b + 1]]
                row += [own.tobytes(), times.tobytes() if (times > 1).any() else b""]
            if row[3] or row[5]:
                rows.append(row)
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def range_sums(g: pd.DataFrame) -> pd.DataFrame:
    """A range's positives and negatives, its least and greatest score, and its pairs of a positive above a negative, half
    of the equal ones."""
    def side(c: str) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate([np.frombuffer(b) for b in g[c]])
        n = np.concatenate([np.frombuffer(m, np.int64) if m else np.ones(len(b) // 8, np.int64) for b, m in zip(g[c], g[c + "_n"], strict=True)])
        order = np.argsort(v, kind="stable")
        return v[order], n[order]

    (p, pn), (q, qn) = side("pos"), side("neg")
    below = np.concatenate([[0], np.cumsum(qn)])
    pairs = (pn * ((below[np.searchsorted(q, p, "left")] + below[np.searchsorted(q, p, "right")]) / 2)).sum()
    ends = [v[i] for v in (p, q) if len(v) for i in (0, -1)]
    return pd.DataFrame({"set": [g["set"].iloc[0]], "fold": [g["fold"].iloc[0]], "bucket": [g["bucket"].iloc[0]], "p": [pn.sum()], "n": [qn.sum()],
                         "pairs": [float(pairs)], "lo": [np.sort(ends)[0]], "hi": [np.sort(ends)[-1]]})  # NaN is the greatest


def packed_aucs(rows: DataFrame, pieces: Pieces, sample: DataFrame, n_rows: int, id_col: str) -> DataFrame:
    """(set, fold, auc, several) of the ``pieces`` of ``rows``; null AUC without both labels; ``several``: more than one
    distinct score. ``sample``: rows that give about the same scores as the ``n_rows`` of ``rows``; a bounded hash
    sample of their ids sets the ranges, which decide on balance alone."""
    ship_package(rows.sparkSession)
    many, bounds = -(-n_rows // RANGE_ROWS), {}
    if many > 1:
        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, fold, x, _ in pieces(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), number, np.int32)), pa.array(np.full(len(x), fold, np.int32)), pa.array(x)], names=["set", "fold", "x"])

        share = min(1.0, RANGE_SAMPLE * many / n_rows)
        some = sample.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
        quantiles = F.percentile_approx(F.when(~F.isnan("x"), F.col("x")), [i / many for i in range(1, many)], 100 * many)
        cuts = some.mapInArrow(scores, "set int, fold int, x double").groupBy("set", "fold").agg(quantiles.alias("q")).collect()  # ranges a group
        bounds = {(r["set"], r["fold"]): np.unique(r["q"]) for r in cuts if r["q"]}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for number, fold, x, y in pieces(batch):
                there = ~np.isnan(y)
                held.setdefault((number, fold), []).append((x[there], y[there].astype(np.int8)))
                size += len(x)
            if size >= HELD:
                yield packed(held, bounds)
                held, size = {}, 0
        yield packed(held, bounds)

    sums = rows.mapInArrow(pack, PACKED).groupBy("set", "fold", "bucket").applyInPandas(
        lambda g: range_sums(g), "set int, fold int, bucket int, p long, n long, pairs double, lo double, hi double")
    earlier = Window.partitionBy("set", "fold").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # ranges of a group
    terms = sums.withColumn("pairs", F.col("pairs") + F.col("p") * F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    total = terms.groupBy("set", "fold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("pairs") / (F.col("p").cast("double") * F.col("n")))
    return total.select("set", "fold", auc.alias("auc"), (F.col("lo") != F.col("hi")).alias("several"))


def binary_metrics(df: DataFrame, proba_col: str, y_col: str, by: Sequence[str] = (),
                   n_buckets: int | None = None) -> DataFrame:
    """SCORE6: auc, logloss, pr_auc, ks, brier per group on probabilities clipped to
    [1e-7, 1 - 1e-7] (Q7)."""
    by = list(by)
    p = df.select(*by, clip_proba(proba_col).alias("_p"), F.col(y_col).cast("int").alias("_y"))
    ranks = rank_metrics(histogram(p, "_p", "_y", by), by, n_buckets)
    yv, pv = F.col("_y").cast("double"), F.col("_p")
    pointwise = p.groupBy(*by).agg(
        (-F.avg(yv * F.ln(pv) + (1 - yv) * F.ln(1 - pv))).alias("logloss"),
        F.avg((pv - yv) * (pv - yv)).alias("brier"))
    if by:
        out = ranks.join(pointwise, by, "inner")
    else:
        out = ranks.crossJoin(pointwise)  # 1 x 1 rows
    return out.select(*by, "auc", "logloss", "pr_auc", "ks", "brier")


METRICS = ("auc", "logloss", "pr_auc", "ks", "brier")


def with_summary(m: DataFrame, fold_col: str = "fold") -> DataFrame:
    """A row per fold, with their mean (fold -1) and population std (fold -2, Q6). The k rows are written
    first, so that the metric runs once."""
    m = materialize(m.select(F.col(fold_col).cast("int").alias(fold_col), *METRICS), "metrics")
    two = F.inline(F.array(*[F.struct(F.lit(n).alias(fold_col), *[F.col(f"{c}_{n}").alias(c) for c in METRICS]) for n in (-1, -2)]))
    both = m.agg(*[f(c).alias(f"{c}_{n}") for n, f in ((-1, F.avg), (-2, F.stddev_pop)) for c in METRICS])
    return m.unionByName(both.select(two))


def single_feature_auc(df: DataFrame, features: Sequence[str], y_col: str, id_col: str,
                       threshold: float = LEAK_AUC_THRESHOLD) -> DataFrame:
    """SCORE7: per feature, the sign-symmetric AUC ``max(auc, 1 - auc)`` of the raw values
    against the label, pairwise-complete; null for text columns, constant features or one
    class. ``flag`` marks auc >= threshold. All features in one job."""
    types = dict(df.dtypes)
    numeric = [f for f in features if types[f] not in ("string", "boolean", "timestamp", "timestamp_ntz", "date")]
    text = [f for f in features if f not in numeric]
    long = df.select(id_col, F.col(y_col).cast("int").cast("double").alias(y_col), *[F.col(c).cast("double").alias(c) for c in numeric])

    def pieces(batch: pa.RecordBatch) -> list:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        y, out = column(y_col).to_numpy(zero_copy_only=False), []
        for i, c in enumerate(numeric):
            there = column(c).is_valid().to_numpy(zero_copy_only=False)
            out.append((i, 0, column(c).to_numpy(zero_copy_only=False)[there], y[there]))
        return out

    m = packed_aucs(long, pieces, long, df.count(), id_col)
    ok = F.col("auc").isNotNull() & F.col("several")
    auc = F.when(ok, F.greatest(F.col("auc"), 1 - F.col("auc")))
    out = m.select(F.get(F.array(*map(F.lit, numeric)).cast("array<string>"), F.col("set")).alias("feature"), auc.alias("auc"))
    spark = df.sparkSession
    present = spark.createDataFrame([(f,) for f in features], "feature string")  # feature names only
    out = F.broadcast(present).join(out, "feature", "left")  # one row per feature name
    return out.select("feature", "auc", F.coalesce(F.col("auc") >= threshold, F.lit(False)).alias("flag"))
