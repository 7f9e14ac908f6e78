"""Population / characteristic stability (STB1-STB12, AGG1, WIN1).

Only bin edges (bins + 1 numbers per feature) and proportions are small; every count is
a grouped aggregation over the rows. Reference edges come from exact quantiles of the
reference rows (distributed rank), so a feature's histogram for every window, bootstrap
sample or population is one ``groupBy(feature, group, bin)`` job.

Bins: PSI uses left-closed bins ``[a, b)`` (numpy histogram), deciles use right-closed
bins ``(a, b]`` (pandas cut); the outer edges are open (-inf / +inf) and duplicate edges
collapse (Q1, Q2). Proportions are floored at 1e-4 and not renormalised (Q3).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.scalar import classify_psi, known, left_closed_bin, psi_term, right_closed_bin
from foldwise.operators.rank import exact_quantiles
from foldwise.session import materialize

CONSTANT_HALF_WIDTH = 1e-9
DEFAULT_BINS = 10


def edge_probs(bins: int) -> list[float]:
    """Quantile levels of the bin edges, as ``numpy.linspace(0, 1, bins + 1)``."""
    return [float(x) for x in np.linspace(0.0, 1.0, bins + 1)]


def bin_edges(ref: DataFrame, value_col: str, id_col: str, bins: int = DEFAULT_BINS,
              by: Sequence[str] = ()) -> DataFrame:
    """STB1: per ``by`` group, ``edges`` (sorted unique reference quantiles with -inf/+inf
    ends; a constant or empty reference falls back to one bin around its value) and
    ``inner`` (edges without the open ends), plus ``n_bins``."""
    by = list(by)
    q = exact_quantiles(ref, value_col, edge_probs(bins), id_col, by=by)
    e = q.groupBy(*by).agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("_u"),
                           F.min("q").alias("_lo"))
    lo = F.col("_lo")
    u = F.when(F.size("_u") < 2, F.array(lo - CONSTANT_HALF_WIDTH, lo + CONSTANT_HALF_WIDTH)).otherwise(F.col("_u"))
    e = e.withColumn("_u", u)
    n = F.size("_u")
    inner = F.slice("_u", 2, n - 2)
    edges = F.concat(F.array(F.lit(float("-inf"))), inner, F.array(F.lit(float("inf"))))
    out = e.select(*by, edges.alias("edges"), inner.alias("inner"), (n - 1).alias("n_bins"))
    # the edges are one row per group with at most bins + 1 numbers: read them once and
    # continue from a literal frame, so no later branch re-runs the quantile jobs
    return ref.sparkSession.createDataFrame(out.collect(), out.schema)


def with_bins(df: DataFrame, edges: DataFrame, value_col: str, by: Sequence[str] = (),
              right_closed: bool = False, bin_col: str = "bin") -> DataFrame:
    """Attach each row's bin given per-group edges (edges table: one row per group,
    broadcast; its size is the number of features)."""
    by = list(by)
    e = F.broadcast(edges.select(*by, "inner", "n_bins"))
    j = df.join(e, by, "inner") if by else df.crossJoin(e)
    fn = right_closed_bin if right_closed else left_closed_bin
    return j.withColumn(bin_col, fn(F.col(value_col), F.col("inner"))).drop("inner")


def bin_grid(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every (group, bin) pair, so empty bins take part in the index."""
    return edges.select(*by, F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))


def psi_from_counts(counts: DataFrame, keys: Sequence[str], ref_col: str = "ref_n", cur_col: str = "cur_n") -> DataFrame:
    """STB3 over a complete grid: ``counts`` has (keys..., bin, ref_n, cur_n); returns keys + psi, 0 where
    there is no bin at all (without keys; a group that isn't there has no row). Totals are an aggregate
    joined back, so no task holds all bins. Proportions divide by max(total, 1)."""
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum(ref_col).alias("_rt"), F.sum(cur_col).alias("_ct"))
    if keys:
        totals = totals.withColumnsRenamed({k: f"_t_{k}" for k in keys})
        same = reduce(and_, [counts[k].eqNullSafe(totals[f"_t_{k}"]) for k in keys])
        whole = counts.join(totals, same)
    else:
        whole = counts.crossJoin(totals)  # one row
    share = lambda n, t: F.col(n) / F.greatest(F.coalesce(F.col(t), F.lit(0)), F.lit(1))
    return whole.groupBy(*keys).agg(F.coalesce(F.sum(psi_term(share(ref_col, "_rt"), share(cur_col, "_ct"))), F.lit(0.0)).alias("psi"))


def psi_numeric(df: DataFrame, value_col: str, id_col: str, is_ref: Column, is_cur: Column,
                by: Sequence[str] = (), bins: int = DEFAULT_BINS, edges: DataFrame | None = None) -> DataFrame:
    """STB4: PSI of the current rows against reference-quantile bins, per ``by`` group
    (``edges`` can be passed when already computed for the same reference). Null and NaN are missing."""
    by = list(by)
    clean = df.where(known(df, value_col).isNotNull()).select(*by, id_col, value_col, is_ref.alias("_isref"), is_cur.alias("_iscur"))
    if edges is None:
        edges = bin_edges(clean.where("_isref"), value_col, id_col, bins, by)
    binned = with_bins(clean, edges, value_col, by)
    counts = binned.groupBy(*by, "bin").agg(F.count_if("_isref").alias("ref_n"),
                                            F.count_if("_iscur").alias("cur_n"))
    grid = bin_grid(edges, by).join(counts, [*by, "bin"], "left").fillna(0, ["ref_n", "cur_n"])
    return psi_from_counts(grid, by)


def csi_categorical(df: DataFrame, value_col: str, is_ref: Column, is_cur: Column,
                    by: Sequence[str] = ()) -> DataFrame:
    """STB5/JOIN6/SET1: per category of the union of both sides (missing = 0), by
    conditional aggregation instead of a full outer join; no categories -> 0.0."""
    by, v = list(by), known(df, value_col)
    c = (df.where(v.isNotNull()).groupBy(*by, v.cast("string").alias("bin"))
         .agg(F.count_if(is_ref).alias("ref_n"), F.count_if(is_cur).alias("cur_n"))
         .where((F.col("ref_n") > 0) | (F.col("cur_n") > 0)))
    return psi_from_counts(c, by)


def csi(df: DataFrame, value_col: str, id_col: str, is_ref: Column, is_cur: Column, by: Sequence[str] = (),
        bins: int = DEFAULT_BINS) -> DataFrame:
    """STB5 by type: numbers through reference-quantile bins, text and booleans by category; ``csi``, 0.0
    for a column without values, and its class."""
    if isinstance(df.schema[value_col].dataType, T.NumericType):
        out = psi_numeric(df, value_col, id_col, is_ref, is_cur, by, bins)
    else:
        out = csi_categorical(df, value_col, is_ref, is_cur, by)
    return out.withColumnRenamed("psi", "csi").withColumn("flag", classify_psi("csi"))


def time_window_counts(df: DataFrame, value_col: str, id_col: str, window_col: str,
                       by: Sequence[str] = (), bins: int = DEFAULT_BINS) -> tuple[DataFrame, DataFrame]:
    """STB2 for many windows at once: reference edges from window 0, then counts per
    (by, window, bin) over a complete grid. Returns (edges, counts)."""
    by = list(by)
    clean = df.where(known(df, value_col).isNotNull()).select(*by, id_col, window_col, value_col)
    edges = bin_edges(clean.where(F.col(window_col) == 0), value_col, id_col, bins, by)
    binned = with_bins(clean, edges, value_col, by)
    counts = binned.groupBy(*by, window_col, "bin").agg(F.count(F.lit(1)).alias("n"))
    windows = clean.select(*by, window_col).distinct()
    grid = bin_grid(edges, by).join(windows, by, "inner") if by else bin_grid(edges).crossJoin(windows)
    full = grid.join(counts, [*by, window_col, "bin"], "left").fillna(0, ["n"])
    return edges, full


def temporal_oot(counts: DataFrame, window_col: str, by: Sequence[str] = (),
                 label_prefix: str = "window_") -> DataFrame:
    """STB8: PSI of every window > 0 against window 0 from a (by, window, bin, n) grid."""
    by = list(by)
    ref = counts.where(F.col(window_col) == 0).select(*by, "bin", F.col("n").alias("ref_n"))
    cur = counts.where(F.col(window_col) > 0).withColumnRenamed("n", "cur_n")
    j = cur.join(ref, [*by, "bin"], "left").fillna(0, ["ref_n"])
    p = psi_from_counts(j, [*by, window_col])
    return p.select(*by, F.concat(F.lit(label_prefix), F.col(window_col).cast("string")).alias("label"),
                    F.col(window_col), F.col("psi").alias("value"))


def temporal_oot_categorical(df: DataFrame, value_col: str, window_col: str,
                             by: Sequence[str] = (), label_prefix: str = "window_") -> DataFrame:
    """STB8 for a categorical feature: window 0 vs every later window. The categories of a window meet
    those of window 0 by a join; what the reference's other categories add is the same for all windows
    (their share against none), so no grid of windows and categories is made."""
    by, v = list(by), known(df, value_col)
    counts = materialize(df.where(v.isNotNull()).groupBy(*by, window_col, v.cast("string").alias("bin")).agg(F.count(F.lit(1)).alias("n")), "categories")
    totals = counts.groupBy(*by, window_col).agg(F.sum("n").alias("t"))
    first = F.col(window_col) == 0
    base = totals.where(first).select(*[F.col(k).alias(f"_b_{k}") for k in by], F.col("t").alias("rt"))
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in by]) if by else F.lit(True)
    ref = counts.where(first).join(base, match).select(*by, F.col("bin").alias("rbin"), (F.col("n") / F.col("rt")).alias("e"))
    alone = ref.groupBy(*by).agg(F.sum(psi_term(F.col("e"), F.lit(0.0))).alias("alone"))
    cur = counts.where(~first).join(totals.where(~first), [*by, window_col]).select(*by, window_col, "bin", (F.col("n") / F.col("t")).alias("a"))
    r = ref.withColumnsRenamed({k: f"_r_{k}" for k in by})
    met = cur.join(r, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by], F.col("bin") == F.col("rbin")), "left")
    term = psi_term(F.coalesce("e", F.lit(0.0)), "a") - F.when(F.col("e").isNotNull(), psi_term(F.col("e"), F.lit(0.0))).otherwise(0.0)
    p = met.groupBy(*by, window_col).agg(F.sum(term).alias("own"))
    if by:
        o = alone.withColumnsRenamed({k: f"_a_{k}" for k in by})
        p = p.join(o, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in by]), "left")
    else:
        p = p.crossJoin(alone)  # one row
    return p.select(*by, F.concat(F.lit(label_prefix), F.col(window_col).cast("string")).alias("label"),
                    F.col(window_col), (F.col("own") + F.coalesce("alone", F.lit(0.0))).alias("value"))


PER_DIGEST = 4  # iterations that one hash serves
SPAN = 1 << 32


def draw_number(id_col: str, iteration: int, seed_prefix: str = "") -> Column:
    """A row's number in an iteration: eight of the hexadecimal digits of a hash of its id, which are ordered like the
    number that they write."""
    block, part = divmod(iteration, PER_DIGEST)
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed_prefix}{block}")).cast("binary"))
    return F.substring(digest, 8 * part + 1, 8)


def draw_limits(df: DataFrame, id_col: str, iterations: int, sample_frac: float, seed_prefix: str = "") -> DataFrame:
    """``(iteration, number, id)``: the last of the ``max(1, int(n * sample_frac))`` rows with the least (number, id) of each
    iteration. The numbers are uniform, so the limit lies in a narrow range of them: the rows below it are counted and only
    the rows inside (some multiple of the root of n) are ranked; a range that misses the limit is widened."""
    n = df.count()
    m = min(n, max(1, int(n * sample_frac)))
    rows = df.select(F.col(id_col).alias("id"), *[draw_number(id_col, i, seed_prefix).alias(f"d{i}") for i in range(iterations)])
    found, open_, width = [], list(range(iterations)) if n else [], 6.0
    while open_:
        middle, half = m / n, width * (max(sample_frac * (1 - sample_frac), 1 / n) / n) ** 0.5
        low, high = (f"{v:08x}" for v in (max(0, int((middle - half) * SPAN)), min(SPAN - 1, int((middle + half) * SPAN) + 1)))
        below = rows.agg(*[F.count_if(F.col(f"d{i}") < low).alias(f"b{i}") for i in open_]).first()  # a number an iteration
        inside = F.array(*[F.struct(F.lit(i).alias("iteration"), F.col(f"d{i}").alias("number")) for i in open_])
        inside = rows.select("id", F.explode(F.filter(inside, lambda s: (s["number"] >= low) & (s["number"] <= high))).alias("s")).select("s.*", "id")
        ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("iteration").orderBy("number", "id")))
        wanted = F.get(F.array(*[F.lit(m - below[f"b{i}"] if i in open_ else 0) for i in range(iterations)]), F.col("iteration"))
        limits = materialize(ranked.where(F.col("r") == wanted).drop("r"), "limits")
        got = {r["iteration"] for r in limits.select("iteration").collect()}  # a row an iteration
        found.append(limits)
        open_, width = [i for i in open_ if i not in got], width * 16
    return reduce(DataFrame.unionByName, found) if found else rows.select(F.lit(0).alias("iteration"), F.lit("").alias("number"), "id").limit(0)


def bootstrap_stability(df: DataFrame, value_col: str, id_col: str, iterations: int = 20, sample_frac: float = 0.5,
                        seed_prefix: str = "", bins: int = DEFAULT_BINS) -> DataFrame:
    """STB7: reference = all rows, sample i = exactly ``max(1, int(n * sample_frac))`` of them without replacement, rows with
    a missing value among them (they count for nothing then). One bin per row, and one conditional count
    per iteration in the same aggregate (no row expansion). Numbers go through quantile bins, text and booleans by category."""
    v = known(df, value_col)
    limits = {r["iteration"]: r for r in draw_limits(df, id_col, iterations, sample_frac, seed_prefix).collect()}  # a row an iteration
    clean = df.where(v.isNotNull()).select(id_col, value_col)
    numeric = isinstance(df.schema[value_col].dataType, T.NumericType)
    if numeric:
        edges = bin_edges(clean, value_col, id_col, bins)
        binned = with_bins(clean, edges, value_col)
    else:
        binned = clean.withColumn("bin", v.cast("string"))

    def drawn(i: int) -> Column:
        if i not in limits:
            return F.lit(False)
        number, last = F.col(f"d{i}"), limits[i]
        return (number < last["number"]) | ((number == last["number"]) & (F.col(id_col) <= F.lit(last["id"])))

    binned = binned.select("bin", id_col, *[draw_number(id_col, i, seed_prefix).alias(f"d{i}") for i in range(iterations)])
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("ref_n"), *[F.count_if(drawn(i)).alias(f"c{i}") for i in range(iterations)])
    grid = bin_grid(edges).join(counts, "bin", "left").fillna(0) if numeric else counts
    long = grid.select("bin", "ref_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("iteration"), F.col(f"c{i}").alias("cur_n")) for i in range(iterations)])).alias("_s"))
    p = psi_from_counts(materialize(long.select("bin", "ref_n", "_s.iteration", "_s.cur_n"), "draws"), ["iteration"])
    return p.select("iteration", F.col("psi").alias("value"))


def decile_edges(ref: DataFrame, value_col: str, id_col: str, n: int = DEFAULT_BINS,
                 by: Sequence[str] = ()) -> DataFrame:
    return bin_edges(ref, value_col, id_col, n, by)


def score_decile_stability(df: DataFrame, score_col: str, id_col: str, is_ref: Column, is_cur: Column,
                           n: int = DEFAULT_BINS) -> DataFrame:
    """STB10: share of each side per right-closed reference decile, with the
    (left-closed) PSI of the two score samples and its class."""
    clean = df.where(known(df, score_col).isNotNull()).select(id_col, score_col, is_ref.alias("_isref"), is_cur.alias("_iscur"))
    edges = decile_edges(clean.where("_isref"), score_col, id_col, n)
    binned = with_bins(clean, edges, score_col, right_closed=True, bin_col="decile")
    per = binned.groupBy("decile").agg(F.count_if("_isref").alias("_r"), F.count_if("_iscur").alias("_c"))
    per = per.where((F.col("_r") > 0) | (F.col("_c") > 0))  # labels present on either side
    tot = per.agg(F.sum("_r").alias("_tr"), F.sum("_c").alias("_tc"))
    shares = per.crossJoin(tot).select(
        "decile", (F.col("_r") / F.greatest(F.col("_tr"), F.lit(1))).alias("reference_pct"),
        (F.col("_c") / F.greatest(F.col("_tc"), F.lit(1))).alias("current_pct"))
    # PSI uses the same reference quantiles (left-closed bins): reuse the edges
    psi = psi_numeric(clean, score_col, id_col, F.col("_isref"), F.col("_iscur"), bins=n, edges=edges)
    return shares.crossJoin(psi.select("psi", classify_psi("psi").alias("flag")))


def target_rate_by_decile(df: DataFrame, score_col: str, y_col: str, id_col: str,
                          bucket_col: str | None = None, n: int = DEFAULT_BINS) -> DataFrame:
    """STB11/AGG1: mean target per decile (deciles of the whole score column) overall
    and per time bucket in one ``GROUPING SETS`` aggregation; ``bucket`` null = overall."""
    clean = df.where(known(df, score_col).isNotNull())
    edges = decile_edges(clean, score_col, id_col, n)
    binned = with_bins(clean, edges, score_col, right_closed=True, bin_col="decile").withColumn(
        "bucket", (F.col(bucket_col) if bucket_col else F.lit(None)).cast("string"))
    rows = binned.groupingSets([["decile"], ["bucket", "decile"]], "bucket", "decile").agg(F.avg(F.col(y_col).cast("double")).alias("rate"))
    return rows.select("bucket", "decile", "rate")


def is_non_decreasing(rates: DataFrame, order_col: str, rate_col: str = "rate",
                      slack: float = 1e-9) -> DataFrame:
    """STB12: ``bool_and(rate >= previous rate - slack)`` (true for 0 or 1 rows). The
    input is one row per decile, so the ordered window is over at most ``n`` rows."""
    w = Window.orderBy(order_col)
    prev = F.lag(rate_col).over(w)
    ok = rates.select(F.coalesce(F.col(rate_col) >= prev - slack, F.lit(True)).alias("_ok"))
    return ok.agg(F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("is_monotonic"))


def stability_report(values: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """STB9: per feature the worst window value (csi) and its label, plus its class."""
    by = list(by)
    agg = values.groupBy(*by).agg(
        F.coalesce(F.max("value"), F.lit(0.0)).alias("csi"),
        F.max_by("label", F.struct(F.col("value"), F.col("label"))).alias("worst_label"))
    return agg.withColumn("flag", classify_psi("csi"))
