"""Status gate, promotion decision and report tables (GATE1-3, REP1-4, JOIN8, JOIN9,
JOIN11, SET2, SET4, FN5, FN6).

All inputs are catalog-sized tables (one row per feature, iteration or run), so the
windows here are partitioned by run or feature, or run over a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.scalar import LEAK_AUC_THRESHOLD, fmt_number

# The status ladder, in order.
STATUSES = ["pending", "static_failed", "dynamic_failed", "leakage_rejected", "serving_mismatch",
            "validated", "promoted"]


def gate_status(coverage_ok: Column, auc: Column, parity_ok: Column,
                threshold: float = LEAK_AUC_THRESHOLD, block_leaks: bool = True) -> Column:
    """GATE1: no usable values -> dynamic_failed; single-feature AUC at or above the
    threshold -> leakage_rejected (the reference only flags; ``block_leaks=False`` keeps
    such features validated, Q9); replay mismatch -> serving_mismatch; else validated."""
    s = F.when(~coverage_ok | auc.isNull(), F.lit("dynamic_failed"))
    if block_leaks:
        s = s.when(auc >= threshold, F.lit("leakage_rejected"))
    return s.when(~F.coalesce(parity_ok, F.lit(True)), F.lit("serving_mismatch")).otherwise(F.lit("validated"))


def merge_results(records: DataFrame, key: str, seq_col: str, cols: Sequence[str]) -> DataFrame:
    """JOIN11: per key, each column takes its last non-null value in ``seq`` order."""
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq_col))).alias(c) for c in cols]
    return records.groupBy(key).agg(*aggs)


def with_pending(hypotheses: DataFrame, results: DataFrame, id_col: str = "hypothesis_id",
                 status_col: str = "final_status") -> DataFrame:
    """JOIN8: hypotheses without a result are ``pending``."""
    r = results.select(id_col, status_col)
    return hypotheses.join(r, id_col, "left").withColumn(
        "status", F.coalesce(F.col(status_col), F.lit("pending"))).drop(status_col)


def status_histogram(results: DataFrame, status_col: str = "final_status") -> DataFrame:
    """SET4."""
    return results.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))


def dedupe(*frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET2: union by name, one row per key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(list(keys))


def improvement_streak(metrics: DataFrame, order_col: str = "iteration", value_col: str = "auc_mean",
                       by: Sequence[str] = ("run_id",)) -> DataFrame:
    """GATE3: running best and iterations since the last strict improvement."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order_col)
    before = F.max(value_col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = metrics.withColumn("improved", F.col(value_col) > F.coalesce(before, F.lit(float("-inf"))))
    m = m.withColumn("best_so_far", F.max(value_col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("improved"), F.col(order_col))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # before the first improvement the streak counts from the start of the run
    first = F.min(order_col).over(Window.partitionBy(*by))
    since = F.when(last.isNull(), F.col(order_col) - first + 1).otherwise(F.col(order_col) - last)
    return m.withColumn("since_improvement", since.cast("int"))


def promotion_candidates(results: DataFrame, metrics: DataFrame, stability: DataFrame,
                         selected: DataFrame) -> DataFrame:
    """GATE2: a feature of an iteration is promoted when that iteration's CV AUC beats
    the best so far, the iteration's stability is not unstable, the feature was
    selected and is validated. ``metrics`` carries ``improved`` (improvement_streak)."""
    m = metrics.select("run_id", "iteration", "auc_mean", "improved")
    s = stability.select("run_id", "iteration", "overall_stability_flag")
    return (results.join(m, ["run_id", "iteration"], "inner")
            .join(s, ["run_id", "iteration"], "left")
            .join(selected.select("run_id", "feature_name"), ["run_id", "feature_name"], "left_semi")
            .where(F.col("improved") & (F.coalesce(F.col("overall_stability_flag"), F.lit("stable")) != "unstable")
                   & (F.col("final_status") == "validated")))


def run_digest(hypotheses: DataFrame, results: DataFrame, max_chars: int = 8000, by: str = "run_id", id_col: str = "hypothesis_id") -> DataFrame:
    """FN6: one text per run, a line per hypothesis in the order tried: iteration, description, status, and of those with a
    result the single-feature AUC and the leakage verdict. Longer texts are cut 20 characters short of ``max_chars`` and
    say so. Lines are gathered per run (catalog-sized)."""
    r = results.select(id_col, "final_status", "auc", "leak_flag")
    j = hypotheses.join(r, id_col, "left")
    auc = F.when(F.col("auc").isNotNull(), F.concat(F.lit(", single_feature_auc="), fmt_number("auc", 3))).otherwise("")
    verdict = F.when(F.col("leak_flag").isNotNull(), F.concat(F.lit(", leakage_review="), F.when(F.col("leak_flag"), "reject").otherwise("approve"))).otherwise("")
    line = F.concat(F.format_string("- [iter %d] %s -> status=%s", F.col("iteration"), F.col("description"), F.coalesce("final_status", F.lit("pending"))), auc, verdict)
    lines = F.sort_array(F.collect_list(F.struct("iteration", "pos", line.alias("l"))))
    text = F.array_join(F.transform(lines, lambda s: s["l"]), "\n")
    return j.groupBy(by).agg(text.alias("t")).select(by, F.when(F.length("t") > max_chars, F.concat(F.substring("t", 1, max_chars - 20), F.lit("\n... (truncated)")))
                                                     .otherwise(F.col("t")).alias("digest"))
