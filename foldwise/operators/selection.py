"""Feature selection as frames (SEL1-SEL5, PRJ10, WIN4).

Every result is a DataFrame with a row per feature or per search step: candidate scores, lifts,
redundancy labels, survivors, the forward search's steps and the round's catalog row. What the driver
holds is feature names and one number for each feature set; a step's sets are fitted and scored together
(``models.set_aucs``), so the scans follow the steps and not the candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.profile import correlation_pairs
from foldwise.session import materialize

# Fixed values of the selection round.
CORRELATION_THRESHOLD = 0.95
MIN_LIFT = 0.001
MAX_EVALS = 50
MIN_IMPROVEMENT = 1e-4
BASELINE_IMPORTANCE_PROXY = 1.0
EMPTY_SET_AUC = 0.5

#: The cross-validated AUC of each of several feature sets.
SetAucs = Callable[[list[list[str]]], list[float]]
NOT_NUMERIC = ("string", "boolean", "timestamp", "timestamp_ntz", "date")


# ---------------------------------------------------------------------------- redundancy


def spread_labels(names: DataFrame, edges: DataFrame) -> DataFrame:
    """``(feature, cluster)``: the least position that a feature reaches over ``edges`` (a, b), by
    handing labels to neighbours until none gets smaller. ``names``: (feature, pos)."""
    ways = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = names.select("feature", F.col("pos").alias("label"))
    changed = True
    while changed:
        offered = ways.join(labels, ways["b"] == labels["feature"]).groupBy("a").agg(F.min("label").alias("offer"))
        step = labels.join(offered, labels["feature"] == offered["a"], "left").select(
            "feature", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("less"))
        step = materialize(step, "labels")
        changed = not step.where("less").isEmpty()
        labels = step.select("feature", "label")
    return labels.withColumnRenamed("label", "cluster")


def positions(spark: SparkSession, features: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, pos int")


def redundancy_clusters(df: DataFrame, features: Sequence[str], threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """SEL2: ``(cluster, feature)``, features whose absolute correlations of at least ``threshold`` connect
    them; the label is a cluster's first name in the alphabet. Features that aren't numeric stand alone."""
    kinds, names = dict(df.dtypes), positions(df.sparkSession, features)
    numeric = [f for f in features if kinds[f] not in NOT_NUMERIC]
    if len(numeric) < 2:
        return names.select(F.col("feature").alias("cluster"), "feature")
    near = correlation_pairs(df, numeric).where(F.abs("corr") >= threshold)
    labels = spread_labels(names, near)
    first = labels.groupBy("cluster").agg(F.min("feature").alias("name"))
    return labels.join(first, "cluster").select(F.col("name").alias("cluster"), "feature")


def redundancy_survivors(clusters: DataFrame, importance: DataFrame, order: Sequence[str]) -> DataFrame:
    """SEL3: per cluster keep the most important member, the earliest listed on ties
    (``max_by`` over (importance, -position))."""
    pos = clusters.sparkSession.createDataFrame([(f, i) for i, f in enumerate(order)],
                                                "feature string, pos int")
    imp = importance.select("feature", F.round("importance", 12).alias("importance"))
    j = clusters.join(pos, "feature").join(imp, "feature", "left")
    key = F.struct(F.coalesce(F.col("importance"), F.lit(0.0)).alias("i"), (-F.col("pos")).alias("p"))
    return j.groupBy("cluster").agg(F.max_by("feature", key).alias("survivor"))


def lift_accept_reject(lifts: DataFrame, min_lift: float = MIN_LIFT) -> DataFrame:
    """PRJ10: ``accepted = lift >= min_lift``; a null lift is rejected."""
    return lifts.withColumn("accepted", F.coalesce(F.col("lift") >= min_lift, F.lit(False)))


def step_lifts(trace: DataFrame, baseline_col: str = "baseline_auc") -> DataFrame:
    """WIN4: per selection round, ``lift = auc - previous auc`` (baseline for the first
    step). ``trace`` rows: (iteration, baseline_auc, auc_trace array<struct<feature, auc>>)."""
    from pyspark.sql import Window
    ex = trace.select("iteration", baseline_col, F.posexplode("auc_trace").alias("step", "s"))
    ex = ex.select("iteration", baseline_col, "step", F.col("s.feature").alias("feature"),
                   F.col("s.auc").alias("auc"))
    w = Window.partitionBy("iteration").orderBy("step")
    return ex.withColumn("lift", F.col("auc") - F.coalesce(F.lag("auc").over(w), F.col(baseline_col))) \
        .drop(baseline_col)


# ---------------------------------------------------------------------------- model-driven search


def candidate_scores(spark: SparkSession, set_aucs: SetAucs, start: Sequence[str], candidates: Sequence[str]) -> DataFrame:
    """``(pos, feature, auc)``: the cross-validated AUC of ``start`` with each candidate."""
    aucs = set_aucs([[*start, f] for f in candidates])
    return spark.createDataFrame([(i, f, float(a)) for i, (f, a) in enumerate(zip(candidates, aucs, strict=True))], "pos int, feature string, auc double")


def alone_auc(set_aucs: SetAucs, features: Sequence[str]) -> float:
    return float(set_aucs([list(features)])[0]) if features else EMPTY_SET_AUC


def best_candidate(scores: DataFrame, floor: float, gain: float) -> DataFrame:
    """One row (feature, auc): read in order, each candidate that beats the best so far by more than
    ``gain`` takes its place (Q15); null if none beats ``floor``."""
    none = F.struct(F.lit(None).cast("string").alias("feature"), F.lit(float(floor)).alias("auc"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "feature", "auc")))
    return scores.agg(ordered.alias("c")).select(F.aggregate("c", none, lambda best, c: F.when(
        c["auc"] > best["auc"] + F.lit(gain), F.struct(c["feature"].alias("feature"), c["auc"].alias("auc"))).otherwise(best)).alias("b")).select("b.*")


def forward_search(spark: SparkSession, set_aucs: SetAucs, start: Sequence[str], candidates: Sequence[str], max_evals: int = MAX_EVALS,
                   min_improvement: float = MIN_IMPROVEMENT) -> DataFrame:
    """SEL4: ``(step, feature, auc, evals)``; step 0 is ``start`` itself, each further one the feature it
    adds. ``evals`` counts the model fits up to then, at most ``max_evals``; a last row without a feature
    closes a search in which no candidate was good enough."""
    steps = [(0, None, alone_auc(set_aucs, start), int(bool(start)))]
    taken = list(start)
    while True:
        number, _, auc, evals = steps[-1]
        tried = [c for c in candidates if c not in taken][:max(0, max_evals - evals)]
        if not tried:
            break
        found = best_candidate(candidate_scores(spark, set_aucs, taken, tried), auc, min_improvement).first()
        steps.append((number + 1, found["feature"], found["auc"], evals + len(tried)))
        if found["feature"] is None:
            break
        taken.append(found["feature"])
    return spark.createDataFrame(steps, "step int, feature string, auc double, evals int")


def lift_screen(spark: SparkSession, set_aucs: SetAucs, baseline: Sequence[str], candidates: Sequence[str], min_lift: float = MIN_LIFT) -> DataFrame:
    """SEL1: ``(pos, feature, baseline_auc, auc, lift, accepted)`` of each candidate on top of ``baseline``, the baseline
    fitted along with them."""
    alone, *aucs = set_aucs([list(baseline), *[[*baseline, f] for f in candidates]])
    rows = [(i, f, float(a)) for i, (f, a) in enumerate(zip(candidates, aucs, strict=True))]
    scores = spark.createDataFrame(rows, "pos int, feature string, auc double").withColumn("baseline_auc", F.lit(float(alone) if baseline else EMPTY_SET_AUC))
    return lift_accept_reject(scores.withColumn("lift", F.col("auc") - F.col("baseline_auc")), min_lift)


def selection_round(df: DataFrame, set_aucs: SetAucs, baseline: Sequence[str], candidates: Sequence[str], iteration: int = 0,
                    threshold: float = CORRELATION_THRESHOLD, min_lift: float = MIN_LIFT, max_evals: int = MAX_EVALS) -> DataFrame:
    """SEL5: the round's catalog row. Accepted candidates join the baseline, each redundant cluster keeps its
    most important member (baseline features count ``BASELINE_IMPORTANCE_PROXY``, candidates their lift), and
    the survivors go through the forward search. Without an accepted candidate the baseline stays."""
    spark = df.sparkSession
    screened = materialize(lift_screen(spark, set_aucs, baseline, candidates, min_lift), "lifts")
    passed = screened.where("accepted").select("feature", "lift").collect()  # names
    names = [*baseline, *sorted((r["feature"] for r in passed), key=list(candidates).index)]
    weight = screened.select("feature", F.col("lift").alias("importance")).union(
        spark.createDataFrame([(b, BASELINE_IMPORTANCE_PROXY) for b in baseline], "feature string, importance double"))
    clusters = materialize(redundancy_clusters(df, names, threshold) if passed else positions(spark, names).select(F.col("feature").alias("cluster"), "feature"), "clusters")
    kept = sorted((r["survivor"] for r in redundancy_survivors(clusters, weight, names).collect()), key=names.index)  # names
    start, open_ = [f for f in kept if f in baseline], [f for f in kept if f not in baseline]
    steps = materialize(forward_search(spark, set_aucs, start, open_, max_evals), "steps")
    as_list = lambda c: F.array_sort(F.collect_list(c))
    names_of = lambda c: F.transform(as_list(c), lambda x: x["feature"])
    ranked = F.struct("pos", "feature")
    head = screened.agg(F.max("baseline_auc").alias("first_auc"), names_of(F.when(F.col("accepted"), ranked)).alias("accepted"),
                        names_of(F.when(~F.col("accepted"), ranked)).alias("rejected"))
    groups = clusters.join(positions(spark, names), "feature").groupBy("cluster").agg(F.min("pos").alias("pos"), names_of(ranked).alias("feature"))
    groups = groups.agg(names_of(F.struct("pos", "feature")).alias("clusters"))
    added = F.when(F.col("step") > 0, F.when(F.col("feature").isNotNull(), F.struct("step", "feature", "auc")))
    search = steps.agg(F.max(F.when(F.col("step") == 0, F.col("auc"))).alias("baseline_auc"), F.max_by("auc", "step").alias("final_auc"),
                       as_list(added).alias("added"))
    row = head.crossJoin(groups).crossJoin(search)  # one row each
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return row.select(F.lit(iteration).alias("iteration"), "baseline_auc", "final_auc", "accepted", "rejected", "clusters", array(kept).alias("kept"),
                      F.concat(array(start), F.transform("added", lambda x: x["feature"])).alias("final_selected"),
                      F.transform("added", lambda x: F.struct(x["feature"].alias("feature"), x["auc"].alias("auc"))).alias("auc_trace"))
