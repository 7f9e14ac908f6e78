"""Histogram metrics against brute force over pairs / thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators.scoring import binary_metrics, histogram, rank_metrics, single_feature_auc


def brute(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    thr = sorted(set(s), reverse=True)
    ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / len(pos)
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    xs = sorted(set(s))
    ks = max(abs(sum(1 for v in pos if v <= x) / len(pos) - sum(1 for v in neg if v <= x) / len(neg)) for x in xs)
    return auc, ap, ks


def test_rank_metrics_match_brute_force(spark):
    rng = np.random.default_rng(7)
    s = np.round(rng.uniform(0, 1, 400), 2)  # ties
    y = (rng.uniform(0, 1, 400) < s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    m = rank_metrics(histogram(df, "s", "y"), n_buckets=7).first()
    auc, ap, ks = brute(list(y), list(s))
    assert m["auc"] == pytest.approx(auc, abs=1e-12)
    assert m["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert m["ks"] == pytest.approx(ks, abs=1e-12)


def test_ks_perfect_separation(spark):
    rows = [(0, 0.1)] * 100 + [(1, 0.9)] * 100
    df = spark.createDataFrame(rows, "y int, p double")
    assert binary_metrics(df, "p", "y").first()["ks"] == pytest.approx(1.0)


def test_clipping_and_pointwise(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.7), (0, 0.2)], "y int, p double")
    m = binary_metrics(df, "p", "y").first()
    eps = 1e-7
    p = np.clip(np.array([1.0, 0.0, 0.7, 0.2]), eps, 1 - eps)
    y = np.array([1, 0, 1, 0])
    assert m["logloss"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), rel=1e-12)
    assert m["brier"] == pytest.approx(np.mean((p - y) ** 2), rel=1e-12)
    assert m["auc"] == pytest.approx(1.0)


def test_metrics_by_group_in_one_job(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), int(rng.uniform() < 0.4), float(rng.uniform())) for g in range(3) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, y int, p double")
    m = binary_metrics(df, "p", "y", by=["g"]).orderBy("g").toPandas()
    for g in range(3):
        sub = [(y, p) for gg, y, p in rows if gg == g]
        auc, ap, ks = brute([a for a, _ in sub], [b for _, b in sub])
        assert m.loc[g, "auc"] == pytest.approx(auc, abs=1e-12)


def test_single_feature_auc_symmetry_and_nulls(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(v > 0.5), float(v), float(-v), "t", 1.0, None if i % 3 == 0 else float(v))
            for i, v in enumerate(rng.uniform(0, 1, 300))]
    df = spark.createDataFrame(rows, "id long, y int, a double, neg_a double, txt string, const double, sparse double")
    r = {x["feature"]: x for x in single_feature_auc(df, ["a", "neg_a", "txt", "const", "sparse"], "y", "id").collect()}
    assert r["a"]["auc"] == pytest.approx(1.0) and r["a"]["flag"]
    assert r["neg_a"]["auc"] == pytest.approx(1.0)
    assert r["txt"]["auc"] is None and not r["txt"]["flag"]
    assert r["const"]["auc"] is None
    assert r["sparse"]["auc"] == pytest.approx(1.0)


def test_auc_of_negated_score(spark):
    rng = np.random.default_rng(10)
    rows = [(int(rng.uniform() < 0.5), float(rng.integers(0, 20))) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, s double").withColumn("ns", -F.col("s"))
    a = rank_metrics(histogram(df, "s", "y")).first()["auc"]
    b = rank_metrics(histogram(df, "ns", "y")).first()["auc"]
    assert a + b == pytest.approx(1.0, abs=1e-12)


def test_packed_aucs_in_ranges_equal_the_histogram(spark, monkeypatch):
    from foldwise.operators import scoring
    monkeypatch.setattr(scoring, "RANGE_ROWS", 150)  # fourteen ranges
    rows = spark.range(2000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 37 % 500) / 7 + F.col("id") % 3).alias("many"),
                                    F.when(F.col("id") % 10 > 0, F.lit(1.5)).otherwise(F.col("id") % 20 * 1.0).alias("hot"), F.when(F.col("id") % 2 == 0, F.col("id") * 1.0).alias("gaps"))
    got = {r["feature"]: r["auc"] for r in single_feature_auc(rows, ["many", "hot", "gaps"], "y", "id").collect()}
    for c in got:
        want = rank_metrics(histogram(rows, c, "y")).first()["auc"]
        assert got[c] == pytest.approx(max(want, 1 - want), abs=1e-12)


def test_packed_scores_are_sent_as_groups_of_scores(spark):
    import numpy as np
    from foldwise.operators.scoring import packed
    rng = np.random.default_rng(0)
    b = packed({(0, 0): [(rng.random(50_000), rng.integers(0, 2, 50_000))]}, {(0, 0): np.array([0.25, 0.5])})
    assert b.num_rows == 3 and b.nbytes < 50_000 * 8.1  # a row of a histogram held 32 bytes a score
