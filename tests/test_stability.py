"""PSI/CSI, bins and stability classes (hand-computed values and numpy/pandas parity)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.functions.scalar import classify_psi, left_closed_bin, psi_term, right_closed_bin
from foldwise.operators import stability as st


def _psi_of(spark, e, a):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(e, a))]
    df = spark.createDataFrame(rows, "bin int, e double, a double")
    return df.agg(F.sum(psi_term("e", "a")).alias("p")).first()["p"]


def test_psi_from_proportions_exact(spark):
    assert _psi_of(spark, [0.5, 0.5], [0.6, 0.4]) == pytest.approx(0.04054651081, abs=1e-9)


def test_psi_identical_is_zero(spark):
    assert _psi_of(spark, [0.2, 0.3, 0.5], [0.2, 0.3, 0.5]) == pytest.approx(0.0, abs=1e-12)


def test_psi_floor_is_applied(spark):
    expected = (0.5 - 1e-4) * math.log(0.5 / 1e-4) + (0.5 - 1.0) * math.log(0.5 / 1.0)
    assert _psi_of(spark, [0.0, 1.0], [0.5, 0.5]) == pytest.approx(expected, rel=1e-12)


@pytest.mark.parametrize("v,cls", [(0.05, "stable"), (0.0999, "stable"), (0.1, "watch"), (0.15, "watch"),
                                   (0.25, "unstable"), (0.30, "unstable")])
def test_classify(spark, v, cls):
    assert spark.range(1).select(classify_psi(F.lit(v)).alias("c")).first()["c"] == cls


def test_csi_categorical_union_of_categories(spark):
    rows = [(i, "A" if i < 500 else "B", True) for i in range(1000)]
    rows += [(1000 + i, "A" if i < 900 else "B", False) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, c string, is_ref boolean")
    csi = st.csi_categorical(df, "c", F.col("is_ref"), ~F.col("is_ref")).first()["psi"]
    assert csi == pytest.approx(_psi_of(spark, [0.5, 0.5], [0.9, 0.1]), abs=1e-12)


def test_constant_reference_does_not_fail(spark):
    rows = [(i, 5.0, True) for i in range(200)] + [(200 + i, 6.0 if i % 10 == 0 else 5.0, False) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, is_ref boolean")
    p = st.psi_numeric(df, "x", "id", F.col("is_ref"), ~F.col("is_ref")).first()["psi"]
    assert p >= 0.0


def test_shifted_normal_is_unstable_and_same_is_stable(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(0, 1, 3000), rng.normal(0, 1, 3000), rng.normal(1.0, 1, 3000)
    rows = [(i, float(v), "ref") for i, v in enumerate(a)] + [(3000 + i, float(v), "same") for i, v in enumerate(b)] \
        + [(6000 + i, float(v), "shift") for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "id long, x double, side string")
    same = st.psi_numeric(df, "x", "id", F.col("side") == "ref", F.col("side") == "same").first()["psi"]
    shift = st.psi_numeric(df, "x", "id", F.col("side") == "ref", F.col("side") == "shift").first()["psi"]
    assert same < 0.1 and shift >= 0.25


def test_bins_match_numpy_and_pandas(spark):
    rng = np.random.default_rng(1)
    ref = rng.integers(0, 20, 400).astype(float)  # many ties
    cur = rng.integers(-5, 25, 300).astype(float)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    np_counts, _ = np.histogram(cur, bins=edges)
    pd_counts = pd.cut(pd.Series(cur), bins=edges, labels=False, include_lowest=True).value_counts().sort_index()
    inner = [float(e) for e in edges[1:-1]]
    df = spark.createDataFrame([(float(v),) for v in cur], "x double")
    arr = F.array(*[F.lit(e) for e in inner])
    got = df.select(left_closed_bin("x", arr).alias("l"), right_closed_bin("x", arr).alias("r")).toPandas()
    assert got["l"].value_counts().sort_index().reindex(range(len(np_counts)), fill_value=0).tolist() == list(np_counts)
    assert got["r"].value_counts().sort_index().to_dict() == pd_counts.to_dict()


def test_bin_edges_match_numpy(spark):
    rng = np.random.default_rng(2)
    ref = rng.normal(0, 1, 501)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(ref)], "id long, x double")
    e = st.bin_edges(df, "x", "id", 10).first()
    expected = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    assert e["inner"] == pytest.approx(list(expected[1:-1]), rel=1e-12)
    assert e["edges"][0] == float("-inf") and e["edges"][-1] == float("inf")


def test_bootstrap_stability_small(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(0, 1, 2000))], "id long, x double")
    b = st.bootstrap_stability(df, "x", "id", iterations=5).toPandas()
    assert len(b) == 5 and (b["value"] < 0.1).all()


def test_decile_monotonic_and_target_rate(spark):
    rng = np.random.default_rng(4)
    s = rng.uniform(0, 1, 3000)
    y = (rng.uniform(0, 1, 3000) < s).astype(int)
    bucket = np.where(np.arange(3000) < 1500, "window_1", "window_2")
    df = spark.createDataFrame([(i, float(a), int(b), str(c)) for i, (a, b, c) in enumerate(zip(s, y, bucket))],
                               "id long, score double, y int, bucket string")
    rates = st.target_rate_by_decile(df, "score", "y", "id", bucket_col="bucket")
    overall = rates.where(F.col("bucket").isNull())
    assert overall.count() == 10
    assert st.is_non_decreasing(overall, "decile").first()["is_monotonic"] in (True, False)
    assert rates.where(F.col("bucket") == "window_1").count() == 10


def test_nan_is_left_out_of_bins_and_shares(spark):
    rows = [(i, float(i % 7), i < 50) for i in range(100)]
    holes = rows + [(1000 + i, float("nan") if i % 2 else None, i < 10) for i in range(30)]
    with_holes, without = (spark.createDataFrame(r, "row_id long, x double, ref boolean") for r in (holes, rows))
    a, b = (st.psi_numeric(d, "x", "row_id", F.col("ref"), ~F.col("ref")).first()["psi"] for d in (with_holes, without))
    assert a == pytest.approx(b, abs=1e-12)


@pytest.mark.parametrize("kind", ["double", "string", "boolean"])
def test_csi_by_type_and_of_an_empty_column(spark, kind):
    empty = spark.createDataFrame([(1, None, True), (2, None, False)], f"row_id long, x {kind}, ref boolean")
    r = st.csi(empty, "x", "row_id", F.col("ref"), ~F.col("ref")).first()
    assert (r["csi"], r["flag"]) == (0.0, "stable")
    full = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").cast(kind).alias("x"), (F.col("id") < 100).alias("ref"))
    r = st.csi(full, "x", "row_id", F.col("ref"), ~F.col("ref")).first()
    assert r["csi"] == pytest.approx(0.0, abs=1e-9) and r["flag"] == "stable"


def test_no_value_has_no_class(spark):
    assert spark.range(1).select(classify_psi(F.lit(None).cast("double")).alias("c")).first()["c"] is None


def test_bootstrap_of_categories_and_many_iterations(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("cat"))
    got = st.bootstrap_stability(df, "cat", "row_id", iterations=130).collect()
    assert len(got) == 130 and all(0 <= r["value"] < 0.02 for r in got) and len({r["value"] for r in got}) > 100


def test_bootstrap_draws_exactly_the_rows_of_least_number(spark):
    df = spark.range(500).select(F.concat(F.lit("r"), F.col("id")).alias("row_id")).repartition(3)
    for frac, m in ((0.5, 250), (0.013, 6), (0.0001, 1), (1.0, 500)):
        limits = {r["iteration"]: (r["number"], r["id"]) for r in st.draw_limits(df, "row_id", 6, frac).collect()}
        assert len(limits) == 6
        rows = df.select("row_id", *[st.draw_number("row_id", i).alias(f"d{i}") for i in range(6)]).collect()
        for i, last in limits.items():
            order = sorted((r[f"d{i}"], r["row_id"]) for r in rows)
            assert order[m - 1] == last
    assert st.draw_limits(df.limit(0), "row_id", 2, 0.5).count() == 0


def test_windows_of_categories_equal_the_full_grid(spark):
    rng = np.random.default_rng(5)
    rows = [(int(w), None if c == 9 else f"c{c}") for w, c in zip(rng.integers(0, 4, 600), rng.integers(0, 10, 600))] + [(2, "late"), (0, "early")]
    got = {r["win"]: r["value"] for r in st.temporal_oot_categorical(spark.createDataFrame(rows, "win int, cat string"), "cat", "win").collect()}
    p = pd.crosstab([r[1] for r in rows if r[1]], [r[0] for r in rows if r[1]])
    share = np.maximum(p / p.sum(), 1e-4)
    for w in (1, 2, 3):
        seen = (p[0] > 0) | (p[w] > 0)
        want = ((share[w] - share[0]) * np.log(share[w] / share[0]))[seen].sum()
        assert got[w] == pytest.approx(want, abs=1e-9)
