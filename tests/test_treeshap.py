"""Exact tree SHAP: efficiency against the model margin and brute-force Shapley values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from foldwise.operators.treeshap import expected_value, goes_left, read_trees, shap_values


def _coalition_values(t, X, S):
    """The tree's expectation when the features in ``S`` are known: by its definition, node by node."""
    w = {t.order[0]: np.ones(len(X))}
    out = np.zeros(len(X))
    for i in t.order:
        if t.left[i] < 0:
            out += w[i] * t.value[i]
            continue
        left = goes_left(t, i, X) if int(t.feature[i]) in S else t.cover[t.left[i]] / t.cover[i]
        w[t.left[i]], w[t.right[i]] = w[i] * left, w[i] * (1 - left)
    return out


def test_tree_shap_efficiency_and_brute_force(spark):
    rng = np.random.default_rng(16)
    X = rng.uniform(0, 1, (300, 3))
    y = ((X[:, 0] + 0.5 * X[:, 1]) > 0.8).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(t)) for (a, b, c), t in zip(X, y)],
                               "a double, b double, c double, y int")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    m = GBTClassifier(featuresCol="f", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(df)
    trees = read_trees(m, spark)
    pred = m.transform(df).select(vector_to_array("f").alias("x"), vector_to_array("rawPrediction")[1].alias("m")).toPandas()
    Xs = np.vstack(pred["x"].to_numpy())
    phi = shap_values(trees, Xs)
    base = expected_value(trees)
    assert phi.sum(axis=1) + base == pytest.approx(pred["m"].to_numpy(), abs=1e-9)
    # brute force over all coalitions of the 3 features for the first tree, first rows
    t = trees[0]
    full = [0, 1, 2]
    for r in range(3):
        x = Xs[r:r + 1]
        for i in full:
            acc = 0.0
            others = [u for u in full if u != i]
            for k in range(3):
                for S in itertools.combinations(others, k):
                    wgt = math.factorial(k) * math.factorial(3 - k - 1) / math.factorial(3)
                    acc += wgt * (_coalition_values(t, x, frozenset(S) | {i})[0] - _coalition_values(t, x, frozenset(S))[0])
            assert shap_values([t], x)[0, i] == pytest.approx(t.weight * acc, abs=1e-12)


def test_deep_trees_on_many_features(spark):
    """Depth 6 on 40 features: the values still add up to the margin."""
    rng = np.random.default_rng(17)
    X = rng.uniform(0, 1, (400, 40))
    y = ((X @ rng.normal(size=40)) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(X, y)], ", ".join(f"c{i} double" for i in range(40)) + ", y int")
    df = VectorAssembler(inputCols=[f"c{i}" for i in range(40)], outputCol="f").transform(df)
    m = GBTClassifier(featuresCol="f", labelCol="y", maxIter=3, maxDepth=6, seed=1).fit(df)
    trees = read_trees(m, spark)
    assert max(len({int(f) for f in t.feature if f >= 0}) for t in trees) > 12
    pred = m.transform(df).select(vector_to_array("f").alias("x"), vector_to_array("rawPrediction")[1].alias("m")).toPandas()
    phi = shap_values(trees, np.vstack(pred["x"].to_numpy()))
    assert phi.sum(axis=1) + expected_value(trees) == pytest.approx(pred["m"].to_numpy(), abs=1e-9)
