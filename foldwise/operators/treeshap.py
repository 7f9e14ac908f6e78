"""Exact path-dependent tree SHAP for boosted trees (SHAP1, trees).

The trees are those of ``boost``; a fitted ``pyspark.ml`` model's are read from its saved Parquet ``data`` folder (one row per
node: split feature, threshold or left categories, children, leaf value, training count).
Only trees x nodes numbers are shipped to the tasks. Inside
``mapInArrow`` the Shapley values of every row are computed exactly, vectorised over the rows of
a block, leaf by leaf. A coalition reaches a leaf with the product, over the d features on its path, of
z_j (the share of training rows that go the leaf's way, for features outside the coalition) or o_j (1 if
the row itself goes that way, else 0). So feature i gets, from a leaf of value v,

    v * (o_i - z_i) * sum over k of k! (d - 1 - k)! / d! * [t^k] prod over j <> i of (z_j + o_j t),

d^3 steps a leaf instead of 2^d coalitions: any depth and any number of features will do. Values are in
the model's margin space and are added over trees with the ensemble's tree weights.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.logit import array_column, plain_column
from foldwise.session import checkpoint_dir

BLOCK = 1 << 16  # rows explained together
WAYS = 24  # nodes whose ways are told apart at once
FEW = 16  # nodes whose ways are told apart by a table


@dataclass
class Tree:
    feature: np.ndarray    # split feature per node, -1 for leaves
    threshold: np.ndarray  # continuous split: left when x <= threshold
    left_cats: list        # categorical split: set of categories going left (or None)
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    order: list            # nodes, parents before children
    weight: float


def read_trees(model, spark) -> list[Tree]:
    """Trees of a GBT model (classifier or regressor) through its saved form."""
    path = os.path.join(checkpoint_dir(spark), "models", "gbt-" + uuid.uuid4().hex)
    model.save(path)
    weights = list(model.treeWeights)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").collect()  # trees x nodes rows
    by_tree: dict[int, list] = {}
    for r in nodes:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for tid in sorted(by_tree):
        rows = sorted(by_tree[tid], key=lambda r: r["id"])
        n = max(r["id"] for r in rows) + 1
        feat, thr = np.full(n, -1), np.zeros(n)
        left, right = np.full(n, -1), np.full(n, -1)
        val, cov = np.zeros(n), np.zeros(n)
        cats = [None] * n
        for r in rows:
            i = r["id"]
            val[i], cov[i] = r["prediction"], float(r["rawCount"])
            if r["leftChild"] >= 0:
                feat[i], left[i], right[i] = r["featureIndex"], r["leftChild"], r["rightChild"]
                if r["numCategories"] is not None and r["numCategories"] >= 0:
                    cats[i] = set(r["leftCategoriesOrThreshold"])
                else:
                    thr[i] = r["leftCategoriesOrThreshold"][0]
        root = 0
        order, stack = [], [root]
        while stack:
            i = stack.pop()
            order.append(i)
            if left[i] >= 0:
                stack += [right[i], left[i]]
        trees.append(Tree(feat, thr, cats, left, right, val, cov, order, float(weights[tid])))
    return trees


def leaf_paths(t: Tree) -> list[tuple[float, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
    """(value, {feature: (share z, [(node, left)])}) of every leaf; the conditions of one feature on a path
    count as one."""
    out, todo = [], [(t.order[0], {})]
    while todo:
        i, path = todo.pop()
        if t.left[i] < 0:
            out.append((float(t.value[i]), path))
            continue
        f = int(t.feature[i])
        z, steps = path.get(f, (1.0, []))
        for child, left in ((t.left[i], True), (t.right[i], False)):
            share = t.cover[child] / t.cover[i] if t.cover[i] > 0 else 0.0
            todo.append((child, path | {f: (z * share, [*steps, (i, left)])}))
    return out


def goes_left(t: Tree, node: int, X: np.ndarray) -> np.ndarray:
    x = X[:, t.feature[node]]
    return np.isin(x, list(t.left_cats[node])) if t.left_cats[node] is not None else x <= t.threshold[node]


def same_ways(ways: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each group, group of each of ``n`` rows): rows of a group go the same way at every node."""
    group, first = np.zeros(n, np.int64), np.arange(min(n, 1))
    for at in range(0, len(ways), WAYS):
        code = group << WAYS
        for b, way in enumerate(ways[at:at + WAYS]):
            code |= way.astype(np.int64) << b
        if len(ways) <= FEW:
            there = np.zeros(1 << len(ways), bool)
            there[code] = True
            group, found = (np.cumsum(there) - 1).take(code), np.flatnonzero(there)
        else:
            group, found = pd.factorize(code)
        first = np.zeros(len(found), np.int64)
        first[group] = np.arange(n)
    return first, group


def shap_values(trees: Sequence[Tree], X: np.ndarray) -> np.ndarray:
    """Rows x features SHAP matrix (margin space) of a tree ensemble. Rows that go the same way at every node of a tree have
    the same values from it, so each tree is worked out for one row of every such group."""
    X, phi = np.asfortranarray(X), np.zeros(X.shape)
    for t in trees:
        nodes = [i for i in range(len(t.feature)) if t.left[i] >= 0]
        first, group = same_ways([goes_left(t, i, X) for i in nodes], len(X))
        phi += tree_shap(t, X[first])[group]
    return phi


def tree_shap(t: Tree, X: np.ndarray) -> np.ndarray:
    """The values of one tree, leaf by leaf."""
    phi = np.zeros(X.shape)
    way = {i: goes_left(t, i, X) for i in range(len(t.feature)) if t.left[i] >= 0}
    for value, path in leaf_paths(t):
        d = len(path)
        weights = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
        z = {f: share for f, (share, _) in path.items()}
        o = {f: np.logical_and.reduce([way[i] == left for i, left in steps]).astype(float) for f, (_, steps) in path.items()}
        for i in path:
            poly = np.zeros((d, len(X)))  # coefficients of t^0 to t^(d-1)
            poly[0] = 1.0
            for j in path:
                if j != i:
                    poly = z[j] * poly + o[j] * np.vstack([np.zeros((1, len(X))), poly[:-1]])
            phi[:, i] += t.weight * value * (o[i] - z[i]) * (np.array(weights) @ poly)
    return phi


def predict_trees(trees: Sequence[Tree], X: np.ndarray) -> np.ndarray:
    """The ensemble's margin of each row, node by node over all rows."""
    out = np.zeros(len(X))
    for t in trees:
        at = np.zeros(len(X), int)
        for i in t.order:  # parents before children
            if t.left[i] >= 0:
                here = at == i
                at[here] = np.where(goes_left(t, i, X[here]), t.left[i], t.right[i])
        out += t.weight * t.value[at]
    return out


def expected_value(trees: Sequence[Tree]) -> float:
    """The margin of no features: leaf values by the shares of training rows."""
    return sum(t.weight * value * math.prod(z for z, _ in path.values()) for t in trees for value, path in leaf_paths(t))


def mean_abs_shap(rows: DataFrame, models: dict, slot_features: dict[int, Sequence[str]], fold_col: str = "fold",
                  features_col: str = "_features") -> DataFrame:
    """Mean |SHAP| per input feature, each row explained by the model of its fold.
    ``rows`` carries the feature vector (an array, or an ML vector) and the fold; ``models`` maps fold ->
    trees; ``slot_features`` maps fold -> the input feature of every vector slot (slots of one
    feature, e.g. an imputed value and its missing flag, are added before the abs).
    Each task returns partial sums, so only features x tasks rows leave Python."""
    from foldwise.session import ship_package
    ship_package(rows.sparkSession)
    names = sorted(set().union(*slot_features.values()))
    slot_idx = {f: {n: [j for j, s in enumerate(slots) if s == n] for n in names} for f, slots in slot_features.items()}
    array = isinstance(rows.schema[features_col].dataType, T.ArrayType)
    arr = rows.select(F.col(fold_col).cast("int").alias("_fold"), (F.col(features_col) if array else vector_to_array(F.col(features_col))).alias("_x"))

    def explained(fold: int, rows: list[np.ndarray]) -> np.ndarray:
        """The sum of |SHAP| of each name over ``rows``."""
        phi = shap_values(models[fold], np.concatenate(rows))
        return np.array([np.abs(phi[:, slot_idx[fold][n]].sum(axis=1)).sum() for n in names])

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, held = np.zeros(len(names)), 0, {}
        for batch in it:
            folds = plain_column(batch, "_fold")
            there = np.unique(folds[~np.isnan(folds)]).astype(int).tolist()
            for fold in there:
                mine = folds == fold
                x = array_column(batch, "_x", len(slot_features[fold]))[mine]
                held.setdefault(fold, []).append(x)
                count += len(x)
                if sum(map(len, held[fold])) >= BLOCK:
                    sums += explained(fold, held.pop(fold))
        for fold, rows in held.items():
            sums += explained(fold, rows)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums), pa.array([count] * len(names), pa.int64())], names=["feature", "abs_sum", "n"])

    parts = arr.mapInArrow(fn, "feature string, abs_sum double, n long")
    return parts.groupBy("feature").agg((F.sum("abs_sum") / F.sum("n")).alias("mean_abs_shap"))
