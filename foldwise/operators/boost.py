"""Boosted trees of many folds in shared scans.

The trees are those of ``pyspark.ml``'s GBTClassifier (log loss, trees of least variance, ``BINS`` bins a column, all rows
in every tree). There each fold's model caches its own rows as objects and takes a job a level, one model beside the
other. Here a level of all models is one scan, and what it reads is small: the training rows of each model become
blocks of bytes, two columns' bins in 16 bits and the margin so far. A task adds up its blocks in numpy
and sends a few numbers a model; splits are chosen on the driver, which holds bins x columns x nodes numbers a model. When a
tree is whole, the blocks are made anew with their new margins, and the sums of the next tree's root come along.

The blocks lie on the executors' disks (a lost one is made again from the design and the trees so far) and go from there to Python
as they are; as Parquet rows they took twice the time. A task holds a batch of blocks, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.logit import GROUP, Columns, array_column, plain_column
from foldwise.operators.treeshap import Tree
from foldwise.session import ship_package

BINS = 32
PAIR = BINS * BINS
SPLIT_ROWS = 10_000  # training rows whose values give a model's candidate splits (pyspark.ml's number); all, if there are no more
BLOCK_BYTES = 1 << 18
BATCH = 1 << 16  # rows of a model added up together
TOGETHER = 16  # models that share scans
TASK_ROWS = 1 << 22  # rows of all models in a task, where there are more tasks than cores: a Python task costs some 0.08 s by itself
BLOCKS = "model int, n int, positive int, codes binary"
Block = tuple[int, int, int, bytes, bytes | None]  # model, rows, rows of label 1 (they come first), codes, margins


# ----------------------------------------------------------------------------- candidate splits


def thresholds(values: np.ndarray) -> np.ndarray:
    """Candidate splits: between all distinct values, or where the count comes closest to multiples of a ``BINS``-th."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[1:] + found[:-1]) / 2.0
    if len(between) < BINS:
        return between
    before = np.cumsum(counts)
    closer = before[:-1] + before[1:]  # twice the target at which a value stops being the closest
    out, at, stride = [], -1, len(values) / BINS
    while (at := max(at + 1, int(np.searchsorted(closer, 2 * stride * (len(out) + 1), side="right")))) < len(between):
        out.append(between[at])
    return np.array(out)


TRAIN = "fold IS NOT NULL AND label IS NOT NULL"


def find_splits(design: DataFrame, id_col: str, columns: Columns, models: Sequence[tuple[int, np.ndarray]], sizes: Sequence[int], seed: int) -> list[list[np.ndarray]]:
    """The candidate splits of each model's columns, from a hash sample of its training rows, of which there are ``sizes``."""
    one = 1 << 30
    share = [int(one * min(1.0, SPLIT_ROWS / max(1, n))) for n in sizes]
    number = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("model"))
    rows = design.where(TRAIN).withColumn("_u", F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(one))).where(F.col("_u") < max(share))
    rows = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))))
    rows = rows.where((F.col("_u") < number(share)) & (F.col("fold") != number([i for i, _ in models]))).select("model", "num", "enc_fit")

    def split(g: pd.DataFrame) -> pd.DataFrame:
        model = int(g["model"].iloc[0])
        i, picked = models[model]
        x = columns.matrix(np.stack(g["num"].to_numpy()), np.stack(g["enc_fit"].to_numpy()), i)[:, picked]
        return pd.DataFrame({"model": [model], "splits": [[thresholds(v).tolist() for v in x.T]]})

    found = {r["model"]: r["splits"] for r in rows.groupBy("model").applyInPandas(split, "model int, splits array<array<double>>").collect()}  # a row a model
    return [[np.array(s) for s in found.get(m, [[]] * len(picked))] for m, (_, picked) in enumerate(models)]


# ----------------------------------------------------------------------------- in the tasks


def target(positive: int, margin: np.ndarray | None, n: int) -> np.ndarray:
    """What a tree is fitted to: the labels as 1 and -1, then minus the gradient of the log loss. Rows of label 1 come first."""
    out = np.full(n, 1.0)
    out[positive:] = -1.0
    if margin is None:
        return out
    with np.errstate(over="ignore"):
        return 4.0 * out / (1.0 + np.exp(2.0 * out * margin))


def tables(levels: Sequence[tuple]) -> list[tuple]:
    """``levels``, each [(place, pair, side, cut)] and the next place by place and way, as [(pair, goes right by place and
    code)] and the next places."""
    bins = np.arange(PAIR)
    out = []
    for cuts, follow in levels:
        ways = {}
        for place, pair, side, cut in cuts:
            ways.setdefault(pair, np.zeros((len(follow) // 2, PAIR), np.uint8))[place] = (bins % BINS if side else bins // BINS) > cut
        out.append(([(pair, table.reshape(-1)) for pair, table in ways.items()], np.array(follow, np.intp)))
    return out


def walk(levels: Sequence[tuple], codes: np.ndarray) -> np.ndarray:
    """The place of each row after the levels of ``tables``."""
    at = np.zeros(codes.shape[1], np.intp)
    for ways, follow in levels:
        right = sum(table.take(at * PAIR + codes[pair]) for pair, table in ways)
        at = follow.take(2 * at + right)
    return at


class Sums:
    """The sums of one model's rows over the nodes 0..nodes-1 (rows elsewhere have the node ``nodes``): rows and target of
    every (node, column, bin); rows, target and squared target of every node."""

    def __init__(self, nodes: int, pairs: int):
        self.nodes, self.held, self.rows = nodes, [], 0
        self.bins, self.whole = np.zeros((2, nodes, pairs, 2, BINS)), np.zeros((3, nodes))

    def add(self, codes: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
        self.held.append((codes, node, value))
        self.rows += len(value)
        if self.rows >= BATCH:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        codes, node, value = (np.concatenate(part, axis=-1) for part in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        for s, weights in enumerate((None, value, value * value)):
            self.whole[s] += np.bincount(node, weights, self.nodes + 1)[:self.nodes]
        at = node * PAIR
        for pair, code in enumerate(codes):
            cell = at + code
            for s, weights in enumerate((None, value)):
                both = np.bincount(cell, weights, (self.nodes + 1) * PAIR)[:self.nodes * PAIR].reshape(self.nodes, BINS, BINS)
                self.bins[s, :, pair, 0] += both.sum(axis=2)
                self.bins[s, :, pair, 1] += both.sum(axis=1)

    def flat(self) -> np.ndarray:
        self.flush()
        return np.concatenate([self.whole.reshape(-1), self.bins.reshape(-1)])


def opened(blocks: Iterator[Block]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray | None]]:
    for model, n, positive, codes, margin in blocks:
        yield model, n, positive, np.frombuffer(codes, np.uint16).reshape(-1, n), None if margin is None else np.frombuffer(margin)


def encode(x: np.ndarray, splits: Sequence[np.ndarray]) -> np.ndarray:
    """Pairs x rows: the bins of two columns in one number."""
    bins = [np.searchsorted(s, v) for v, s in zip(x.T, splits, strict=True)]
    if len(bins) % 2:
        bins.append(np.zeros(len(x), np.intp))
    return np.array([a * BINS + b for a, b in zip(bins[::2], bins[1::2], strict=True)], np.uint16).reshape(-1, len(x))


def first_blocks(columns: Columns, models: Sequence[tuple[int, np.ndarray]], splits: Sequence[Sequence[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The design's rows as blocks of the models that train on them. A column without splits is left out."""
    size = [max(1024, BLOCK_BYTES // (len(s) + 8)) for s in splits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in models]

        def block(m: int) -> pa.RecordBatch:
            codes, label = (np.concatenate(part, axis=-1) for part in zip(*held[m], strict=True))
            held[m].clear()
            codes = codes[:, np.argsort(label != 1, kind="stable")]
            plain = [pa.array([v], pa.int32()) for v in (m, len(label), int((label == 1).sum()))]
            return pa.RecordBatch.from_arrays([*plain, pa.array([codes.tobytes()], pa.binary())], names=["model", "n", "positive", "codes"])

        for batch in batches:
            fold, y = plain_column(batch, "fold"), plain_column(batch, "label")
            num, enc = array_column(batch, "num", len(columns.numeric)), array_column(batch, "enc_fit", len(columns.categorical) * (columns.k + 1))
            for left_out in sorted({i for i, _ in models}):
                train = ~np.isnan(fold) & (fold != left_out) & ~np.isnan(y)
                if not train.any():
                    continue
                x, label = columns.matrix(num[train], enc[train], left_out), y[train]
                if not np.isin(label, (0, 1)).all():
                    raise ValueError("labels of boosted trees are 0 and 1")
                if not np.isfinite(x).all():
                    raise ValueError("values of boosted trees are finite")
                for m, (i, picked) in enumerate(models):
                    if i == left_out:
                        held[m].append((encode(x[:, picked], splits[m]), label))
                        if sum(len(part) for _, part in held[m]) >= size[m]:
                            yield block(m)
        for m in range(len(models)):
            if held[m]:
                yield block(m)

    return run


def level_sums(state: dict[int, tuple]) -> Callable[[Iterator[Block]], Iterator[dict[int, np.ndarray]]]:
    """The sums of the open nodes; ``state``: model -> (levels, node by place, nodes, pairs)."""
    def run(blocks: Iterator[Block]) -> Iterator[dict[int, np.ndarray]]:
        sums, placed = {m: Sums(nodes, pairs) for m, (_, _, nodes, pairs) in state.items()}, {m: tables(s[0]) for m, s in state.items()}
        for m, n, positive, codes, margin in opened(blocks):
            if m in state:
                sums[m].add(codes, state[m][1].take(walk(placed[m], codes.astype(np.intp))), target(positive, margin, n))
        yield {m: s.flat() for m, s in sums.items()}

    return run


def next_blocks(state: dict[int, tuple]) -> Callable[[Iterator[Block]], Iterator[Block]]:
    """The blocks with a whole tree added to their margins; ``state``: model -> (levels, value by place)."""
    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        placed = {m: tables(levels) for m, (levels, _) in state.items()}
        for block in blocks:
            for m, n, positive, codes, margin in opened([block]):
                after = state[m][1].take(walk(placed[m], codes.astype(np.intp)))
                yield m, n, positive, block[3], (after if margin is None else margin + after).tobytes()

    return run


# ----------------------------------------------------------------------------- on the driver


class Growing:
    """One model's tree: nodes in lists, and what the tasks need to place rows. ``columns``: the input slots that have splits."""

    def __init__(self, columns: Sequence[int], splits: Sequence[np.ndarray], depth: int):
        self.columns, self.splits, self.depth, self.pairs = columns, splits, depth, (len(columns) + 1) // 2
        self.column, self.cut, self.left, self.right, self.n, self.sum = [], [], [], [], [], []
        self.levels, self.place, self.open = [], [self.node(0.0, 0.0)], [0]

    def node(self, n: float, total: float) -> int:
        for values, v in ((self.column, -1), (self.cut, -1), (self.left, -1), (self.right, -1), (self.n, n), (self.sum, total)):
            values.append(v)
        return len(self.n) - 1

    def by_place(self) -> np.ndarray:
        """The open node at each place, their number elsewhere."""
        return np.array([self.open.index(i) if i in self.open else len(self.open) for i in self.place], np.intp)

    def take(self, flat: np.ndarray) -> None:
        """Split the open nodes by their sums."""
        nodes, many = len(self.open), 3 * len(self.open)
        whole, bins = flat[:many].reshape(3, nodes), flat[many:].reshape(2, nodes, 2 * self.pairs, BINS)
        children = []
        for at, i in enumerate(self.open):
            n, total, square = whole[:, at]
            if i == 0:
                self.n[0], self.sum[0] = float(n), float(total)
            found = self.best(n, total, square, bins[:, at]) if self.depth else None
            if found is not None:
                self.column[i], self.cut[i], n_left, sum_left = found
                self.left[i], self.right[i] = self.node(n_left, sum_left), self.node(float(n) - n_left, float(total) - sum_left)
                children += [self.left[i], self.right[i]]
        self.descend()
        self.open = children if len(self.levels) < self.depth else []

    def best(self, n: float, total: float, square: float, bins: np.ndarray) -> tuple[int, int, float, float] | None:
        """(column, last bin on the left, its rows, its target) of the split that takes most variance away, None if none does.
        Of splits that differ by rounding alone the first is taken, so that the tree doesn't hang on the order of sums."""
        if n < 2 or not self.columns or abs(square / n - (total / n) ** 2) < np.finfo(float).eps:
            return None
        count, value = np.cumsum(bins[:, :len(self.columns), :-1], axis=2)
        there = (count >= 1) & (n - count >= 1) & (np.arange(BINS - 1) < np.array([len(s) for s in self.splits])[:, None])
        rest = n - count
        gain = np.where(there, value**2 / np.where(there, count, 1) + (total - value) ** 2 / np.where(there, rest, 1) - total**2 / n, -np.inf)
        most = gain.max()
        if most <= 1e-14 * square:
            return None
        c, cut = np.unravel_index(int(np.argmax(gain >= most * (1 - 1e-10))), gain.shape)
        return int(c), int(cut), float(count[c, cut]), float(value[c, cut])

    def descend(self) -> None:
        """The level for the tasks: a place for each child, and for each leaf as before."""
        cuts, follow, place = [], [], []
        for at, i in enumerate(self.place):
            if self.left[i] < 0:
                follow += [len(place)] * 2
                place.append(i)
                continue
            cuts.append((at, *divmod(self.column[i], 2), self.cut[i]))
            follow += [len(place), len(place) + 1]
            place += [self.left[i], self.right[i]]
        if cuts:
            self.levels.append((cuts, follow))
            self.place = place

    def value(self, i: int) -> float:
        return self.sum[i] / self.n[i] if self.n[i] else 0.0

    def values(self, weight: float) -> np.ndarray:
        return weight * np.array([self.value(i) for i in self.place])

    def tree(self, weight: float) -> Tree:
        """Nodes in preorder; two leaves of one value are one leaf."""
        left, right = list(self.left), list(self.right)
        for i in reversed(range(len(left))):  # children before parents
            if left[i] >= 0 and left[left[i]] < 0 and left[right[i]] < 0 and self.value(left[i]) == self.value(right[i]):
                left[i] = right[i] = -1
        order, todo = [], [0]
        while todo:
            i = todo.pop()
            order.append(i)
            if left[i] >= 0:
                todo += [right[i], left[i]]
        number = {i: at for at, i in enumerate(order)} | {-1: -1}
        split = [left[i] >= 0 for i in order]
        feature = np.array([self.columns[self.column[i]] if s else -1 for i, s in zip(order, split, strict=True)])
        threshold = np.array([self.splits[self.column[i]][self.cut[i]] if s else 0.0 for i, s in zip(order, split, strict=True)])
        return Tree(feature, threshold, [None] * len(order), np.array([number[left[i]] for i in order]), np.array([number[right[i]] for i in order]),
                    np.array([self.value(i) for i in order]), np.array([float(self.n[i]) for i in order]), list(range(len(order))), weight)


def totals(parts: RDD, tasks: int) -> dict[int, np.ndarray]:
    """The sums of each model, of which each of ``tasks`` tasks sends its own."""
    add = lambda a, b: {m: a[m] + b[m] for m in a}
    return reduce(add, parts.collect()) if tasks <= GROUP else parts.treeReduce(add, 2)


def fit_boosted(design: DataFrame, id_col: str, columns: Columns, models: Sequence[tuple[int, Sequence[int]]], trees: int, depth: int, step: float,
                seed: int) -> list[tuple[Tree, ...]]:
    """The trees of every (fold left out, or k for none; picked design columns)."""
    out = []
    for at in range(0, len(models), TOGETHER):
        out += fit_group(design, id_col, columns, [(i, np.array(p, int)) for i, p in models[at:at + TOGETHER]], trees, depth, step, seed)
    return out


def fit_group(design: DataFrame, id_col: str, columns: Columns, models: Sequence[tuple[int, np.ndarray]], trees: int, depth: int, step: float,
              seed: int) -> list[tuple[Tree, ...]]:
    spark = design.sparkSession
    ship_package(spark)
    folds = {r["fold"]: r["count"] for r in design.where(TRAIN).groupBy("fold").count().collect()}  # k rows
    sizes = [sum(n for f, n in folds.items() if f != i) for i, _ in models]
    found = find_splits(design, id_col, columns, models, sizes, seed)
    used = [[j for j, s in enumerate(own) if len(s)] for own in found]
    splits = [[own[j] for j in use] for own, use in zip(found, used, strict=True)]
    kept = [(i, picked[use]) for (i, picked), use in zip(models, used, strict=True)]

    rows = design.select("fold", "label", "num", "enc_fit")
    cores, done = spark.sparkContext.defaultParallelism, [[] for _ in models]
    tasks = cores * max(1, math.ceil(sum(sizes) / (TASK_ROWS * cores)))
    first = rows.mapInArrow(first_blocks(columns, kept, splits), BLOCKS).repartition(tasks)
    state = first.rdd.map(lambda r: (r[0], r[1], r[2], bytes(r[3]), None)).persist(StorageLevel.DISK_ONLY)
    for t in range(trees):
        grown, weight = [Growing(use, s, depth) for use, s in zip(used, splits, strict=True)], step if t else 1.0
        for level in range(max(1, depth)):
            now = {m: (g.levels, g.by_place(), len(g.open), g.pairs) for m, g in enumerate(grown) if g.open}
            sums = totals(state.mapPartitions(level_sums(now)), tasks) if now else {}
            for m in now:
                grown[m].take(sums[m])
            if t and not level:
                last.unpersist()  # the first scan has made the blocks of now
        for g, own in zip(grown, done, strict=True):
            own.append(g.tree(weight))
        last, state = state, state.mapPartitions(next_blocks({m: (g.levels, g.values(weight)) for m, g in enumerate(grown)})).persist(StorageLevel.DISK_ONLY)
    last.unpersist()
    return [tuple(own) for own in done]
