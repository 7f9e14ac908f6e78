"""Truncated-visibility replay of any feature by mergeable states (PAR3).

At a sampled replay position the online value of a feature is what its ``transform`` gives for the last
of the rows seen so far. Windows of all earlier rows are quadratic, so a feature declares a state
instead: what it carries over rows, and how two stretches of rows combine. Rows are dealt to buckets of
consecutive positions and folded there, a state for each stretch between two sampled positions; the
states of a stretch are merged in the order of their buckets, and the at most ``max_positions`` stretches
are carried from one to the next. Any associative merge will do, it need not be commutative.

The state may look at the sampled rows (a rank counts rows between their values), so its size is bounded
by them and not by the rows seen. A feature without a state can't be replayed this way and is refused.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.rank import dist_rank
from foldwise.operators.splits import sample_positions
from foldwise.session import materialize, shuffle_partitions

MAX_TRUNCATED_POSITIONS = 200
BLOCK = 1024  # states merged in one group


@dataclass
class RowState:
    """``zero(probes)`` the state of no rows; ``update(state, rows, probes)`` with further rows in replay order;
    ``merge(a, b)`` of two stretches, ``a`` before ``b``; ``value(state, probes, i)`` the feature of sampled row
    ``i``, the last one that the state has seen. ``probes`` are the sampled rows by position."""

    zero: Callable[[pd.DataFrame], Any]
    update: Callable[[Any, pd.DataFrame, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    value: Callable[[Any, pd.DataFrame, int], Any]


def row_only(fn: Callable[[pd.DataFrame], pd.Series]) -> RowState:
    """The state of a feature that looks at its own row alone."""
    return RowState(lambda probes: None, lambda s, rows, probes: None, lambda a, b: None,
                    lambda s, probes, i: fn(probes.iloc[[i]].reset_index(drop=True)).iloc[0])


def running_sum(col: str) -> RowState:
    """Sum of the values seen; a missing value has none."""
    def value(s, probes, i):
        return s if pd.notna(probes[col].iloc[i]) else np.nan
    return RowState(lambda probes: 0.0, lambda s, rows, probes: s + float(rows[col].sum()), lambda a, b: a + b, value)


def mean_of_call(col: str) -> RowState:
    return RowState(lambda probes: (0.0, 0), lambda s, rows, probes: (s[0] + float(rows[col].sum()), s[1] + int(rows[col].notna().sum())),
                    lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s, probes, i: s[0] / s[1] if s[1] else np.nan)


def rank_of_call(col: str) -> RowState:
    """Percentile rank (average of ties) among the values seen: counts of values equal to and between the
    sampled rows' values."""
    def levels(probes):
        return np.unique(probes[col].dropna().to_numpy(float))

    def update(s, rows, probes):
        v, at = rows[col].dropna().to_numpy(float), levels(probes)
        low, high = np.searchsorted(at, v, "left"), np.searchsorted(at, v, "right")
        return s + np.bincount(low + high, minlength=2 * len(at) + 1)  # even: between, odd: equal

    def value(s, probes, i):
        x = probes[col].iloc[i]
        if pd.isna(x):
            return np.nan
        k = 2 * int(np.searchsorted(levels(probes), float(x))) + 1
        return (s[:k].sum() + (s[k] + 1) / 2) / s.sum()
    return RowState(lambda probes: np.zeros(2 * len(levels(probes)) + 1, np.int64), update, lambda a, b: a + b, value)


def state_value(state: RowState, window: pd.DataFrame, cut: int = 0) -> Any:
    """The value of the window's last row by its state, the window cut in two after ``cut`` rows: what tests
    compare with ``transform(window).iloc[-1]``."""
    probes = window.iloc[[-1]].reset_index(drop=True)
    parts = [state.update(state.zero(probes), window.iloc[a:b], probes) for a, b in ((0, cut), (cut, len(window)))]
    return state.value(state.merge(*parts), probes, 0)


def truncated_replay(df: DataFrame, feature, id_col: str, time_col: str, max_positions: int = MAX_TRUNCATED_POSITIONS) -> DataFrame:
    """PAR3: ``(pos, id, value)`` at up to ``max_positions`` evenly spread positions of the (time, id) order, the
    feature seeing only the rows up to each."""
    if feature.state is None:
        raise ValueError(f"feature {feature.name!r} declares no state: its truncated replay would need every window of rows")
    from foldwise.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    state, columns = feature.state, list(feature.required_columns)
    keep = list(dict.fromkeys([id_col, *columns]))
    ordered = dist_rank(df.select(*dict.fromkeys([id_col, time_col, *columns])), [time_col, id_col], rank_col="_r", total_col="_n")
    ordered = materialize(ordered.select(*keep, (F.col("_r") - 1).alias("_pos"), "_n"), "ordered")
    head = ordered.select("_n").first()
    out = f"pos long, `{id_col}` {df.schema[id_col].dataType.simpleString()}, value {feature.output_type}"
    if head is None:
        return spark.createDataFrame([], out)
    places = spark.range(1).select(F.explode(sample_positions(F.lit(head["_n"]), max_positions)).alias("_at"))
    probes = (ordered.join(F.broadcast(places), F.col("_pos") == F.col("_at")).select("_pos", *keep).toPandas()  # at most max_positions rows
              .sort_values("_pos", ignore_index=True))
    at = probes["_pos"].to_numpy(np.int64)
    parts = shuffle_partitions(spark)
    size = max(1, -(-int(head["_n"]) // parts))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None  # the open (stretch, bucket) and its state
        for rows in batches:
            pos = rows["_pos"].to_numpy(np.int64)
            stretch, bucket = np.searchsorted(at, pos), pos // size
            cuts = np.flatnonzero(np.r_[True, (np.diff(stretch) != 0) | (np.diff(bucket) != 0)]) if len(rows) else []
            for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                now = (int(stretch[a]), int(bucket[a]))
                if now != key:
                    if key is not None:
                        yield pd.DataFrame([(*key, pickle.dumps(held))], columns=["stretch", "bucket", "state"])
                    key, held = now, state.zero(probes)
                held = state.update(held, rows.iloc[a:b], probes)
        if key is not None:
            yield pd.DataFrame([(*key, pickle.dumps(held))], columns=["stretch", "bucket", "state"])

    def merged(states) -> bytes:
        total = state.zero(probes)
        for s in states:
            total = state.merge(total, pickle.loads(s))
        return pickle.dumps(total)

    def join_block(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bucket")
        return pd.DataFrame([(g["stretch"].iloc[0], g["bucket"].iloc[0] // BLOCK, merged(g["state"]))], columns=["stretch", "bucket", "state"])

    def carry(g: pd.DataFrame) -> pd.DataFrame:
        seen, total, rows = dict(zip(g["stretch"], g["state"], strict=True)), state.zero(probes), []
        for i, p in enumerate(at.tolist()):
            total = state.merge(total, pickle.loads(seen[i])) if i in seen else total
            rows.append((p, probes[id_col].iloc[i], state.value(total, probes, i)))
        return pd.DataFrame(rows, columns=["pos", id_col, "value"])

    states = "stretch int, bucket long, state binary"
    rows = ordered.where(F.col("_pos") <= int(at[-1])).select("_pos", *keep).withColumn("_bucket", F.floor(F.col("_pos") / size))
    folded = rows.repartition(parts, "_bucket").sortWithinPartitions("_pos").drop("_bucket").mapInPandas(fold, states)
    blocks = folded.withColumn("block", F.floor(F.col("bucket") / BLOCK)).groupBy("stretch", "block").applyInPandas(lambda g: join_block(g), states)
    whole = blocks.groupBy("stretch").applyInPandas(lambda g: join_block(g), states)
    return whole.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda g: carry(g), out)  # at most max_positions states
