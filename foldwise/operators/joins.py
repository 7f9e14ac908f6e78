"""Primary/secondary table joins and the raw feature frame (JOIN1, JOIN2, PRJ4, PRJ11).

The primary table keeps every row and each secondary table is left-joined on its key. What a
secondary table adds under a name that is already taken is called ``{table}_{column}``. The whole
naming is worked out from the specs first, as a lineage ``(table, column) -> output name``, so that
the joins are plain projections and the raw feature frame selects exactly what a join produced (Q11).

No broadcast is forced: side tables at 100 TB scale can be large, so the strategy is left to the
planner and AQE (broadcast only below ``autoBroadcastJoinThreshold`` as measured at run time,
sort-merge with skew splitting otherwise).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class TableSpec:
    name: str
    df: DataFrame
    role: str = "secondary"  # primary | secondary
    join_key: str | None = None


@dataclass
class Joined:
    df: DataFrame
    lineage: dict  # (table, column) -> output column

    def __iter__(self):  # allows `df, lineage = join_with_lineage(...)`
        return iter((self.df, self.lineage))


def plan_names(tables: list[TableSpec]) -> dict[tuple[str, str], str]:
    """The lineage of a join, or one error that lists what is wrong with the specs."""
    main = [t for t in tables if t.role == "primary"]
    sides = [t for t in tables if t.role == "secondary"]
    if not main:
        raise ValueError("one table must have the role primary")
    names = {(main[0].name, c): c for c in main[0].df.columns}
    wrong = []
    for t in sides:
        taken = set(names.values())
        keyless = not t.join_key
        wrong += [f"{t.name}: {what}" for what, bad in (
            ("a join key is needed", keyless), (f"its own columns lack the key {t.join_key}", not keyless and t.join_key not in t.df.columns),
            (f"the joined columns lack the key {t.join_key}", not keyless and t.join_key not in taken)) if bad]
        names |= {(t.name, c): f"{t.name}_{c}" if c in taken else c for c in t.df.columns if c != t.join_key}
        wrong += [f"{c}: two columns would have this name" for c, n in Counter(names.values()).items() if n > 1]
    if wrong:
        raise ValueError("; ".join(wrong))
    return names


def repeated_keys(t: TableSpec) -> DataFrame:
    """Key values that several rows of a side table share; a join on them repeats primary rows."""
    return t.df.groupBy(t.join_key).agg(F.count("*").alias("n")).where("n > 1")


def join_with_lineage(tables: list[TableSpec], null_safe: bool = False, fanout_check: bool = False) -> Joined:
    """``null_safe``: null keys match null keys. ``fanout_check``: refuse side tables with repeated keys."""
    names = plan_names(tables)

    def add(left: DataFrame, t: TableSpec) -> DataFrame:
        key = f"__{t.name}_key"
        side = t.df.select(F.col(t.join_key).alias(key), *[F.col(c).alias(names[t.name, c]) for c in t.df.columns if c != t.join_key])
        same = left[t.join_key].eqNullSafe(side[key]) if null_safe else left[t.join_key] == side[key]
        return left.join(side, same, "left").drop(key)

    sides = [t for t in tables if t.role == "secondary"]
    several = [t.name for t in sides if fanout_check and not repeated_keys(t).isEmpty()]
    if several:
        raise ValueError(f"keys repeat in {', '.join(several)}; primary rows would be multiplied")
    return Joined(reduce(add, sides, next(t for t in tables if t.role == "primary").df), names)


def join_tables(tables: list[TableSpec], null_safe: bool = False) -> DataFrame:
    return join_with_lineage(tables, null_safe=null_safe).df


def raw_feature_frame(joined: Joined, feature_columns: list[tuple[str, str]], id_cols: list[str] = ()) -> DataFrame:
    """PRJ4: the role=feature columns ``(table, column)`` under their joined names."""
    return joined.df.select(*id_cols, *[joined.lineage[tc] for tc in feature_columns if tc in joined.lineage])
