"""Deterministic pseudo-random numbers as Column expressions.

Every "random" choice in the library (holdout, folds, shuffles, bootstrap samples)
is a function of a row id and a seed through ``h``. The same value can be written in
plain SQL (first 8 hex digits of md5 of ``id|seed``), so results survive recomputation
after executor loss and an SQL oracle can repeat them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def h(id_col: Column | str, seed: int | str | Column) -> Column:
    """Unsigned 32-bit hash of ``id`` and ``seed`` as a BIGINT in [0, 2^32)."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat(idc.cast("string"), F.lit("|"), seed_c.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(id_col: Column | str, seed: int | str | Column) -> Column:
    """``h`` scaled to [0, 1)."""
    return h(id_col, seed) / F.lit(TWO_POW_32)


def h_duckdb(id_expr: str, seed: int | str) -> str:
    """DuckDB text of ``h`` used by the oracle queries."""
    return f"('0x' || substr(md5(CAST({id_expr} AS VARCHAR) || '|{seed}'), 1, 8))::BIGINT"
