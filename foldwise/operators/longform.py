"""Long form (helper X3): many columns become ``(id..., feature, value)`` rows so every
per-feature statistic is one ``groupBy("feature")`` job instead of one job per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], value_type: str = "double",
         feature_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Unpivot ``cols`` into one typed value column. NaN becomes null for doubles (T4)."""
    ids = list(ids)
    cols = list(cols)
    typed = df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in cols])
    long = typed.unpivot(ids, cols, feature_col, value_col)
    if value_type == "double":
        v = F.col(value_col)
        long = long.withColumn(value_col, F.when(F.isnan(v), F.lit(None)).otherwise(v))
    return long
