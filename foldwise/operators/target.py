"""Target binarisation and column roles (PRJ1-PRJ3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binarize_target(df: DataFrame, col: str) -> Column:
    """A two-class target as 0/1 (Q23): booleans by value, numbers only if all are 0 or 1, text by the
    alphabet. The two classes are the least and the greatest value, from one aggregate; a null or a
    third value fails when its row is read."""
    c, dtype = F.col(col), df.schema[col].dataType
    odd = F.raise_error(F.concat(F.lit(f"{col} is not a two-class target: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("int")
    if isinstance(dtype, T.BooleanType):
        zero, one = F.lit(False), F.lit(True)
    elif isinstance(dtype, T.NumericType):
        zero, one = F.lit(0), F.lit(1)
    else:
        ends = df.agg(F.min(col).alias("low"), F.max(col).alias("high")).first()
        if ends["low"] == ends["high"]:
            raise ValueError(f"{col} holds {'no value' if ends['low'] is None else 'one class only'}")
        zero, one = F.lit(ends["low"]), F.lit(ends["high"])
    return F.when(c == zero, 0).when(c == one, 1).otherwise(odd)


def column_role(column: str, table_name: str, target_table: str, target_column: str,
                id_columns=(), time_column: str | None = None, ignore=()) -> str:
    """PRJ2: the first role, in this order, whose columns hold ``column``; else feature."""
    rules = {"target": {target_column} if table_name == target_table else (), "id": id_columns, "time": {time_column}, "ignore": ignore}
    return next((role for role, columns in rules.items() if column in columns), "feature")


#: What each Spark type is profiled as; the first that fits, text and binary as categories (PRJ3).
KINDS = ((T.BooleanType, "categorical"), (T.NumericType, "numeric"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "datetime"),
         ((T.ArrayType, T.MapType, T.StructType), "nested"))


def column_kind(dtype: T.DataType) -> str:
    return next((kind for types, kind in KINDS if isinstance(dtype, types)), "categorical")
