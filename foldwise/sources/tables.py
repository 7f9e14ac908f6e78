"""Table scans (SRC1, SRC2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """``.parquet`` (file or folder) is read as Parquet, anything else as CSV with a
    header. CSV uses an explicit schema when given, else inference (as the reference)."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    """Lazy ``{name: DataFrame}``; nothing is read until an action."""
    return {n: table(spark, sf_dir, n) for n in names}
