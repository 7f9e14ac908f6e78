"""Shared inputs of the registered queries, derived from the driver tables.

``base``: orders (primary, row id ``o_orderkey``) left-joined with customer; label
``y = o_orderstatus = 'F'``; nulls planted in ``price_n`` every 11th key; a planted
signal ``score``. ``prepared`` adds the stratified 15% holdout and 5 folds over dev rows.
``ev``: events with a unique, increasing time axis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.hashing import TWO_POW_32, h
from foldwise.operators.joins import join_tables, TableSpec
from foldwise.operators.splits import stratified_assign
from foldwise.session import materialize
from foldwise.sources.tables import table

SEED = 42
K = 5
HOLDOUT_FRACTION = 0.15


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_tables(
        [TableSpec("orders", table(spark, sf_dir, "orders"), "primary"),
         TableSpec("customer", table(spark, sf_dir, "customer")
                   .withColumnRenamed("c_custkey", "o_custkey"), "secondary", join_key="o_custkey")])
    rid = F.col("o_orderkey")
    y = (F.col("o_orderstatus") == "F").cast("int")
    return joined.select(
        rid.alias("row_id"), y.alias("y"), F.col("c_mktsegment").alias("seg"),
        F.col("o_orderpriority").alias("pri"), F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("bal"), F.col("o_orderdate").alias("t"),
        F.when(rid % 11 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price_n"),
        (h(rid, SEED) / F.lit(TWO_POW_32) * 0.7 + 0.3 * y).alias("score"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base`` + ``split`` (dev/holdout) + ``fold`` (dev rows only), written once to the
    checkpoint folder: every feature, metric and model of a run reads the same split."""
    return materialize(stratified_assign(base(spark, sf_dir), "row_id", "y", seed=SEED,
                                         holdout_fraction=HOLDOUT_FRACTION, k=K))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), F.col("ts").alias("t"),
                    F.col("value").alias("x"), F.col("event_type").alias("cat"),
                    (F.col("event_type") == "purchase").cast("int").alias("y"),
                    "user_id", "props")


# DuckDB text of the same inputs, shared by the oracle statements.
BASE_SQL = f"""
base AS (
  SELECT o.o_orderkey AS row_id,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS y,
         c.c_mktsegment AS seg, o.o_orderpriority AS pri, o.o_totalprice AS price,
         c.c_acctbal AS bal, o.o_orderdate AS t,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_totalprice END AS price_n,
         ('0x' || substr(md5(CAST(o.o_orderkey AS VARCHAR) || '|{SEED}'), 1, 8))::BIGINT / 4294967296.0 * 0.7
           + 0.3 * CAST(o.o_orderstatus = 'F' AS INTEGER) AS score
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
ranked_base AS (
  SELECT *,
         row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|{SEED}'), 1, 8))::BIGINT, row_id) AS cr,
         count(*) OVER (PARTITION BY y) AS cn
  FROM base
),
prepared AS (
  SELECT row_id, y, seg, pri, price, bal, t, price_n, score,
         CASE WHEN cr <= round_even(cn * {HOLDOUT_FRACTION}::DOUBLE, 0) THEN 'holdout' ELSE 'dev' END AS split,
         CASE WHEN cr > round_even(cn * {HOLDOUT_FRACTION}::DOUBLE, 0)
              THEN CAST((cr - round_even(cn * {HOLDOUT_FRACTION}::DOUBLE, 0) - 1) % {K} AS INTEGER) END AS fold
  FROM ranked_base
)"""

EV_SQL = """
ev AS (
  SELECT event_id AS row_id, ts AS t, value AS x, event_type AS cat,
         CAST(event_type = 'purchase' AS INTEGER) AS y, user_id, props
  FROM events
)"""
