"""Session helpers: sizing, checked broadcast, materialization, package shipping."""

from pyspark.sql import functions as F

from foldwise.session import cluster_conf, materialize, ship_package


def test_cluster_conf_sizes_partitions():
    c = cluster_conf(100 * 2**40, 1000, 8)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    small = cluster_conf(10 * 2**20, 10, 4)
    assert int(small["spark.sql.shuffle.partitions"]) == 80  # at least two waves of tasks
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_materialize_reads_back_parquet(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    m = materialize(df, "t")
    assert m.count() == 100
    plan = m.select("x").where(F.col("x") > 10)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ReadSchema: struct<x:bigint>" in plan


def test_ship_package_once(spark):
    ship_package(spark)
    ship_package(spark)

    def where(batches):
        import foldwise.session as m
        for b in batches:
            yield b.assign(f=m.__name__)
    assert spark.range(3).mapInPandas(where, "id long, f string").where("f = 'foldwise.session'").count() == 3
