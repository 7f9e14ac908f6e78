"""Connected components of an edge table by least labels and pointer jumping.

Every round is a join, an aggregate with map-side combine and a written table, so no neighbourhood
is ever gathered in one place and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import write_shared


def connected_components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b; longs): comp is the least node it can reach.
    ``start`` holds labels known before (node, comp); its nodes are kept."""
    both = write_shared(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("comp"))
    if start is not None:
        labels = start.unionByName(labels.join(start.select("node"), "node", "left_anti"))
        both = write_shared(both.union(start.where("node <> comp").select("node", "comp")).union(start.where("node <> comp").select("comp", "node")).distinct(), "edges")
    labels = write_shared(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(near, labels["node"] == near["a"], "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        least = write_shared(least, "least")
        jump = least.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = write_shared(least.join(jump, "low", "left").select("node", F.col("comp").alias("was"), F.coalesce("far", "low").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return labels
