"""Connected components of an edge table, by smallest label, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component (the smallest node that can be reached), for the nodes that have an edge.

    Each round takes the least label among a node and its neighbours, then the label of that label, so that paths are
    halved; every round is written to the shared folder, and only the number of changed labels comes to the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        first = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = cut(first.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("beyond", "next")).alias("next")))
        changed = moved.where("next != component").count()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
