"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc") -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` from each node that has an edge.

    Each round takes the smallest label among neighbours (one partial aggregation, so a hub
    needs no large group) and then the label's own label; rounds grow with the logarithm of
    the longest path. Nothing but one count a round reaches the driver. No edges: no rows.
    """
    both = stored(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).where("node <> other").distinct(), f"{tag}-e"
    )
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
    k, old = 0, None
    while True:
        k += 1
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").select("node", "r")
        # a node's root hears of what its members hear: hooks whole trees, not single nodes
        hooked = near.join(labels, "node").select(F.col("root").alias("node"), "r").where("r < node")
        best = labels.select("node", F.col("root").alias("r")).union(near).union(hooked).groupBy("node").agg(F.min("r").alias("low"))
        jumped = best.join(best.select(F.col("node").alias("low"), F.col("low").alias("lower")), "low", "left").select("node", F.coalesce("lower", "low").alias("root"))
        new = stored(jumped.join(labels.withColumnRenamed("root", "was"), "node").select("node", "root", (F.col("root") != F.col("was")).alias("moved")), f"{tag}-{k}")
        labels = new.select("node", "root")
        forget(old)
        old = new
        if new.where("moved").isEmpty():
            forget(both)
            return labels
