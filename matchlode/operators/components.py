"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (its smallest reachable node) of each node with an edge to another.

    Each round takes the least label among neighbours and then that label's own label, so that
    chains halve; every round is written to the shared folder. Edges with a null end, loops and
    repeats change nothing.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    pairs = cut(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = cut(labels, "labels")
    while True:
        near = pairs.join(labels, pairs.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        via = step.select(F.col("node").alias("via"), F.col("label").alias("next"))
        found = cut(step.join(via, step.label == via.via).select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = found.select("node", "label")
        if found.filter("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
