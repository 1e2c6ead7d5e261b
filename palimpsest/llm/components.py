"""Connected components of a graph of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (src, dst: long): label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so that long
    chains halve; rounds end when no label changes. Minima are pre-aggregated, so a node with many neighbours is no
    hot group, and every round is a stored table. Self-links name a node without neighbours; an empty table gives no rows.
    """
    both = materialise(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        goal = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        step = materialise(least.join(goal, "label", "left").select("node", F.least("label", F.coalesce("jump", "label")).alias("label"), (F.least("label", F.coalesce("jump", "label")) != F.col("old")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels
