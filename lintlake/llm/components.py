"""Connected components of a graph whose nodes are values of any comparable type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label: for every node of the edges (x, y), the smallest node it is connected with.

    Every node has a parent, itself at first. In a round a node, and its parent, take the smallest grandparent among
    the node's neighbours, and a node takes its own grandparent; so whole trees hook onto others while they get flat.
    A path of 10,000 nodes in random order takes 15 rounds, one of 100,000 takes 18. Each round is written out.
    No edges give no rows; loops and repeated edges change nothing.
    """
    both = stored(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    while True:
        parents = labels.select(F.col("node").alias("parent"), F.col("label").alias("far"))
        far = stored(labels.join(parents, labels["label"] == parents["parent"]).select("node", "label", "far"), "labels")
        near = both.join(far.select(F.col("node").alias("y"), "far"), "y").groupBy("x").agg(F.min("far").alias("near"))
        seen = stored(far.join(near, far["node"] == near["x"]).select("node", "label", "far", "near"), "labels")
        hooks = seen.groupBy(F.col("label").alias("parent")).agg(F.min("near").alias("hook"))
        joined = seen.join(hooks, seen["node"] == hooks["parent"], "left")
        least = F.least("label", "far", "near", F.coalesce("hook", "near"))
        new = stored(joined.select("node", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels
