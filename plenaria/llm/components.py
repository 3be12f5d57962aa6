"""Connected components of a table of links, by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the smallest node that links reach from it.

    Each round a node takes the least label of its neighbours, then the label of its label, so that the distance
    covered doubles. Sums and minima are made before rows move, so a node with very many links is no bottleneck;
    nothing is collected but the number of changed labels. No links give no nodes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        moved = staged(moved, "labels-near")
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = staged(moved.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("old != label").limit(1).count():
            return labels
