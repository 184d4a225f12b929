"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round every node takes the smallest label among its own and its neighbours', then the label
    of its label, so paths shorten by half a round; rounds are staged to the shared folder. Only the
    number of changed labels reaches the driver. Self-loops, repeated edges and an empty table are fine;
    edges with a null end are ignored.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src is not null and dst is not null")
    both = staged(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels.node == near.src, "left").select(
            "node", F.least("component", "m").alias("via"), F.col("component").alias("old")
        )
        up = labels.select(F.col("node").alias("via"), F.col("component").alias("above"))
        moved = staged(
            lower.join(up, "via", "left").select("node", F.least("via", "above").alias("component"), "old"), "labels"
        )
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
