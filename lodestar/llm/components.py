"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of the undirected edges (a, b): label is the smallest node it reaches.

    Every round takes the least label of the neighbours and then of the label's own label, so paths shorten twice;
    sums by key are combined before the shuffle, so a node with many neighbours is no hot spot. Each round is a
    written table. No edges: no rows. Null ends are ignored."""
    both = edges.select("a", "b").dropna()
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        least = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        own = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        new = (
            labels.join(least, labels.node == least.a, "left")
            .select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
            .join(own, F.col("label") == F.col("up"), "left")
            .select("node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label"))
        )
        before, labels = labels, written(new, "labels")
        dropped(before)
        if labels.filter("label <> old").limit(1).count() == 0:
            dropped(both)
            return labels.select("node", "label")
