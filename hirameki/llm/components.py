"""Connected components of links, as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b of one type. Returns node and label, the smallest node reachable, for every node that links name.

    Each round takes the smallest label next to a node, then the label of that label, so long chains shrink as well;
    every round's labels are a written table. Rows are as many as links and nodes, never pairs within a component.
    """
    both, edges_at = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels, at = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = stepped.join(of_label, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") != F.col("old")).alias("changed"))
        after, after_at = written(jumped)
        removed(at)
        labels, at = after.select("node", "label"), after_at
        if after.where("changed").isEmpty():
            removed(edges_at)
            return labels
