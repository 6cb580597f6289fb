"""Connected components of a graph given as edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) pairs to (node, label): the least node that is reachable. Nodes without edges are not listed.

    Each round takes the least label among the neighbours (summed up before the shuffle, so a hub costs a task no more
    than its own share) and then the label's label; paths shrink by half at least. Rounds are written to the shared
    folder. Raises if labels still change after ``most_rounds``, which paths of up to 2^60 nodes do not reach.
    """
    both = stored(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    labels = stored(labels, "labels0")
    for k in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "_near").alias("_mid"), F.col("label").alias("_old"))
        least = stored(least, f"labels{k + 1}a")
        up = least.select(F.col("node").alias("_up"), F.col("_mid").alias("_top"))
        # a label is a node of the same component, so the inner join keeps every node
        new = stored(least.join(up, least["_mid"] == up["_up"]).select("node", F.least("_mid", "_top").alias("label"), "_old"), f"labels{k + 1}b")
        labels = new.select("node", "label")
        if new.where("label <> _old").isEmpty():
            return labels
    raise RuntimeError("labels still change")
