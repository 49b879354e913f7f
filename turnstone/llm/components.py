"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of every node with an edge.
    ``edges`` has a, b. A round takes the smallest label next to a node, then that
    label's own label; rounds end when nothing changes. Each is written out, so a
    lost executor costs one round at most, and a hub's edges are combined before
    they shuffle."""
    pairs = edges.select("a", "b").where("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = written(first.select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        beside = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("label").alias("beside"))
        met = labels.join(beside, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "beside").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = written(met.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
