"""Connected components of a large graph, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyquill.llm.common import unwritten, written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> a row (node, label, old) per node, the label being its component's smallest node.

    Each round a node takes the smallest label among its own and its neighbours', and then the label
    of its label. Labels only fall, and a round without change ends it; the number of rounds grows
    with the logarithm of the longest path, not with the size of a component. A node of many edges
    is no hot spot: labels meet edges in a join that adaptive execution splits, and are reduced by
    partial aggregates.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = low.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label"))
        new = written(new, "labels")
        unwritten(low, labels)
        if new.where("label <> old").isEmpty():
            unwritten(both)
            return new
        labels = new
