"""Connected components of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every end of ``links(a, b)``; the label is the least node reachable.

    Each round takes the least label among neighbours, then the label of that label, and is
    written out. Repeated and reversed links and links of a node with itself change nothing.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
    labels = stored(labels.select("node", F.least("node", "_least").alias("label")))
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("_near"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        lowered = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new")
        )
        target = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        labels = stored(
            lowered.join(target, "_new", "left").select("node", "_old", F.least("_new", "_far").alias("label"))
        )
        changed = labels.where(F.col("label") != F.col("_old")).limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels
