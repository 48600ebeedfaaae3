"""Connected components of a table of links, by spreading the least id and jumping along it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, staged


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links(a, b)``: comp is the least node that links reach.

    Each round takes the least label among neighbours, then the label's own label; both are joins
    and partial minima, so a node with millions of links costs one joined row a link. Rounds end
    when no label changes. Labels are staged each round; nothing is collected but a count.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        following = staged(lower.join(jump, "low", "left").select("node", "old", F.least("low", F.coalesce("far", "low")).alias("comp")), "labels")
        changed = following.filter("old <> comp").limit(1).count()
        drop_staged(labels)
        labels = following
        if not changed:
            drop_staged(both)
            return labels.select("node", "comp")
