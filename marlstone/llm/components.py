"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for nodes with a link to another.

    Each round takes the smallest label of the neighbours, then the label of one's label;
    rounds end when no label changes. All steps are joins and aggregations.
    """
    both = links.where("a <> b").select("a", "b")
    both = checkpointed(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = checkpointed(labels)
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        near = checkpointed(near)
        above = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = near.join(above, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label"))
        jumped = checkpointed(jumped)
        labels = jumped.select("node", "label")
        if not jumped.where("label <> was").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
