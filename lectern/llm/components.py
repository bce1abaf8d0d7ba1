"""Connected components of a table of links by repeated smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of (a, b) links; the label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    the rounds grow with the logarithm of a component's length. Every round is written to the
    shared checkpoint folder. Nulls and loops are left out; no links give no rows.
    """
    both = (
        links.select("a", "b").filter("a is not null and b is not null and a <> b")
        .unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a is not null and b is not null and a <> b"))
        .distinct()
    )
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("near")).agg(F.min("label").alias("best"))
        lower = labels.join(near, labels.node == near.near, "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("best", "label")).alias("label")
        )
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = cut_lineage(
            lower.join(jump, lower.label == jump.at, "left").select(
                "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
            )
        )
        changed = not after.filter("label <> old").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels
