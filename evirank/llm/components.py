"""Connected components of an edge table as rounds of joins; nothing reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of the edges ``(a, b)``; the label is the component's least node.

    Each round takes the least label among the neighbours and then the label of that label,
    so chains shrink geometrically. The tables are checkpointed after every round.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        .select("node", F.least("node", "least").alias("label"))
    )
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        )
        nearer = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("next"))
        of = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = cut_lineage(
            nearer.join(of, "next").select("node", F.least("next", "jump").alias("new"), "label")
        )
        if moved.where("new != label").isEmpty():
            return labels
        labels = moved.select("node", F.col("new").alias("label"))
