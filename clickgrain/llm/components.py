"""Connected components by joins: labels go to neighbours and are then followed to their own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.session import park


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the smallest node of each one's component.

    Every round is written, so a lost executor costs no earlier round. Chains shorten by more than
    half a round; stars take two rounds.
    """
    both = park(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = park(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("lower"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = lower.join(jump, F.col("lower") == F.col("at")).select("node", F.least("lower", "beyond").alias("label"), (F.least("lower", "beyond") < F.col("label")).alias("changed"))
        moved = park(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("changed").isEmpty():
            return labels
