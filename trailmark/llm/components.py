"""Connected components over memberships of nodes in hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import attach, written


def connected(members: DataFrame) -> DataFrame:
    """node, label of every node of (node, hub): the smallest node reachable through shared hubs.

    Every round a node takes the least label found in its hubs; from the third round on, also the label
    of that label, so the rounds grow with the logarithm of a chain. Labels of hubs combine on the map
    side, and hot hubs and labels go back to their rows by broadcast. Each round is written before
    the next one reads it.
    """
    pairs = written(members.select("node", "hub").distinct().withColumn("label", F.col("node")), "members")
    n_pairs, turn = pairs.count(), 0
    labels = None
    while True:
        placed = pairs if labels is None else pairs.drop("label").join(labels.select("node", "label"), "node")
        hubs = placed.groupBy("hub").agg(F.min("label").alias("least"), F.count(F.lit(1)).alias("n"))
        found = attach(placed, hubs, "hub", "n", n_pairs, F.col("node")).groupBy("node")
        moved = found.agg(F.min("least").alias("via"), F.first("label").alias("label"))
        moved = written(moved, "moved")
        if moved.where(F.col("via") != F.col("label")).isEmpty():
            return moved.select("node", "label")
        turn += 1
        if turn > 2:
            used = moved.groupBy("via").agg(F.count(F.lit(1)).alias("n"))
            onward = used.join(moved.select(F.col("node").alias("via"), F.col("via").alias("label")), "via")
            jumped = attach(moved.drop("label"), onward, "via", "n", moved.count(), F.col("node"))
            labels = written(jumped.select("node", "label"), "labels")
        else:
            labels = moved.select("node", F.col("via").alias("label"))
