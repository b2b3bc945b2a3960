"""Graph operators: connected classes, roots of merge forests, closures of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.operators.files import cut


def connected_classes(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node each linked node can reach.

    Rounds of neighbours' least label and the label's label; their number grows with the logarithm of a
    class's width. Only a yes or no comes to the driver.
    """
    both = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        nearer = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        moved = cut(nearer.join(jump, "root").select("node", "old", F.least("root", "beyond").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("old != root").isEmpty():
            return labels


def effective_root(nodes: DataFrame, depth: int = 4) -> DataFrame:
    """id, root after following ``parent`` at most ``depth`` times; a missing parent ends the walk."""
    up = nodes.select(F.col("id").alias("root"), F.col("parent").alias("above"))
    out = nodes.select("id", F.col("id").alias("root"))
    for _ in range(depth):
        out = out.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    return out
