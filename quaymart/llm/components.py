"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has an edge.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    paths halve; every round is written to the shared folder. Stars need two rounds.
    """
    both = stored(edges.select(F.col(a).alias("v"), F.col(b).alias("w")).unionAll(edges.select(F.col(b), F.col(a))).distinct())
    labels = stored(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("l")))
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("l").alias("lw")), "w").groupBy("v").agg(F.min("lw").alias("m"))
        lower = labels.join(near, "v").select("v", F.least("l", "m").alias("n"), F.col("l").alias("before"))
        jump = labels.select(F.col("v").alias("n"), F.col("l").alias("ln"))
        moved = stored(lower.join(jump, "n").select("v", F.least("n", "ln").alias("l"), "before"))
        if not moved.where("l != before").limit(1).count():
            return moved.select(F.col("v").alias("node"), F.col("l").alias("component"))
        labels = moved.select("v", "l")
