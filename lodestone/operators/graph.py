"""Connected components and hierarchy closure over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) of the undirected edges a, b.

    Labels fall to the least of the neighbours' and jump to the label of their
    label, so rounds grow with the logarithm of a component's diameter.  Each
    round is checkpointed: lineage stays short and lost executors cost a round.
    """
    spark = edges.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints/lodestone")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")).checkpoint()
        labels = new.select("node", "label")
        if new.filter("label <> old").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")


def closure(parents: DataFrame, depth: int) -> DataFrame:
    """id, ancestor, distance over id -> parent, to the given depth (levels bound it)."""
    step = parents.filter("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out = step
    up = parents.select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    for _ in range(depth - 1):
        step = step.join(up, "ancestor").filter("next is not null").select("id", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        out = out.unionByName(step)
    return out
