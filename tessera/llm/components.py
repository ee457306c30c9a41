"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge to another node.

    ``edges`` has columns a and b. Every round takes the smallest label around a node and then the label of
    that label, so a chain of n nodes is done in about log2(n) rounds; each round ends in a stored table.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        merged = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), "label")
        # what a node learned, its old label learns too: trees hook onto smaller trees as a whole
        hooks = merged.filter("new < label").groupBy("label").agg(F.min("new").alias("hook")).withColumnRenamed("label", "node")
        hooked = stored(merged.join(hooks, "node", "left").select("node", F.least("new", F.coalesce("hook", "new")).alias("label")))
        parents = hooked.select(F.col("node").alias("_p"), F.col("label").alias("_l"))
        jumped = hooked.join(parents, hooked["label"] == parents["_p"], "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label"))
        next_labels = stored(jumped)
        changed = next_labels.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        labels = next_labels
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components didn't settle")
