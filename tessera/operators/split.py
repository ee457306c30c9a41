"""Leakage-safe splits: by hash, by unseen groups, by connected components, and their audit."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash48, hash_fraction


def by_fraction(key: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """G1: split by the hash fraction of a key."""
    x = hash_fraction(key)
    return F.when(x < train, "train").when(x < train + val, "valid").otherwise("test")


def is_unseen(key: Column, percent: int = 10) -> Column:
    """G2."""
    return hash48(key) % 100 < percent


def by_component(root: Column) -> Column:
    """Bucket of a component's root hash."""
    x = root % 100
    return F.when(x < 80, "train").when(x < 90, "val").otherwise("test_seen")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a folder of this machine only where that is unset and Spark is local."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix=f"tessera-{uuid.uuid4().hex[:8]}-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's checkpoint folder (a reliable checkpoint, never a local one)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def tasks(df: DataFrame, most: int = 1 << 20) -> int:
    """In how many partitions the rows of a table (counted by its files) are dealt out, so a task has about ``most`` of them whatever its size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // most + 1)


def component_labels(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label): the smallest node of each component of the edges (a, b).

    A round contracts the graph: a node takes the smallest node beside it (or itself), that one's choice in turn, and so on to the end of these chains, which
    halve with each step; edges go between what was taken. Loops and copies fall away, so the rounds get smaller; the smallest node of a component always keeps itself, and is what is left. Then
    the rounds' choices are joined, from the smallest graph back to the first."""
    left = kept(edges.select("a", "b").filter("a is not null and b is not null"))
    taken = []
    for _ in range(rounds):
        ends = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        chosen = kept(ends.groupBy(F.col("e.a").alias("node")).agg(F.min(F.least("e.a", "e.b")).alias("label")))
        moved = True
        while moved:
            further = chosen.select(F.col("node").alias("_p"), F.col("label").alias("_l")).filter("_p <> _l")
            jumped = kept(chosen.join(further, F.col("label") == F.col("_p"), "left").select("node", F.coalesce("_l", "label").alias("label"), F.col("_l").isNotNull().alias("_moved")))
            chosen, moved = jumped.drop("_moved"), not jumped.filter("_moved").isEmpty()
        taken.append(chosen)
        new = lambda t, c: t.join(taken[-1].withColumnsRenamed({"node": c, "label": f"_{c}"}), c)  # noqa: E731, B023
        pairs = new(new(left, "a"), "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        left = kept(pairs.distinct())
        if left.isEmpty():
            break
    else:
        raise RuntimeError("component labels didn't settle")
    labels = taken.pop()
    while taken:
        later = labels.withColumnsRenamed({"node": "_p", "label": "_l"})
        labels = taken.pop().join(later, F.col("label") == F.col("_p"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    return kept(labels)


def leakage_matrix(rows: DataFrame, split: str, key: str) -> DataFrame:
    """For every two splits the number of keys that both hold: splits of a key are few, so the key's set is exploded, not joined."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    return sets.select(F.explode("s").alias("split_a"), "s").select("split_a", F.explode("s").alias("split_b")).filter("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def unseen_cleaned(rows: DataFrame, unseen: Column, keys: list[str]) -> DataFrame:
    """Seen rows that share any of their keys with an unseen row go."""
    marked = rows.withColumn("_unseen", unseen)
    bad = marked.filter("_unseen").select(F.explode(F.array(*keys)).alias("_bad")).distinct()
    seen = marked.filter(~F.col("_unseen"))
    for key in keys:
        seen = seen.join(bad, seen[key] == bad["_bad"], "left_anti")
    return seen.unionByName(marked.filter("_unseen")).withColumn("is_unseen", F.col("_unseen")).drop("_unseen")
