"""Unions and duplicates by priority."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import first_rows


def union_first_wins(sources: Sequence[DataFrame], uid: str, order: str, fallback: Column | None = None) -> DataFrame:
    """All sources in order of priority; of rows with one uid the first by (source, order) stays. Rows with an empty uid
    go, or get ``fallback`` as their key."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)))
    key = F.nullif(F.col(uid).cast("string"), F.lit(""))
    keyed = tagged.withColumn("_key", key if fallback is None else F.coalesce(key, fallback)).filter("_key is not null")
    return first_rows(keyed, ["_key"], [F.col("source_rank"), F.col(order)]).drop("_key")


def last_wins(df: DataFrame, key: str, columns: Sequence[str], order: Column) -> DataFrame:
    """Attributes of the last row of each key, by aggregation alone."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(key, *(F.col("_last")[c].alias(c) for c in columns))


def ordered_pairs_once(pairs: DataFrame, a: str, b: str, order: Sequence[Column]) -> DataFrame:
    """Each ordered pair once, the first by ``order``."""
    return first_rows(pairs, [a, b], order)


def first_buckets(pairs: DataFrame, a: str, b: str, bucket: str) -> DataFrame:
    """(a, b, bucket): each ordered pair once with the smallest bucket that holds it, by an aggregation of numbers. Pairs rarely repeat,
    so they aren't aggregated before the shuffle, and small partitions of a given number bound what a task holds."""
    parts = 8 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select(a, b, bucket).repartition(parts, a, b).groupBy(a, b).agg(F.min(bucket).alias(bucket))


def overlap_cleaned(rows: DataFrame, split: str, key: str) -> DataFrame:
    """Test rows that share a key with val go; train rows that share one with what is left of val and test go."""
    val, test, train = (rows.filter(F.col(split) == s) for s in ("val", "test", "train"))
    test = test.join(val.select(key).distinct(), key, "left_anti")
    train = train.join(val.select(key).unionByName(test.select(key)).distinct(), key, "left_anti")
    return train.unionByName(val).unionByName(test)


def require_same_schema(frames: Sequence[DataFrame]) -> None:
    """Parts of one table have the same columns in the same order, and the same types; otherwise an error that names the first part that differs."""
    kinds = [f.dtypes for f in frames]
    for k, other in enumerate(kinds[1:], 2):
        if other != kinds[0]:
            raise ValueError(f"part {k} has other columns: {sorted(set(map(str, other)) ^ set(map(str, kinds[0]))) or 'another order'}")
