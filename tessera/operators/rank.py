"""Ranking in groups, caps, surrogate ids, samples by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; ``order`` must be total for a stable result."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key."""
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def capped_groups(df: DataFrame, cap_keys: Sequence[str], group: Sequence[str], order: Sequence[Column], emitted: Column, cap: int, least: int = 3) -> DataFrame:
    """Groups of ``least`` rows or more within each cap key, larger ones first (ties by ``group``); of the rows that are emitted
    the first ``cap`` of each cap key. Sizes count all rows of a group, the cap only the emitted ones;
    rows with a NULL key are in no group and go."""
    keys = [*cap_keys, *group]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("group_n")).filter(F.col("group_n") >= least)
    return top_k(df.filter(emitted).join(sizes, keys), cap_keys, [F.desc("group_n"), *(F.col(g) for g in group), *order], cap)


def frequent(df: DataFrame, key: str, k: int, least: int = 1) -> DataFrame:
    """The k most frequent values with at least so many rows; ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), key).limit(k)


def hash_sample(df: DataFrame, keys: Sequence[str], row_id: Column, k: int, seed: str) -> DataFrame:
    """K rows of each group in the order of a seeded SHA-1, the same on every run."""
    order = F.sha1(F.concat_ws("|", F.lit(seed), row_id.cast("string")).cast("binary"))
    return top_k(df, keys, [order], k, "_rank").drop("_rank")


def numbered(df: DataFrame, order: Sequence[str], name: str, pattern: str = "q_%06d") -> DataFrame:
    """Consecutive ids in a total order without one task for all rows: counts per range partition, then offsets."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition: a running sum over them is small
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.format_string(pattern, F.col("_k") + F.col("_before"))).drop("_part", "_k", "_before")


def content_id(prefix: str, n: int, *parts: Column) -> Column:
    """Id by content."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, n))


def budgeted(df: DataFrame, order: Sequence[str], size: str, most_each: float, most: float, count: int | None = None) -> DataFrame:
    """Rows in order while the running sum stays in the budget, ``count`` of them at most; rows that are too large alone are passed
    over, and the first overflow ends the choice. A catalogue of files is small, so one ordered window is enough."""
    fits = df.filter((F.col(size) > 0) & (F.col(size) <= most_each))
    w = Window.orderBy(*order)
    chosen = fits.withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("running") <= most)
    return chosen if count is None else chosen.orderBy(*order).limit(count)
