"""Streaming extension: event streams deduplicated and rolled up. Not part of the batch parity; a twin of its batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def first_wins_stream(events: DataFrame, uid: str, time: str, late: str = "1 hour") -> DataFrame:
    """The streaming form of the uid union: the first row of a uid within the watermark stays; state is dropped behind it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([uid])


def hourly(events: DataFrame, key: str, time: str, value: str, late: str | None = "1 hour") -> DataFrame:
    """Tumbling hours per key: count, sum, smallest and largest value (a median has no bounded streaming state). ``late`` is None
    for events that have a watermark already."""
    rows = (events if late is None else events.withWatermark(time, late)).groupBy(F.window(time, "1 hour").alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("w.start").alias("hour"), key, "n", "total", "least", "most")
