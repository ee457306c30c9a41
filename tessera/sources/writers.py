"""Sinks: text tables, JSON lines, resumable appends, one folder per split, several outputs of one pass."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Chosen fields; containers as compact JSON, booleans as true/false, NULL as empty text. Fields that the frame lacks are empty."""
    out = []
    kinds = dict(df.dtypes)
    for name in fields or df.columns:
        kind = kinds.get(name)
        c = F.lit("") if kind is None else F.to_json(name, {"ignoreNullFields": "false"}) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """K1, K4."""
    flat(df, fields).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, key: str, schema: str | None = None) -> DataFrame:
    """K3: append the rows whose key isn't there yet; a second call with the same rows adds nothing."""
    spark = df.sparkSession
    try:
        known = spark.read.schema(schema or df.schema).json(path).select(key)
        df = df.join(known, key, "left_anti").select(*df.columns)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
    return df


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """K7: one folder per split, and all rows by reading their parent."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def fan_out(df: DataFrame, outputs: Sequence[Callable[[DataFrame], object]]) -> None:
    """K5, K6: several outputs of one computation; the shared part spills to disk rather than being recomputed."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for write in outputs:
            write(held)
    finally:
        held.unpersist()


def stats_document(df: DataFrame) -> str:
    """K8: a small aggregate as a JSON document (the frame must be an aggregate of few rows)."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=1, default=str, sort_keys=True)


def markdown(df: DataFrame) -> str:
    """A small aggregate as a markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
