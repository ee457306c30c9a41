"""Line-based text with line numbers: faulty lines are named by file and line, or set aside.

Files are read in splits, so a line's number is its place in the split plus the lines of the splits before it: one row for each split is
summed up, never the lines of a file in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import null_text


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): every line of the files, numbered from 1; blank ones count."""
    told = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = told.groupBy("path", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return told.join(offsets, ["path", "_start"]).select("path", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def _raised(faulty: DataFrame, what: str) -> None:
    """Raise for the first faulty line, if there is one."""
    first = faulty.agg(F.min(F.struct("path", "line", "reason")).alias("f")).first()["f"]
    if first is not None:
        raise ValueError(f"{first['path']}:{first['line']}: {first['reason']} ({what})")


def json_objects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): the objects of a file of JSON lines, and the lines that hold none, as (path, line, value, reason); blank lines
    are neither."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    kept = f"{schema}, _faulty string"
    parsed = lines.withColumn("_row", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_faulty"}))
    reason = F.when(~F.coalesce(F.ltrim("value").startswith("{"), F.lit(False)), "no object").when(F.col("_row").isNull() | F.col("_row._faulty").isNotNull(), "no valid JSON of this schema")
    marked = parsed.withColumn("reason", reason)
    names = [c for c in spark.createDataFrame([], schema).columns]
    return marked.filter("reason is null").select(*(F.col(f"_row.`{c}`").alias(c) for c in names)), marked.filter("reason is not null").select("path", "line", "value", "reason")


def strict_json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As above; the first faulty line is an error that names file and line."""
    rows, faulty = json_objects(spark, path, schema)
    _raised(faulty, "JSON lines")
    return rows


def _fields(line: Column, sep: str) -> Column:
    return F.split(line, f"\\Q{sep}\\E", -1)


def plain_table(spark: SparkSession, path: str, sep: str = "\t", columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: (rows, quarantine) of delimited text without quoting, gzip read as it is: the first line of every file is the header and must be the same in
    all of them, and have ``columns``; a line with fewer fields goes to quarantine, further fields are left out. Blank lines are neither."""
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    headers = [r["value"] for r in lines.filter("line = 1").select("value").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"{'no header' if not headers else 'files differ in their headers'}: {path}")
    names = headers[0].split(sep)
    missing = [c for c in columns or () if c not in names]
    if missing:
        raise ValueError(f"columns not in the header: {missing}")
    return plain_table_of(lines.filter("line > 1"), names, sep, columns)


def plain_table_of(lines: DataFrame, names: Sequence[str], sep: str = "\t", columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: the same of numbered lines without a header, whose fields are ``names``."""
    body = lines.filter("value <> ''").withColumn("_f", _fields(F.col("value"), sep))
    short = F.size("_f") < len(names)
    rows = body.filter(~short).select(*(F.col("_f")[list(names).index(c)].alias(c) for c in columns or names))
    reason = F.concat(F.size("_f").cast("string"), F.lit(f" fields of {len(names)}"))
    return null_text(rows), body.filter(short).select("path", "line", "value", reason.alias("reason"))
