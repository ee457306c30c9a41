"""Queries over what the sinks write and the sources read back, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.split import checkpoint_folder
from ..sources import appends, lines, readers, writers
from .catalog import query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in batches that overlap, one of them twice: each counts once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    t = appends.AppendTable(spark, _folder(spark, "append"), "o_orderkey long, o_custkey long, o_totalprice double", "o_orderkey")
    t.append(o.filter("o_orderkey % 3 = 0"), "a")
    t.append(o.filter("o_orderkey % 3 <> 2"), "b")
    t.append(o.filter("o_orderkey % 3 = 0"), "a")
    t.append(o, "c")
    return t.read().withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT p_partkey, p_name, p_type FROM part")
def appended_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: parts appended in two batches to a CSV table with one header."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_type")
    t = appends.AppendTable(spark, _folder(spark, "csv"), "p_partkey long, p_name string, p_type string", "p_partkey", "csv")
    t.append(p.filter("p_partkey % 2 = 0"), "even")
    t.append(p, "rest")
    header, *parts = t.text_files()
    names = readers.delimited(spark, header).columns
    return spark.read.schema("a long, b string, c string").csv(parts, quote='"', escape='"', multiLine=True).toDF(*names)


@query("SELECT conv_id, turn, nullif(role, '') AS role, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, '')) AS n_chars FROM conversations")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, separators and line ends, written and read back; an empty cell is NULL."""
    c = table(spark, sf_dir, "conversations")
    path = _folder(spark, "table")
    writers.write_table(c, path, ["conv_id", "turn", "role", "text"])
    back = readers.delimited(spark, path, columns=["conv_id", "turn", "role", "text"])
    said = F.coalesce("text", F.lit(""))
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.sha2(said, 256).alias("text_sha256"), F.length(said).cast("long").alias("n_chars"))


@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, read back strictly."""
    path = _folder(spark, "lines")
    writers.write_json_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path)
    return lines.strict_json_objects(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    """
SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'short' ELSE l_returnflag END AS kind, count(*)::BIGINT AS n, sum(CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_partkey END)::BIGINT AS parts FROM lineitem GROUP BY 1"""
)
def short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a tab-separated table of all lines, of which some lack fields: these are set aside. (The orders divisible by 97 are the faults
    that the operator is about.)"""
    li = table(spark, sf_dir, "lineitem")
    path = _folder(spark, "tsv")
    li.select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.when(F.col("l_orderkey") % 97 != 0, F.col("l_returnflag")))).write.text(path)
    rows, short = lines.plain_table_of(lines.numbered_lines(spark, path), ["order", "part", "flag"])
    good = rows.select(F.col("flag").alias("kind"), F.col("part").cast("long").alias("part"))
    return good.unionByName(short.select(F.lit("short").alias("kind"), F.lit(None).cast("long").alias("part"))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("part").alias("parts"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM orders")
def split_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a folder for each split, read as one table."""
    k = F.col("o_orderkey") % 10
    path = _folder(spark, "splits")
    writers.write_splits(table(spark, sf_dir, "orders").select("o_orderkey", F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split")), path)
    return spark.read.parquet(path)
