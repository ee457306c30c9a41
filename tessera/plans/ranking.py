"""Queries on top-k, caps, ids, unions and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dedupe, rank
from .catalog import query, table


@query("SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem WHERE l_shipdate >= DATE '1995-01-01'")
def rank_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order of value within their group."""
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))
    return li.select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query(
    """
WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT l_suppkey, l_returnflag, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS k FROM g)
SELECT l_returnflag, l_suppkey, n::BIGINT AS n, k AS place FROM r WHERE k <= 5"""
)
def groups_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest groups first."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return rank.top_k(g, ["l_returnflag"], [F.desc("n"), F.col("l_suppkey")], 5, "place").select("l_returnflag", "l_suppkey", "n", F.col("place").cast("long").alias("place"))


@query(
    """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE k <= 3 ORDER BY o_custkey, o_orderkey LIMIT 500"""
)
def first_n_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap per group and a global cap."""
    return rank.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey").limit(500)


@query(
    """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END DESC, o_orderpriority DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, k AS place FROM r WHERE k <= 4"""
)
def top_k_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best by signed gain, then two tie-breaks."""
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    x = rank.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [signed.desc(), F.desc("o_orderpriority"), F.col("o_orderkey")], 4, "place")
    return x.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query(
    """
WITH x AS (SELECT l_orderkey, l_partkey, l_extendedprice AS d, l_discount AS s, l_returnflag <> 'R' AS good, l_linenumber AS ln FROM lineitem),
p AS (SELECT l_orderkey, list(l_partkey ORDER BY d DESC, l_partkey, ln)[1:2] AS ps FROM x WHERE good GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT l_orderkey, list(l_partkey ORDER BY s DESC, d DESC, l_partkey)[1] AS neg FROM x WHERE NOT good GROUP BY 1)
SELECT l_orderkey, ps[1] AS first, ps[2] AS second, neg AS negative FROM p JOIN n USING (l_orderkey)"""
)
def positives_and_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two positives and one negative per query, by sorted arrays; queries that lack one go."""
    good = F.col("l_returnflag") != "R"
    d = -F.col("l_extendedprice")
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.when(good, F.struct(d.alias("d"), "l_partkey", "l_linenumber")))).alias("p"),
        F.array_min(F.collect_list(F.when(~good, F.struct((-F.col("l_discount")).alias("s"), d.alias("d"), "l_partkey")))).alias("n"),
    )
    return x.filter((F.size("p") >= 2) & F.col("n").isNotNull()).select("l_orderkey", F.col("p")[0]["l_partkey"].alias("first"), F.col("p")[1]["l_partkey"].alias("second"), F.col("n.l_partkey").alias("negative"))


@query(
    """WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha1('42|' || o_orderkey)) AS k FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE k <= 20"""
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.hash_sample(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderkey"), 20, "42").select("o_orderpriority", "o_orderkey")


@query(
    """SELECT c_custkey, format('q_{:06d}', row_number() OVER (ORDER BY c_mktsegment, c_custkey)) AS query_id, 'Q' || substr(sha1(c_mktsegment || '|' || c_custkey), 1, 12) AS content_id FROM customer"""
)
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13, W14."""
    c = rank.numbered(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_custkey"], "query_id")
    return c.select("c_custkey", "query_id", rank.content_id("Q", 12, F.col("c_mktsegment"), F.col("c_custkey")).alias("content_id"))


_UNION = """
WITH s AS (SELECT 0 AS source_rank, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'u' || (event_id % 700) END AS uid, value AS v, user_id AS k FROM events
 UNION ALL SELECT 1, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE 'u' || (l_orderkey % 1500) END, l_extendedprice, l_partkey FROM lineitem)"""


def _sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e, li = table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem")
    uid = lambda key, n: F.concat(F.lit("u"), (F.col(key) % n).cast("string"))
    a = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 == 0, "").otherwise(uid("event_id", 700)).alias("uid"), F.col("value").alias("v"), F.col("user_id").alias("k"))
    b = li.select((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"), F.when(F.col("l_orderkey") % 9 != 0, uid("l_orderkey", 1500)).alias("uid"), F.col("l_extendedprice").alias("v"), F.col("l_partkey").alias("k"))
    return [a, b]


@query(_UNION + ", r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY source_rank, seq) AS n FROM s WHERE uid <> '') SELECT uid, source_rank, seq, v FROM r WHERE n = 1")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D3, D4."""
    return dedupe.union_first_wins(_sources(spark, sf_dir), "uid", "seq").select("uid", "source_rank", "seq", "v")


@query(
    _UNION
    + """, t AS (SELECT *, CASE WHEN coalesce(uid, '') = '' THEN source_rank || '|' || k ELSE uid END AS key FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank, seq) AS n FROM t)
SELECT source_rank, count(*)::BIGINT AS n, sum(seq % 1000000007)::BIGINT AS seqs FROM r WHERE n = 1 GROUP BY source_rank"""
)
def merge_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys for rows without an id, and counts per part."""
    x = dedupe.union_first_wins(_sources(spark, sf_dir), "uid", "seq", F.concat_ws("|", F.col("source_rank").cast("string"), F.col("k").cast("string")))
    return x.groupBy("source_rank").agg(F.count("*").alias("n"), F.sum(F.col("seq") % 1000000007).alias("seqs"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.last_wins(table(spark, sf_dir, "events"), "user_id", ["event_type", "value"], F.col("event_id"))


@query(
    """
WITH x AS (SELECT a.l_partkey AS a, b.l_partkey AS b, a.l_orderkey AS bucket, min(a.l_linenumber) AS ln FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY bucket, ln) AS n FROM x) SELECT a, b, bucket FROM r WHERE n = 1"""
)
def ordered_pairs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6."""
    # an order has a few lines: a plain join, without blocks
    side = lambda name: table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias(name))
    x = side("a").join(side("b"), "l_orderkey").filter("a <> b")
    return dedupe.first_buckets(x, "a", "b", "l_orderkey").select("a", "b", F.col("l_orderkey").alias("bucket"))


@query(
    """
WITH e AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS h, value FROM events)
SELECT event_type, h AS hour, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM e GROUP BY ALL"""
)
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the streaming extension's tumbling windows."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select("event_type", F.expr("unix_seconds(cast(w.start as timestamp)) div 3600").alias("hour"), "n", "total")


@query("SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 30 ORDER BY n DESC, l_partkey LIMIT 40")
def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.frequent(table(spark, sf_dir, "lineitem"), "l_partkey", 40, 30)


@query("SELECT split, count(*)::BIGINT AS n FROM (SELECT 'train' AS split FROM orders WHERE o_orderkey % 10 < 8 UNION ALL SELECT 'val' FROM orders WHERE o_orderkey % 10 = 8 UNION ALL SELECT 'test' FROM orders WHERE o_orderkey % 10 = 9) GROUP BY split")
def union_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their label, put together again."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 10
    parts = [o.filter(k < 8).withColumn("split", F.lit("train")), o.filter(k == 8).withColumn("split", F.lit("val")), o.filter(k == 9).withColumn("split", F.lit("test"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"))
