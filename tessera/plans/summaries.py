"""Queries on aggregation: replicates, profiles, endpoint and metric summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate, rank
from .catalog import query, table


@query(
    """
SELECT user_id, event_type, median(value) AS median_value, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value, round(max(value) - min(value), 9) AS value_range,
 count(*)::BIGINT AS n_values, count(DISTINCT props)::BIGINT AS n_props, arg_min(props, event_id) AS props FROM events GROUP BY user_id, event_type"""
)
def replicate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = aggregate.replicates(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["props"], ["props"], "event_id")
    return r.withColumn("mean_value", F.round("mean_value", 6)).withColumn("value_range", F.round("value_range", 9))


@query(
    """
SELECT l_partkey, l_suppkey, l_returnflag, median(l_extendedprice) AS median_value, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT l_linestatus)), '|') AS statuses,
 array_to_string(list_sort(list(l_orderkey))[1:3], ',') AS first_orders FROM lineitem GROUP BY ALL"""
)
def replicate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected evidence, cut to the first three: only these rows are collected, whatever the group's size."""
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    li = table(spark, sf_dir, "lineitem")
    x = li.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("l_orderkey")))
    g = x.groupBy(*keys).agg(F.median("l_extendedprice").alias("median_value"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), "|").alias("statuses"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 3, F.col("l_orderkey")))).alias("a"))
    return g.select(*keys, "median_value", "n", "statuses", F.array_join(F.col("a").cast("array<string>"), ",").alias("first_orders"))


@query(
    """
SELECT event_type, count(*)::BIGINT AS n_rows, count(DISTINCT user_id)::BIGINT AS n_molecules, count(DISTINCT event_id % 90)::BIGINT AS n_buckets, min(value) AS min_value, max(value) AS max_value, arg_min(user_id, event_id) AS user_id, arg_min(props, event_id) AS props FROM events GROUP BY event_type"""
)
def first_wins_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    e = table(spark, sf_dir, "events").withColumn("bucket", F.col("event_id") % 90)
    return aggregate.first_wins_summary(e, "event_type", "user_id", "bucket", "value", ["user_id", "props"], "event_id")


@query(
    """
WITH m AS (SELECT user_id, event_type, median(value) AS v FROM events GROUP BY ALL), k AS (SELECT user_id FROM m GROUP BY user_id HAVING count(*) >= 4)
SELECT user_id, count(*)::BIGINT AS n_endpoints, array_to_string(list_sort(list(event_type)), '|') AS endpoints, round(sum(v), 6) AS total FROM m WHERE user_id IN (SELECT user_id FROM k) GROUP BY user_id"""
)
def profile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = aggregate.profile_maps(aggregate.profiles(table(spark, sf_dir, "events"), "user_id", "event_type", "value", 4), "user_id", "event_type")
    return p.select("user_id", F.size("profile").cast("long").alias("n_endpoints"), F.array_join(F.map_keys("profile"), "|").alias("endpoints"), F.round(F.aggregate(F.map_values("profile"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 150")
def eligible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.groups_of(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], 150)


@query(
    """SELECT l_suppkey, count(*)::BIGINT AS n, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem WHERE l_quantity >= 10 AND lower(l_returnflag) LIKE '%n%' GROUP BY l_suppkey HAVING count(*) >= 20 ORDER BY n DESC, l_suppkey LIMIT 25"""
)
def top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") >= 10) & F.lower("l_returnflag").like("%n%"))
    return li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts")).filter("n >= 20").orderBy(F.desc("n"), "l_suppkey").limit(25)


@query(
    """SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT props)::BIGINT AS buckets, median(value) AS median_value FROM events GROUP BY event_type"""
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("buckets"), F.median("value").alias("median_value"))


@query(
    """
WITH k AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT l_returnflag, arg_min(l_linestatus, (-n, l_linestatus)) AS mode_type, array_to_string(list_sort(list(l_linestatus)), '|') AS types FROM k GROUP BY l_returnflag)
SELECT l_returnflag, count(*)::BIGINT AS n_rows, count(DISTINCT l_partkey)::BIGINT AS n_molecules, count(DISTINCT l_suppkey)::BIGINT AS n_buckets, count_if(l_discount > 0.05)::BIGINT AS n_censored,
 min(l_extendedprice) AS min_value, median(l_extendedprice) AS median_value, max(l_extendedprice) AS max_value, any_value(mode_type) AS mode_type, any_value(types) AS types FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag"""
)
def endpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.endpoint_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey", "l_extendedprice", "l_suppkey", "l_linestatus", F.col("l_discount") > 0.05)


@query(
    """
WITH s AS (SELECT 'experimental' AS tier, event_type AS endpoint, value, user_id AS m FROM events
 UNION ALL SELECT 'proxy', 'p_size', p_size, p_partkey FROM part UNION ALL SELECT 'proxy', 'p_retailprice', p_retailprice, p_partkey FROM part)
SELECT tier, endpoint, count(*)::BIGINT AS samples, count(DISTINCT m)::BIGINT AS molecules, min(value) AS least, max(value) AS most,
 CASE WHEN tier = 'proxy' THEN 'Use as secondary constraint or silver training signal' WHEN count(*) >= 10000 THEN 'Strong candidate for benchmark property' WHEN count(*) >= 3000 THEN 'Usable candidate; inspect assay buckets' ELSE 'Lower coverage; use selectively or after expansion' END AS advice,
 CASE WHEN tier = 'proxy' THEN 'Use as secondary constraint or silver training signal' WHEN count(*) >= 1000 AND count(DISTINCT m) >= 700 THEN 'Usable broad candidate; condition filtering recommended' ELSE 'Lower coverage; use selectively' END AS broad
FROM s GROUP BY tier, endpoint"""
)
def two_tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured endpoints beside unpivoted descriptors."""
    facts = table(spark, sf_dir, "events").select(F.lit("experimental").alias("tier"), F.col("event_type").alias("endpoint"), "value", F.col("user_id").alias("m"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("m"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    proxy = part.unpivot(["m"], ["p_size", "p_retailprice"], "endpoint", "value").select(F.lit("proxy").alias("tier"), "endpoint", "value", "m")
    s = facts.unionByName(proxy).groupBy("tier", "endpoint").agg(F.count("*").alias("samples"), F.count_distinct("m").alias("molecules"), F.min("value").alias("least"), F.max("value").alias("most"))
    return s.withColumn("advice", S.sample_band(F.col("samples"), F.col("tier"))).withColumn("broad", S.coverage_band(F.col("samples"), F.col("molecules"), F.lit(1), F.col("tier")))


@query("SELECT n, count(*)::BIGINT AS orders FROM (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) GROUP BY n")
def answers_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, A17."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("orders"))


@query("SELECT count(*)::BIGINT AS groups, min(n) AS least, median(n) AS middle, max(n) AS most FROM (SELECT count(*)::BIGINT AS n FROM events GROUP BY user_id, event_type)")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.group_size_stats(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query(
    """WITH x AS (SELECT source, quality FROM documents JOIN labels USING (doc_id)), p AS (SELECT source, avg(quality) AS a FROM x GROUP BY source)
SELECT count(*)::BIGINT AS sources, round(avg(a), 9) AS macro, round((SELECT avg(quality) FROM x), 9) AS micro FROM p"""
)
def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return aggregate.macro_micro(x, "source", "quality").select("sources", F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"))


@query("SELECT p_partkey, coalesce(n, 0)::BIGINT AS n_exact FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_partkey = p_partkey")
def dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("p_partkey"))
    return aggregate.with_counts(table(spark, sf_dir, "part").select("p_partkey"), facts, "p_partkey", "n_exact")


@query(
    """SELECT count(*)::BIGINT AS n, median(length(text)) AS median_length, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9) AS rate, round(avg(length(text)), 6) AS mean_length FROM documents JOIN labels USING (doc_id)"""
)
def audit_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf_dir, "labels"), "doc_id")
    return x.agg(F.count("*").alias("n"), F.median("n").alias("median_length"), F.round(F.avg((F.col("quality") == 1).cast("double")), 9).alias("rate"), F.round(F.avg("n"), 6).alias("mean_length"))


@query(
    """
WITH x AS (SELECT o_custkey, p_brand, l_partkey, l_extendedprice, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
c AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS cores FROM x GROUP BY 1)
SELECT o_custkey, p_brand, arg_max(l_partkey, (l_extendedprice, -l_partkey)) AS best, max(l_extendedprice) AS delta, any_value(cores) AS cores FROM x JOIN c USING (o_custkey) GROUP BY ALL"""
)
def best_answer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer with the largest gain for every target of a query, and all cores of the query."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")
    o, p = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    x = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    best = x.groupBy("o_custkey", "p_brand").agg(F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_partkey"))).alias("best"), F.max("l_extendedprice").alias("delta"), F.collect_set("l_returnflag").alias("c"))
    cores = best.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))), "|").alias("cores"))
    return best.drop("c").join(cores, "o_custkey")


@query(
    """
WITH f AS (SELECT *, l_discount > 0.05 AS good, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, row_number() OVER (PARTITION BY l_orderkey, l_discount > 0.05, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS z FROM lineitem),
p AS (SELECT l_orderkey, to_json(list(l_partkey ORDER BY l_extendedprice DESC, l_partkey)) AS positives, count(*) AS n FROM f WHERE z = 1 AND good GROUP BY 1),
n AS (SELECT l_orderkey, to_json(list(l_partkey ORDER BY l_tax DESC, l_extendedprice DESC, l_partkey)) AS negatives FROM f WHERE z = 1 AND NOT good GROUP BY 1)
SELECT l_orderkey, max(CASE WHEN i = 1 THEN l_suppkey END) AS l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS cores, any_value(positives)::VARCHAR AS positives, coalesce(any_value(negatives)::VARCHAR, '[]') AS negatives FROM f JOIN p USING (l_orderkey) LEFT JOIN n USING (l_orderkey) WHERE p.n >= 2 GROUP BY l_orderkey"""
)
def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 in full: attributes of the first row, cores, positives and negatives as JSON."""
    li = table(spark, sf_dir, "lineitem").withColumns({"gain": -F.col("l_extendedprice"), "near": -F.col("l_tax")})
    x = aggregate.answer_records(
        li, ["l_orderkey"], F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_partkey", F.col("l_discount") > 0.05, [F.col("gain")], [F.col("near"), F.col("gain")], "l_returnflag", ["l_suppkey"]
    )
    return x.select("l_orderkey", "l_suppkey", F.array_join("cores", "|").alias("cores"), F.to_json("positives").alias("positives"), F.to_json("negatives").alias("negatives"))


@query(
    """
WITH m AS (SELECT user_id, event_type, event_id % 3 AS b, median(value) AS v, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL)
SELECT user_id, event_type, b, v AS median_value, n::BIGINT AS n_values FROM m WHERE user_id IN (SELECT user_id FROM m GROUP BY user_id HAVING count(DISTINCT event_type) >= 3)"""
)
def supported_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: replicates of supported endpoints by bucket, for molecules with three endpoints or more."""
    e = table(spark, sf_dir, "events").withColumn("b", F.col("event_id") % 3)
    return aggregate.supported_replicates(e, "user_id", "event_type", ["b"], "value", F.col("event_type") != "error", 3).select("user_id", "event_type", "b", "median_value", "n_values")


@query(
    """
WITH m AS (SELECT l_suppkey, l_partkey, median(l_extendedprice) AS v FROM lineitem GROUP BY ALL), t AS (SELECT l_suppkey FROM m GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 7),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY sha1('3|' || l_partkey)) AS k FROM m WHERE l_suppkey IN (SELECT l_suppkey FROM t)) SELECT l_suppkey, l_partkey, v AS median_value FROM r WHERE k <= 12"""
)
def capped_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the largest endpoints, a sample of each."""
    return aggregate.capped_replicates(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice", 7, 12, "3").select("l_suppkey", "l_partkey", "median_value")


@query(
    """
WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Use as secondary constraint or silver training signal' WHEN p_partkey * 100 >= 10000 THEN 'Strong candidate for benchmark property' WHEN p_partkey * 100 >= 3000 THEN 'Usable candidate; inspect assay buckets' ELSE 'Lower coverage; use selectively or after expansion' END AS r FROM part)
SELECT p_partkey, CASE WHEN r LIKE 'Strong%' THEN 'strong' WHEN r LIKE 'Usable%' THEN 'usable' WHEN r LIKE 'Lower%' THEN 'low' ELSE 'proxy' END AS badge FROM b"""
)
def recommendation_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F38, F39."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, S.badge(S.sample_band(k * 100, F.when(k % 9 == 0, "proxy").otherwise("experimental"))).alias("badge"))


@query(
    """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_returnflag) AS n FROM lineitem),
r AS (SELECT l_orderkey, l_partkey, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS k FROM f WHERE n = 1)
SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY k) FILTER (k <= 2), ',') AS answers, count(*)::BIGINT AS n_distinct, array_to_string(list_sort(list(DISTINCT flag)), '|') AS cores, format('q_{:06d}', l_orderkey) AS query_id FROM r GROUP BY l_orderkey HAVING count(*) >= 2"""
)
def multi_answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a query, first row of each target wins, best two in order; queries with one answer go."""
    first = rank.first_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], [F.col(c) for c in ("l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag")])
    answer = F.struct((-F.col("l_extendedprice")).alias("d"), F.col("l_partkey").alias("id"))
    g = first.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(answer)).alias("a"), F.count("*").alias("n_distinct"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("cores")).filter("n_distinct >= 2")
    return g.select("l_orderkey", F.array_join(F.transform(F.slice("a", 1, 2), lambda x: x["id"].cast("string")), ",").alias("answers"), "n_distinct", "cores", F.format_string("q_%06d", "l_orderkey").alias("query_id"))


@query(
    """
WITH x AS (SELECT o_orderkey, unnest([o_orderstatus, substr(o_orderpriority, 1, 1), o_orderstatus]) AS item FROM orders)
SELECT count(DISTINCT item)::BIGINT AS items, count(*)::BIGINT AS n, count(DISTINCT (o_orderkey, item))::BIGINT AS row_items FROM x"""
)
def nested_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over exploded JSON answers."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1), "o_orderstatus")).alias("j"))
    x = o.select("o_orderkey", F.explode(F.from_json("j", "array<string>")).alias("item"))
    return x.agg(F.count_distinct("item").alias("items"), F.count("*").alias("n"), F.count_distinct("o_orderkey", "item").alias("row_items"))


@query(
    """
WITH x AS (SELECT l_partkey, l_returnflag || l_linestatus AS e, l_linenumber AS b, l_extendedprice AS v, (l_orderkey * 10 + l_linenumber)::VARCHAR AS o, l_suppkey::VARCHAR AS a FROM lineitem),
m AS (SELECT l_partkey, e, median(v) AS v, count(DISTINCT o) AS n FROM x GROUP BY ALL), p AS (SELECT l_partkey, string_agg(e || ':' || n, ',' ORDER BY e) AS profile, round(sum(v), 4) AS total FROM m GROUP BY l_partkey HAVING count(*) >= 4)
SELECT l_partkey, e AS endpoint, b AS bucket, round(median(v), 6) AS median_value, count(*)::BIGINT AS n_values, string_agg(DISTINCT o, ',' ORDER BY o) AS observations, count(DISTINCT a)::BIGINT AS n_assays, any_value(profile) AS profile, any_value(total) AS profile_total FROM x JOIN p USING (l_partkey) GROUP BY ALL"""
)
def profiled_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    x = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("endpoint"), F.col("l_linenumber").alias("bucket"), "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_suppkey")
    y = aggregate.profiled_replicates(x, "l_partkey", "endpoint", ["bucket"], "l_extendedprice", "o", "l_suppkey", 4)
    profile = F.array_join(F.transform("profile", lambda p: F.concat_ws(":", p["endpoint"], F.size(p["observations"]).cast("string"))), ",")
    total = F.round(F.aggregate("profile", F.lit(0.0), lambda s, p: s + p["median_value"]), 4)
    return y.select("l_partkey", "endpoint", "bucket", F.round("median_value", 6).alias("median_value"), "n_values", F.array_join("observations", ",").alias("observations"), F.size("assays").cast("long").alias("n_assays"), profile.alias("profile"), total.alias("profile_total"))
