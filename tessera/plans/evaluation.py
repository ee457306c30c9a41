"""Queries on rank metrics, calibration, features and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, metrics, ordered, split
from .catalog import query, table

# Predictions: the lines of an order by price; answers: lines by discount with a gain.
_PRED = "pred AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS pos, l_partkey AS item FROM lineitem WHERE l_orderkey % 5 <> 0)"
_ANS = "ans AS (SELECT l_orderkey AS q, l_partkey AS item, max(l_discount * 10) AS gain FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Queries, predictions, answers, and in how many partitions lines are dealt out by order."""
    li = table(spark, sf_dir, "lineitem")
    n = split.tasks(li)
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag").repartition(n, "l_orderkey")
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    ranked = li.filter("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("query_id"), place.alias("pos"), F.col("l_partkey").alias("item"))
    answers = li.filter("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item")).agg(F.max(F.col("l_discount") * 10).alias("gain"))
    return q, ranked, answers, n


@query(
    f"""
WITH {_PRED}, {_ANS},
h AS (SELECT pred.q, pos, pred.item, coalesce(gain, 0.0) AS gain FROM pred LEFT JOIN ans ON ans.q = pred.q AND ans.item = pred.item WHERE pos <= 3),
g AS (SELECT q, max(CASE WHEN gain > 0 THEN 1 ELSE 0 END) AS success, min(CASE WHEN gain > 0 THEN pos END) AS f, sum(gain / log2(pos + 1)) AS dcg, count(DISTINCT item) / count(*) AS diversity FROM h GROUP BY q),
i AS (SELECT q, sum(gain / log2(pos + 1)) AS ideal FROM (SELECT q, gain, row_number() OVER (PARTITION BY q ORDER BY gain DESC, item) AS pos FROM ans) WHERE pos <= 3 GROUP BY q)
SELECT o_orderkey AS query_id, coalesce(success, 0)::INTEGER AS success, round(coalesce(1 / f, 0), 9) AS mrr, round(coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0), 9) AS ndcg, round(coalesce(diversity, 0), 9) AS diversity
FROM orders LEFT JOIN g ON g.q = o_orderkey LEFT JOIN i ON i.q = o_orderkey"""
)
def ranked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E3, W17, J6."""
    *inputs, n = _inputs(spark, sf_dir)
    m = metrics.ranked_metrics(*inputs, k=3, tasks=n)
    return m.select("query_id", "success", *(F.round(c, 9).alias(c) for c in ("mrr", "ndcg", "diversity")))


@query(
    """
WITH x AS (SELECT l_tax * 14 AS conf, l_returnflag = 'N' AS y FROM lineitem), t AS (SELECT count(conf) AS total FROM x),
b AS (SELECT least(floor(conf * 10), 9)::INTEGER AS bin, count(*) AS n, avg(conf) AS mc, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS acc FROM x WHERE conf BETWEEN 0 AND 1 GROUP BY 1)
SELECT bin, n::BIGINT AS n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy, round(n / total * abs(acc - mc), 6) AS ece_part FROM b CROSS JOIN t"""
)
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_tax") * 14).alias("conf"), (F.col("l_returnflag") == "N").cast("int").alias("y"))
    b = metrics.calibration_bins(x, "conf", "y")
    return b.select("bin", "n", *(F.round(c, 6).alias(c) for c in ("mean_confidence", "accuracy", "ece_part")))


@query(
    """
WITH x AS (SELECT l_suppkey AS g, l_extendedprice AS s, l_returnflag = 'N' AS y FROM lineitem)
SELECT p.g AS l_suppkey, count(DISTINCT p.id)::BIGINT AS positives, (SELECT count(*) FROM x z WHERE z.g = p.g AND NOT z.y)::BIGINT AS negatives, round(avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END), 9) AS accuracy
FROM (SELECT g, s, row_number() OVER () AS id FROM x WHERE y) p JOIN (SELECT g, s FROM x WHERE NOT y) n ON n.g = p.g GROUP BY p.g"""
)
def pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 (also the area under the curve of a group): by ranks, without pairs."""
    return order_accuracy(table(spark, sf_dir, "lineitem"))


def order_accuracy(x: DataFrame) -> DataFrame:
    a = metrics.pairwise_accuracy(x, "l_suppkey", "l_extendedprice", F.col("l_returnflag") == "N")
    return a.select("l_suppkey", F.col("positives").cast("long").alias("positives"), F.col("negatives").cast("long").alias("negatives"), F.round("accuracy", 9).alias("accuracy"))


@query(
    """
WITH r AS (SELECT l_suppkey, l_returnflag = 'N' AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS k FROM lineitem),
h AS (SELECT l_suppkey, y, k, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY k) AS hits FROM r) SELECT l_suppkey, count(*)::BIGINT AS positives, round(avg(hits / k), 9) AS average_precision FROM h WHERE y GROUP BY l_suppkey"""
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every supplier."""
    x = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return metrics.average_precision(x, "l_extendedprice", F.col("l_returnflag") == "N", "id", "l_suppkey").select("l_suppkey", "positives", F.round("average_precision", 9).alias("average_precision"))


@query(
    """
WITH r AS (SELECT l_returnflag = 'N' AS y, l_extendedprice AS s, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k FROM lineitem),
h AS (SELECT y, k, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER (ORDER BY k) AS hits FROM r), ap AS (SELECT avg(hits / k) AS ap FROM h WHERE y),
c AS (SELECT s, count_if(y) AS p, count_if(NOT y) AS n FROM r GROUP BY s), u AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n / 2 AS below FROM c)
SELECT any_value(ap) IS NOT NULL AS found, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(p * below) / (sum(p) * sum(n)), 9) AS accuracy, round(any_value(ap), 9) AS average_precision FROM u CROSS JOIN ap"""
)
def overall_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 over all lines at once."""
    x = table(spark, sf_dir, "lineitem")
    y = F.col("l_returnflag") == "N"
    right = ordered.overall_accuracy(x, "l_extendedprice", y)
    precision = ordered.overall_precision(x.select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_extendedprice", y, [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")])
    both = right.crossJoin(F.broadcast(precision.select("average_precision")))  # one row each
    return both.select(F.col("average_precision").isNotNull().alias("found"), "positives", "negatives", F.round("accuracy", 9).alias("accuracy"), F.round("average_precision", 9).alias("average_precision"))


@query(
    """
WITH r AS (SELECT l_orderkey AS q, l_returnflag = 'N' AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k FROM lineitem),
g AS (SELECT q, count_if(y) AS gold, max(CASE WHEN k = 1 AND y THEN 1 ELSE 0 END) AS hit1, count_if(y AND k <= 3) AS found, min(CASE WHEN y THEN k END) AS f FROM r GROUP BY q)
SELECT q AS l_orderkey, gold::BIGINT AS gold, hit1::INTEGER AS hit1, round(found / gold, 9) AS recall, (found = gold)::INTEGER AS all_gold, round(1 / f, 9) AS reciprocal_rank FROM g WHERE gold > 0"""
)
def candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, recall, all-gold and reciprocal rank of candidates scored by a heuristic."""
    m = metrics.candidate_metrics(table(spark, sf_dir, "lineitem").withColumn("first", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")), "l_orderkey", "l_quantity", F.col("l_returnflag") == "N", "first", 3)
    return m.select("l_orderkey", F.col("gold").cast("long").alias("gold"), "hit1", F.round("recall", 9).alias("recall"), "all_gold", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


@query(
    f"""
WITH {_ANS}, r AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY gain DESC, item) AS k FROM ans)
SELECT q AS query_id, array_to_string(list(item ORDER BY k), ',') AS ranked, count(*)::BIGINT AS n FROM r GROUP BY q"""
)
def oracle_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers in order of confidence as predictions."""
    _, _, answers, _ = _inputs(spark, sf_dir)
    a = answers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("g"), "item"))).alias("a"))
    return a.select("query_id", F.array_join(F.transform("a", lambda x: x["item"].cast("string")), ",").alias("ranked"), F.size("a").cast("long").alias("n"))


@query(
    r"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_+\-.]+')[1:96]) AS tok FROM conversations)
SELECT conv_id, turn, ('0x' || substr(sha1(tok), 1, 12))::BIGINT % 256 AS "column", count(*)::DOUBLE AS value FROM t GROUP BY ALL"""
)
def token_hash_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8."""
    return turn_features(table(spark, sf_dir, "conversations"))


def turn_features(c: DataFrame) -> DataFrame:
    return features.hashed_tokens(c.withColumn("row", F.struct("conv_id", "turn")), "row", "text", 256).select("row.conv_id", "row.turn", "column", "value")


@query(
    """
SELECT doc_id, len(messages)::INTEGER AS n_messages, messages[1] AS first_content, md5(array_to_string(messages, '|')) AS digest FROM (
SELECT doc_id, list_filter(['You are ' || lang, 'Edit document ' || doc_id || ' from ' || source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END], lambda x: x IS NOT NULL) AS messages FROM documents)"""
)
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14, F29."""
    d = table(spark, sf_dir, "documents")
    m = features.chat_messages(("system", F.concat(F.lit("You are "), "lang")), ("user", F.format_string("Edit document %d from %s", "doc_id", "source")), ("assistant", F.when(F.col("doc_id") % 3 != 0, F.col("text"))))
    x = d.select("doc_id", F.transform(m, lambda t: t["content"]).alias("c"))
    return x.select("doc_id", F.size("c").alias("n_messages"), F.col("c")[0].alias("first_content"), F.md5(F.array_join("c", "|")).alias("digest"))
