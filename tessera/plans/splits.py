"""Queries on splits, leakage and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, dedupe, ordered, split
from .catalog import query, table

_FRACTION = "(('0x' || substr(sha1({0}), 1, 8))::BIGINT / 4294967295.0)"
_HASH48 = "(('0x' || substr(sha1(CAST({0} AS VARCHAR)), 1, 12))::BIGINT)"
_SPLIT = "CASE WHEN {f} < 0.8 THEN 'train' WHEN {f} < 0.8 + 0.1 THEN 'valid' ELSE 'test' END"


@query(f"SELECT p_partkey, {_SPLIT.format(f=_FRACTION.format('p_type'))} AS split FROM part")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", split.by_fraction(F.col("p_type")).alias("split"))


@query(
    f"""
WITH r AS (SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS a, 'p' || (l_partkey * 7 % 2000 + 1) AS b, {_HASH48.format("'s' || l_suppkey")} % 100 < 10 AS u FROM lineitem),
bad AS (SELECT a AS x FROM r WHERE u UNION SELECT b FROM r WHERE u)
SELECT l_orderkey, l_linenumber, u AS is_unseen FROM r WHERE u OR (a NOT IN (SELECT x FROM bad) AND b NOT IN (SELECT x FROM bad))"""
)
def unseen_target_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G3."""
    return unseen_split(table(spark, sf_dir, "lineitem"))


def unseen_split(li: DataFrame) -> DataFrame:
    key = lambda c: F.concat(F.lit("p"), c.cast("string"))
    r = li.select("l_orderkey", "l_linenumber", key(F.col("l_partkey")).alias("a"), key(F.col("l_partkey") * 7 % 2000 + 1).alias("b"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"))
    return split.unseen_cleaned(r, split.is_unseen(F.col("target")), ["a", "b"]).select("l_orderkey", "l_linenumber", "is_unseen")


_NODE_A, _NODE_B = _HASH48.format("'o' || l_orderkey"), _HASH48.format("'p' || l_partkey")


@query(
    f"""
WITH RECURSIVE e0 AS (SELECT DISTINCT {_NODE_A} AS a, {_NODE_B} AS b FROM lineitem), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
r(n, o) USING KEY (n) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a UNION SELECT e.a, min(r.o) FROM r JOIN e ON r.n = e.b JOIN recurring.r AS x ON x.n = e.a GROUP BY e.a, x.o HAVING min(r.o) < x.o)
SELECT n AS node, o AS root, CASE WHEN o % 100 < 80 THEN 'train' WHEN o % 100 < 90 THEN 'val' ELSE 'test_seen' END AS split FROM r"""
)
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the order-part graph over 48-bit hashes; the root is the smallest hash."""
    return order_part_split(table(spark, sf_dir, "lineitem"))


def order_part_split(li: DataFrame) -> DataFrame:
    e = li.select(S.hash48(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("a"), S.hash48(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("b")).distinct()
    return split.component_labels(e).select("node", F.col("label").alias("root"), split.by_component(F.col("label")).alias("split"))


@query(
    """
WITH RECURSIVE c AS (SELECT 'c' || o_custkey AS label, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), o AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS k FROM c),
t AS (SELECT greatest(sum(n) * 0.8, 1) AS s1, greatest(sum(n) * 0.1, 1) AS s2 FROM c),
g(k, label, split, f1, f2, f3) AS (
  SELECT 0::BIGINT, '', '', 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT o.k, o.label, CASE w WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END, f1 + CASE WHEN w = 1 THEN n ELSE 0 END, f2 + CASE WHEN w = 2 THEN n ELSE 0 END, f3 + CASE WHEN w = 3 THEN n ELSE 0 END
  FROM (SELECT o.k, o.label, o.n, g.f1, g.f2, g.f3, CASE WHEN (f1 + n) / s1 <= (f2 + n) / s2 AND (f1 + n) / s1 <= (f3 + n) / s2 THEN 1 WHEN (f2 + n) / s2 <= (f3 + n) / s2 THEN 2 ELSE 3 END AS w FROM g JOIN o ON o.k = g.k + 1 CROSS JOIN t) o)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'c' || o_custkey END AS component, coalesce(split, 'train') AS split FROM orders LEFT JOIN g ON label = 'c' || o_custkey AND o_orderstatus <> 'P'"""
)
def component_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components packed into splits, largest first; rows without a component go to train."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("b"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("a"))
    labels = split.component_labels(o.filter("b is not null").select("a", "b"))
    rows = o.join(labels.withColumnRenamed("node", "a"), "a", "left")
    sizes = rows.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    assigned = ordered.filled_bins(sizes, "label", "n", {"train": 0.8, "val": 0.1, "test": 0.1})
    return rows.join(assigned, "label", "left").select("o_orderkey", F.col("label").alias("component"), F.coalesce("split", F.lit("train")).alias("split"))


_ROWS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM orders"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 10
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split"))


@query(f"WITH r AS ({_ROWS}), k AS (SELECT DISTINCT split, o_custkey FROM r) SELECT a.split AS split_a, b.split AS split_b, count(*)::BIGINT AS shared FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.split < b.split GROUP BY ALL")
def leakage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.leakage_matrix(_rows(spark, sf_dir), "split", "o_custkey")


@query(
    f"""
WITH r AS ({_ROWS}), v AS (SELECT * FROM r WHERE split = 'val'), t AS (SELECT * FROM r WHERE split = 'test' AND o_custkey NOT IN (SELECT o_custkey FROM v)),
n AS (SELECT * FROM r WHERE split = 'train' AND o_custkey NOT IN (SELECT o_custkey FROM v) AND o_custkey NOT IN (SELECT o_custkey FROM t))
SELECT * FROM v UNION ALL SELECT * FROM t UNION ALL SELECT * FROM n"""
)
def heldout_overlap_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, D7."""
    return dedupe.overlap_cleaned(_rows(spark, sf_dir), "split", "o_custkey").select("o_orderkey", "o_custkey", "split")


@query(
    """
WITH a AS (SELECT l_orderkey AS q, l_linenumber AS ln, l_discount AS conf, l_returnflag AS label, l_linestatus AS pool, l_shipdate FROM lineitem), q AS (SELECT o_orderkey, o_orderstatus, o_custkey, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'valid' ELSE 'odd' END AS split FROM orders WHERE o_orderkey % 17 <> 0),
v AS (SELECT 'invalid_split' AS rule FROM q WHERE split NOT IN ('train', 'valid', 'test') UNION ALL SELECT 'confidence_range' FROM a WHERE NOT (conf BETWEEN 0.01 AND 0.09) UNION ALL SELECT 'gold_not_experimental' FROM a WHERE pool = 'F' AND label = 'R'
 UNION ALL SELECT 'unknown_query' FROM a WHERE q NOT IN (SELECT o_orderkey FROM q) UNION ALL SELECT 'duplicate_answer' FROM (SELECT q || '|' || (ln % 3) FROM a GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'too_few_answers' FROM (SELECT o_orderkey FROM q LEFT JOIN a ON a.q = o_orderkey GROUP BY 1 HAVING count(a.q) < 2) UNION ALL SELECT 'input_leak' FROM (SELECT o_custkey FROM q GROUP BY 1 HAVING count(DISTINCT split) > 1))
SELECT rule, count(*)::BIGINT AS n FROM v GROUP BY rule"""
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of rows, keys, cardinality and leakage. Answers and queries are dealt out by query once, to more tasks the more rows there are."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") % 3).alias("third"), F.col("l_discount").alias("conf"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("pool"))
    k = F.col("o_orderkey") % 10
    q = o.filter("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("q"), "o_custkey", F.when(k < 8, "train").when(k == 8, "valid").otherwise("odd").alias("split"))
    n = split.tasks(li)
    a, keys = rows.select("q", "third").repartition(n, "q"), q.select("q").repartition(n, "q")
    counts = keys.join(a.groupBy("q").agg(F.count("*").alias("n")), "q", "left")
    return audit.counted(
        [
            audit.violations(q, "q", [("invalid_split", ~F.col("split").isin("train", "valid", "test"))]),
            audit.violations(rows, "q", [("confidence_range", ~F.col("conf").between(0.01, 0.09)), ("gold_not_experimental", (F.col("pool") == "F") & (F.col("label") == "R"))]),
            audit.orphans(a, keys, "q", "q", "unknown_query"),
            audit.duplicates(a, ["q", "third"], "duplicate_answer"),
            audit.violations(counts, "q", [("too_few_answers", F.coalesce("n", F.lit(0)) < 2)]),
            audit.leaks(q.select("o_custkey", "split").repartition(n, "o_custkey"), "o_custkey", "split", "input_leak"),
        ]
    )


@query(
    """
SELECT l_returnflag, count(*)::BIGINT AS n, count_if(l_quantity = 3)::BIGINT AS exactly_three, count_if(l_discount = 0)::BIGINT AS no_delta, count_if(l_partkey = l_suppkey)::BIGINT AS collisions,
 median(l_tax) AS median_similarity, round(avg(CASE WHEN l_discount > l_tax THEN 1.0 ELSE 0.0 END), 9) AS hard_rate FROM lineitem GROUP BY l_returnflag"""
)
def triplet_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V4: shape, signs, identity collisions, medians and rates."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") == 3).alias("exactly_three"), F.count_if(F.col("l_discount") == 0).alias("no_delta"), F.count_if(F.col("l_partkey") == F.col("l_suppkey")).alias("collisions"),
        F.median("l_tax").alias("median_similarity"), F.round(F.avg((F.col("l_discount") > F.col("l_tax")).cast("double")), 9).alias("hard_rate"),
    )


@query(
    """
WITH s AS (SELECT source, count(*) AS n, sum(length(text)) AS chars, max(length(text)) AS longest FROM documents GROUP BY source)
SELECT source, n::BIGINT AS n, round(chars / n, 6) AS mean_length, longest::BIGINT AS longest, n > 0.2 * (SELECT sum(n) FROM s) AS dominant FROM s"""
)
def sft_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V6: counts and lengths per source, and sources that dominate."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))
    total = s.agg(F.sum("n").alias("total"))
    return s.crossJoin(F.broadcast(total)).select("source", "n", F.round(F.col("chars") / F.col("n"), 6).alias("mean_length"), "longest", (F.col("n") > 0.2 * F.col("total")).alias("dominant"))
