"""Queries on joins: star, semi, anti, outer, pairing in groups, partners and hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.structures import BitsProvider, top_fragments
from ..operators import features, pairs, rank
from .catalog import query, table


@query(
    """
SELECT n_name, o_orderstatus, count(*)::BIGINT AS n, count(s_suppkey)::BIGINT AS with_supplier, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
WHERE l_quantity IS NOT NULL AND l_returnflag IN ('N', 'R') AND (lower(c_mktsegment) LIKE '%build%' OR lower(c_mktsegment) LIKE '%auto%') AND l_linenumber NOT IN (6, 7) GROUP BY ALL"""
)
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with four dimensions, one of them outer; dimensions broadcast where Spark finds them small."""
    li = table(spark, sf_dir, "lineitem").filter("l_quantity is not null and l_returnflag in ('N', 'R') and l_linenumber not in (6, 7)")
    c = table(spark, sf_dir, "customer").filter(F.expr("lower(c_mktsegment) like any ('%build%', '%auto%')"))
    x = li.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    x = x.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    x = x.join(table(spark, sf_dir, "supplier").filter("s_acctbal > 0"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return x.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.count("s_suppkey").alias("with_supplier"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def semi_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query(
    """
WITH g AS (SELECT l_suppkey, l_returnflag FROM lineitem GROUP BY ALL HAVING count(*) >= 150)
SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem JOIN g USING (l_suppkey, l_returnflag) WHERE l_linestatus = 'O'"""
)
def eligible_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups counted before the row filter, kept by a semi join."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).filter("n >= 150")
    return li.filter("l_linestatus = 'O'").join(g, ["l_suppkey", "l_returnflag"], "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")


@query(
    """
WITH q AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), p AS (SELECT doc_id FROM labels UNION SELECT 1000000 + doc_id FROM labels WHERE doc_id % 7 = 0)
SELECT CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN q.doc_id IS NULL THEN 'extra' ELSE 'matched' END AS state, count(*)::BIGINT AS n, min(coalesce(q.doc_id, p.doc_id)) AS first_id FROM q FULL JOIN p ON p.doc_id = q.doc_id GROUP BY state"""
)
def prediction_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without predictions, predictions without queries."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("p"))
    p = labels.unionByName(labels.filter("p % 7 = 0").select((F.col("p") + 1000000).alias("p"))).distinct()
    q = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("q"))
    x = q.join(p, F.col("q") == F.col("p"), "full_outer").withColumn("state", F.when(F.col("p").isNull(), "missing").when(F.col("q").isNull(), "extra").otherwise("matched"))
    return x.groupBy("state").agg(F.count("*").alias("n"), F.min(F.coalesce("q", "p")).alias("first_id"))


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 THEN c_name ELSE 'given' END AS name, CASE WHEN o_orderkey % 4 = 0 THEN c_mktsegment ELSE o_orderpriority END AS tag, c_acctbal AS balance
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0"""
)
def metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups where a value is missing or empty."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("name", F.when(k % 3 == 1, "").when(k % 3 == 2, "given")).withColumn("tag", F.when(k % 4 != 0, F.col("o_orderpriority")))
    x = o.join(table(spark, sf_dir, "customer").filter("c_acctbal >= 0"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("o_orderkey", F.coalesce(F.nullif("name", F.lit("")), "c_name").alias("name"), F.coalesce(F.nullif("tag", F.lit("")), "c_mktsegment").alias("tag"), F.col("c_acctbal").alias("balance"))


@query("SELECT l_orderkey, l_linenumber, p_partkey, upper(p_name) AS canon FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25")
def distinct_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expensive function on distinct keys, joined back."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    memo = table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey", F.upper("p_name").alias("canon"))
    return li.join(memo, "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey", "canon")


# Molecules of the event table: median p per (user, type), with the embedding of the same number.
_MOLECULES = """
fp AS (SELECT vec_id, label, list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i - 1 END), lambda x: x IS NOT NULL) AS f FROM embeddings),
m AS (SELECT event_type AS t, user_id AS u, median(9.0 - log10(value)) AS p, any_value(label) AS g, any_value(f) AS f FROM events JOIN fp ON vec_id = user_id WHERE value > 0 GROUP BY event_type, user_id)"""
_TANIMOTO = "(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value > 0").groupBy(F.col("event_type").alias("t"), F.col("user_id").alias("u")).agg(F.median(S.p_from_nm(F.col("value"))).alias("p"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("u"), F.col("label").alias("g"), BitsProvider.fingerprint(F.col("embedding")).alias("f"))
    return e.join(v, "u")


def fingerprint_bits(spark: SparkSession, sf_dir: str) -> int:
    """Bits of the longest fingerprint, read before the plan is made."""
    return table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0


@query(
    """
WITH m AS (SELECT event_type, user_id, median(9.0 - log10(value)) AS p FROM events WHERE value > 0 GROUP BY ALL),
c AS (SELECT a.event_type, a.user_id, b.user_id AS partner, round(b.p - a.p, 6) AS gain, row_number() OVER (PARTITION BY a.event_type, a.user_id ORDER BY b.p DESC, b.user_id) AS k FROM m a JOIN m b ON a.event_type = b.event_type AND a.user_id <> b.user_id AND b.p >= a.p + 0.05)
SELECT event_type, user_id, partner, gain FROM c WHERE k = 1"""
)
def stronger_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16 without similarity: the flagship."""
    m = table(spark, sf_dir, "events").filter("value > 0").groupBy("event_type", "user_id").agg(F.median(S.p_from_nm(F.col("value"))).alias("p"))
    best = pairs.strongest_partner(m, ["event_type"], "user_id", "p", gain=0.05)
    return best.select("event_type", F.col("a_user_id").alias("user_id"), F.col("b_user_id").alias("partner"), F.round(F.col("b_p") - F.col("a_p"), 6).alias("gain"))


@query(
    f"""
WITH {_MOLECULES}
SELECT a.t, a.u AS a, b.u AS b, round({_TANIMOTO.format(a='a.f', b='b.f')}, 9) AS similarity, round(b.p - a.p, 6) AS delta
FROM m a JOIN m b ON a.t = b.t AND a.g = b.g AND a.u <> b.u WHERE b.p - a.p >= 0.1 AND {_TANIMOTO.format(a='a.f', b='b.f')} >= 0.3"""
)
def scaffold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improving pairs of one group and scaffold that are similar enough."""
    m, words, similar = pairs.packed(molecules(spark, sf_dir), "f", fingerprint_bits(spark, sf_dir))
    x = pairs.group_pairs(m, ["t", "g"], "u", ["p", *words]).filter(F.col("b_p") - F.col("a_p") >= 0.1)
    x = x.withColumn("similarity", similar("a", "b")).filter("similarity >= 0.3")
    return x.select("t", F.col("a_u").alias("a"), F.col("b_u").alias("b"), S.rounded(F.col("similarity"), 9).alias("similarity"), S.rounded(F.col("b_p") - F.col("a_p"), 6).alias("delta"))


@query(
    f"""
WITH {_MOLECULES},
pc AS (SELECT a.t, a.g, a.u AS i, b.u AS pos, a.p AS ip, b.p AS pp, a.f AS fi, b.f AS fb, row_number() OVER (PARTITION BY a.t, a.g, a.u ORDER BY b.p DESC, b.u) AS r FROM m a JOIN m b ON a.t = b.t AND a.g = b.g AND a.u <> b.u AND b.p >= a.p + 0.15),
pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, g, i ORDER BY r) AS k FROM pc WHERE r <= 250 AND {_TANIMOTO.format(a='fi', b='fb')} >= 0.35) WHERE k = 1),
nc AS (SELECT pb.t, pb.g, i, pos, ip, pp, n.u AS neg, n.p AS np, fi, fb, n.f AS fn, row_number() OVER (PARTITION BY pb.t, pb.g, i ORDER BY n.p, n.u) AS r FROM pb JOIN m n ON n.t = pb.t AND n.g = pb.g AND n.u <> i AND n.u <> pos AND n.p <= ip - 0.05),
nb AS (SELECT *, row_number() OVER (PARTITION BY t, g, i ORDER BY r) AS k FROM nc WHERE r <= 250 AND {_TANIMOTO.format(a='fi', b='fn')} >= 0.35 AND {_TANIMOTO.format(a='fb', b='fn')} >= 0.3)
SELECT t, i AS input, pos AS positive, neg AS negative, round(pp - ip, 6) AS gain, round(ip - np, 6) AS loss FROM nb WHERE k = 1"""
)
def hard_negative_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, J17."""
    m, bits = molecules(spark, sf_dir), fingerprint_bits(spark, sf_dir)
    best = pairs.strongest_partner(m, ["t", "g"], "u", "p", "f", gain=0.15, similarity=0.35, bits=bits)
    x = pairs.hard_negative(best, m, ["t", "g"], "u", "p", "f", loss=0.05, bits=bits)
    return x.select("t", F.col("a_u").alias("input"), F.col("b_u").alias("positive"), F.col("n_id").alias("negative"), F.round(F.col("b_p") - F.col("a_p"), 6).alias("gain"), F.round(F.col("a_p") - F.col("n_value"), 6).alias("loss"))


@query(
    """
WITH task AS (SELECT * FROM (VALUES ('cheaper', -1.0, 40), ('smaller', -10.0, 10)) v(task, most, band)),
x AS (SELECT task, a.p_partkey AS a, b.p_partkey AS b, round(b.p_retailprice - a.p_retailprice, 6) AS delta, row_number() OVER (PARTITION BY task, a.p_partkey ORDER BY abs(b.p_retailprice - a.p_retailprice) DESC, b.p_partkey) AS k
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey CROSS JOIN task WHERE b.p_retailprice - a.p_retailprice <= most AND abs(b.p_size - a.p_size) <= band)
SELECT task, a, b, delta FROM x WHERE k <= 3"""
)
def proxy_task_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one scaffold for every task of a small task table, best three by |delta|."""
    task = spark.createDataFrame([("cheaper", -1.0, 40), ("smaller", -10.0, 10)], "task string, most double, band int")
    x = pairs.extreme_partners(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey", "p_retailprice", "p_size", task, 3)
    return x.select("task", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("delta", 6).alias("delta"))


# Fragments of a part: the words of its name and type; the core is its type.
_PARTS = "p AS (SELECT p_partkey AS id, p_size AS atoms, p_retailprice AS v, p_type AS core, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS f FROM part)"


@query(
    f"""
WITH {_PARTS} SELECT a.id AS a, b.id AS b, a.core, round(b.v - a.v, 6) AS delta FROM p a JOIN p b ON a.core = b.core AND a.id <> b.id WHERE a.atoms BETWEEN 5 AND 20 AND b.atoms BETWEEN 5 AND 20 AND abs(a.atoms - b.atoms) <= 2 AND b.v - a.v >= 1"""
)
def mmp_core_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one core whose sizes differ little."""
    p = table(spark, sf_dir, "part").filter("p_size between 5 and 20").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("atoms"), F.col("p_retailprice").alias("v"), F.col("p_type").alias("core"))
    x = pairs.band_pairs(p, ["core"], "id", ["v"], {"atoms": 2.0}).filter(pairs.improved(F.col("a_v"), F.col("b_v"), least=1))
    return x.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "core", S.rounded(F.col("b_v") - F.col("a_v"), 6).alias("delta"))


@query(
    f"""
WITH {_PARTS}, t AS (SELECT id, f, list_sort(list_transform(f, lambda x: (-length(x), x)))[1:2] AS top FROM p),
e AS (SELECT id, unnest(list_transform(top, lambda x: x[2])) AS x FROM t),
k AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT a, b, n::BIGINT AS shared, round(len(list_intersect(x.f, y.f)) / (len(x.f) + len(y.f) - len(list_intersect(x.f, y.f))), 9) AS similarity FROM k JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE n >= 2"""
)
def fragment_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by their largest fragments, similarity on all of them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("f"))
    # the two largest: longer first, ties in ascending text order
    top = F.transform(F.slice(F.array_sort(F.transform("f", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), 1, 2), lambda s: s["x"])
    x = pairs.overlap_pairs(p.withColumn("top", top), [], "id", "top", 2, ["f"], ("f", lambda a, b: F.round(S.jaccard(a, b), 9)))
    return x.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("n_parts").alias("shared"), "similarity")


@query(
    f"""
WITH {_PARTS}, e AS (SELECT id, len(f) AS n, unnest(f) AS x FROM (SELECT p_partkey AS id, list_distinct(string_split(p_name || ' ' || p_brand || ' ' || p_container_, ' ')) AS f FROM (SELECT *, 'size' || (p_size // 5) AS p_container_ FROM part))),
k AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS s FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, round(s, 9) AS similarity FROM k WHERE s >= 0.6"""
)
def fragment_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the similarity of all their fragments."""
    f = F.split(F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("size"), F.expr("p_size div 5").cast("string"))), " ")
    x = pairs.similar_pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), f.alias("f")), "id", "f", 0.6, 9)
    return x.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "similarity")


@query(
    """
WITH m AS (SELECT user_id AS u, event_type AS e, median(value) AS v FROM events GROUP BY ALL),
pr AS (SELECT a.u AS a, b.u AS b, a.e AS primary_ FROM m a JOIN m b ON a.e = b.e AND a.u < b.u),
s AS (SELECT pr.a, pr.b, primary_, x.e, abs(y.v - x.v) / greatest(0.3, abs(x.v) * 0.25) AS ratio FROM pr JOIN m x ON x.u = pr.a JOIN m y ON y.u = pr.b AND y.e = x.e WHERE x.e <> primary_),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, primary_ ORDER BY ratio, e) AS k FROM s WHERE ratio <= 1)
SELECT a, b, primary_ AS "primary", e AS endpoint, round(ratio, 9) AS ratio, k AS rank FROM r WHERE k <= 2"""
)
def preserved_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared other endpoints within tolerance, the two that change least. The rows grow with the square of
    the users, as the pairs do."""
    profile = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.median("value").alias("median_value"))
    out = pairs.preserved_pairs(profile, "user_id", "event_type", S.tolerance, 2, values=False)
    return out.select("a", "b", "primary", "endpoint", S.rounded(F.col("ratio"), 9).alias("ratio"), F.col("rank").cast("long").alias("rank"))


@query(
    """
WITH d AS (SELECT p_partkey AS id, p_brand AS g, p_retailprice AS mw, p_size / 10.0 AS logp, (p_partkey % 100) / 100.0 AS qed, (p_partkey % 7) AS sa FROM part),
x AS (SELECT a.id AS a, b.id AS b, abs(b.mw - a.mw) <= 100 AS c1, abs(b.logp - a.logp) <= 2 AS c2, a.qed - b.qed <= 0.1 AS c3, b.sa - a.sa <= 1 AS c4 FROM d a JOIN d b ON a.g = b.g AND a.id <> b.id)
SELECT count(*)::BIGINT AS n, count_if(c1)::BIGINT AS mw, count_if(c2)::BIGINT AS logp, count_if(c3)::BIGINT AS qed, count_if(c4)::BIGINT AS sa, count_if(c1 AND c2 AND c3 AND c4)::BIGINT AS success FROM x"""
)
def descriptor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a brand satisfy each check, and all of them: by counts of values, without the pairs."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("mw"), (F.col("p_size") / 10).alias("logp"), ((k % 100) / 100).alias("qed"), (k % 7).alias("sa"))
    one = lambda x, name: x.agg(F.coalesce(F.sum("held"), F.lit(0)).alias(name))
    checks = {"logp": lambda a, b: (b - a <= 2) & (a - b <= 2), "qed": lambda a, b: a - b <= 0.1, "sa": lambda a, b: b - a <= 1}
    logp, qed, sa = (one(pairs.value_pairs(d, ["p_brand"], name, holds), name) for name, holds in checks.items())
    every = one(d.groupBy("p_brand").agg((F.count("*") * (F.count("*") - 1)).alias("held")), "n")
    window = pairs.window_counts(d, ["p_brand"], ("mw", 100.0), checks).withColumnsRenamed({"near": "mw", "held": "success"})
    out = every
    for part in (window, logp, qed, sa):  # tables of one row
        out = out.crossJoin(F.broadcast(part))
    return out.select("n", "mw", "logp", "qed", "sa", "success")


@query(
    f"""
WITH {_MOLECULES},
x AS (SELECT a.t, a.g, a.u AS i, b.u AS o, b.p - a.p AS d, a.f AS fi, b.f AS fo FROM m a JOIN m b ON a.t = b.t AND a.g = b.g AND a.u <> b.u),
pos AS (SELECT * FROM x WHERE d >= 0.3), neg AS (SELECT * FROM x WHERE -d >= 0.15),
r AS (SELECT p.t, p.i, p.o AS positive, n.o AS negative, row_number() OVER (PARTITION BY p.t, p.g, p.i, p.o ORDER BY {_TANIMOTO.format(a='p.fo', b='n.fo')} DESC, n.d, n.o) AS k FROM pos p JOIN neg n ON n.t = p.t AND n.g = p.g AND n.i = p.i)
SELECT t, i AS input, positive, negative FROM r WHERE k = 1"""
)
def hard_negative_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative that is most similar to the positive; ties by margin."""
    y = pairs.most_similar_worse(molecules(spark, sf_dir), ["t", "g"], "u", "p", "f", gain=0.3, loss=0.15, bits=fingerprint_bits(spark, sf_dir))
    return y.select("t", F.col("a_id").alias("input"), F.col("b_id").alias("positive"), F.col("n_id").alias("negative"))


_SCOPED = """
f AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i END), lambda x: x IS NOT NULL) AS b FROM embeddings),
x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS e, l_linestatus AS k, l_suppkey AS i, p_brand || p_type AS core, l_partkey AS t, l_discount AS d, l_quantity AS q, f.b FROM lineitem JOIN part ON p_partkey = l_partkey JOIN f ON vec_id = l_partkey % 50),
pos AS (SELECT * FROM x WHERE q > 45), neg AS (SELECT * FROM x WHERE q < 3),
m AS (SELECT p.id AS positive_id, n.id AS negative_id, p.i = n.i AS near, p.d - n.d AS margin, len(list_intersect(p.b, n.b)) / (len(p.b) + len(n.b) - len(list_intersect(p.b, n.b))) AS s FROM pos p JOIN neg n ON p.e = n.e AND p.k = n.k AND p.core = n.core AND p.id <> n.id AND p.t <> n.t)"""


@query(
    f"""
WITH {_SCOPED}, ok AS (SELECT * FROM m WHERE s >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY positive_id ORDER BY near DESC, s DESC, margin DESC, negative_id) AS k FROM ok)
SELECT positive_id, negative_id, round(s, 9) AS similarity, CASE WHEN near THEN 'same_input' ELSE 'same_core' END AS scope FROM r WHERE k = 1"""
)
def scoped_hard_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18 with the core in its keys, and the fallback to the core alone."""
    f = table(spark, sf_dir, "embeddings").select("vec_id", BitsProvider.fingerprint(F.col("embedding")).alias("b"))
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(f, F.col("vec_id") == F.col("l_partkey") % 50)
    x = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("e"), F.col("l_linestatus").alias("k"), F.col("l_suppkey").alias("i"), F.concat("p_brand", "p_type").alias("core"), F.col("l_partkey").alias("t"), F.col("l_discount").alias("d"), "l_quantity", "b")
    y = pairs.scoped_hard_negative(x.filter("l_quantity > 45"), x.filter("l_quantity < 3"), ["e", "k", "i", "core"], ["e", "k", "core"], "id", "t", "d", "b", 0.3)
    return y.select("positive_id", "negative_id", F.round("similarity", 9).alias("similarity"), "scope")


@query(
    """
WITH pos AS (SELECT DISTINCT event_type || user_id % 30 AS e, user_id AS q, user_id % 40 AS item FROM events WHERE value > 100), uni AS (SELECT DISTINCT event_type || user_id % 30 AS e, user_id % 40 AS item FROM events),
allx AS (SELECT DISTINCT item FROM uni), ring AS (SELECT e, item, row_number() OVER (PARTITION BY e ORDER BY sha1('7|' || item), item) - 1 AS at, count(*) OVER (PARTITION BY e) AS n FROM uni),
whole AS (SELECT item, row_number() OVER (ORDER BY sha1('7|' || item), item) - 1 AS at, count(*) OVER () AS n FROM allx),
q AS (SELECT DISTINCT e, q, ('0x' || substr(sha1('7|' || q), 1, 8))::BIGINT AS h FROM pos),
near AS (SELECT q.e, q.q, r.item, (r.at - h % r.n + r.n) % r.n AS turn, 0 AS tier FROM q JOIN ring r USING (e)), far AS (SELECT q.e, q.q, w.item, (w.at - h % w.n + w.n) % w.n AS turn, 1 AS tier FROM q CROSS JOIN whole w WHERE (q.e, w.item) NOT IN (SELECT e, item FROM uni)),
free AS (SELECT * FROM (SELECT * FROM near UNION ALL SELECT * FROM far) WHERE (e, q, item) NOT IN (SELECT e, q, item FROM pos)), k AS (SELECT *, row_number() OVER (PARTITION BY e, q ORDER BY tier, turn) AS k FROM free)
SELECT e, q, item, tier FROM k WHERE k <= 3"""
)
def ring_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22 with the fallback to all items, from rings of hashed items."""
    e = table(spark, sf_dir, "events").select(F.concat("event_type", (F.col("user_id") % 30).cast("string")).alias("e"), F.col("user_id").alias("q"), (F.col("user_id") % 40).alias("item"), "value")
    return features.ring_decoys(e.filter("value > 100").select("e", "q", "item"), e.select("e", "item"), "e", "q", "item", 3, "7")


@query(
    """
WITH pos AS (SELECT DISTINCT event_type AS e, user_id AS q, user_id % 40 AS item FROM events WHERE value > 100), uni AS (SELECT DISTINCT event_type AS e, user_id % 40 AS item FROM events),
w AS (SELECT DISTINCT p.e, p.q, u.item FROM (SELECT DISTINCT e, q FROM pos) p JOIN uni u ON u.e = p.e),
r AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY sha1('7|' || q || '|' || item)) AS k FROM (SELECT DISTINCT q, item FROM w) WHERE (q, item) NOT IN (SELECT q, item FROM pos))
SELECT q, item FROM r WHERE k <= 3"""
)
def decoy_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22, W11."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("e"), F.col("user_id").alias("q"), (F.col("user_id") % 40).alias("item"), "value")
    pos = e.filter("value > 100").select("e", "q", "item").distinct()
    return features.decoys(pos, e.select("e", "item"), "e", "q", "item", 3, "7").select("q", "item")


@query(
    """
WITH w AS (SELECT o_orderkey AS q, o_orderpriority AS t, o_orderstatus AS m FROM orders WHERE o_orderkey % 50 = 0), pool AS (SELECT o_orderkey AS x, o_orderpriority AS t, o_orderstatus AS m FROM orders),
near AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY t, m ORDER BY sha1('s|' || x)) <= 3),
c AS (SELECT q, x, CASE WHEN w.t = near.t AND w.m = near.m THEN 0 WHEN w.m = near.m THEN 1 ELSE 2 END AS tier FROM w CROSS JOIN near WHERE q <> x),
r AS (SELECT q, x, tier, row_number() OVER (PARTITION BY q ORDER BY tier, sha1('s|' || x)) AS k FROM c)
SELECT q, x, tier FROM r WHERE k <= 2"""
)
def few_shot_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J23, W12; in the SQL three orders of each kind are as good as all: two are picked, and one may be the query."""
    return few_shots(spark, sf_dir)


def few_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("t"), F.col("o_orderstatus").alias("m"))
    pool = li.withColumnRenamed("q", "x")
    return features.few_shot(li.filter("q % 50 = 0"), pool, ["t", "m"], ["m"], "q", "x", 2, "s").select("q", "x", "tier")


@query(
    """
SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split(p_name || ' ' || p_type, ' ')), lambda x: (length(x), x)), 'DESC')[1:3], lambda x: x[2]), '|') AS fragments FROM part"""
)
def largest_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F44."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(top_fragments(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), 3), "|").alias("fragments"))
