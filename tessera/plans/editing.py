"""Queries on edited pairs and triplets, candidate features and rankers, structure rules and dataset audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import structures
from ..operators import audit, features, metrics, objectives, rank
from .catalog import query, table

# Orders are pairs; their objectives are kinds of lines whose discount stays near the tax.
_TRIPLETS = """
ok AS (SELECT k, e, d FROM (SELECT l_orderkey AS k, l_returnflag || l_linestatus AS e, round(max(l_discount) - min(l_tax), 6) AS d FROM lineitem GROUP BY ALL) WHERE abs(d) <= 0.05),
pr AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT k FROM ok) AND o_orderkey % 4 <> 0 AND ((o_orderstatus = 'O' AND o_totalprice > 100000) OR (o_orderstatus = 'F' AND o_totalprice <= 100000))),
t AS (SELECT o_orderkey AS p, n FROM orders JOIN (SELECT o_custkey, min(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_custkey) WHERE o_orderstatus = 'O'),
s AS (SELECT p, a.e, a.d AS pd, b.d AS nd, row_number() OVER (PARTITION BY p ORDER BY a.e) AS i FROM t JOIN ok a ON a.k = p JOIN ok b ON b.k = n AND b.e = a.e WHERE p IN (SELECT k FROM pr) AND n IN (SELECT k FROM pr)),
g AS (SELECT p, string_agg(e, ',' ORDER BY i) AS endpoints, min(CASE WHEN i = 1 THEN pd END) AS pd, min(CASE WHEN i = 1 THEN nd END) AS nd FROM s WHERE i <= 2 GROUP BY p)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("endpoint_name")).agg(F.round(F.max("l_discount") - F.min("l_tax"), 6).alias("delta"))
    found = li.filter(F.abs("delta") <= 0.05).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("endpoint_name", "delta", F.lit(0.05).alias("tolerance")))).alias("objectives"))
    o = table(spark, sf_dir, "orders").withColumn("kind", F.when(F.col("o_orderstatus") == "O", "positive").when(F.col("o_orderstatus") == "F", "negative"))
    x = o.join(found, F.col("o_orderkey") == F.col("l_orderkey"))
    return x.filter(objectives.pair_kept(F.col("kind"), F.col("o_totalprice") > 100000, F.col("o_orderkey") % 4 != 0, F.size("objectives"))).select(F.col("o_orderkey").alias("sample_id"), "objectives")


@query(
    f"""
WITH {_TRIPLETS} SELECT t.p AS positive_id, t.n AS negative_id, CASE WHEN t.p NOT IN (SELECT k FROM pr) OR t.n NOT IN (SELECT k FROM pr) THEN 'missing_filtered_pair' WHEN g.p IS NULL THEN 'no_shared_preserved_secondary' ELSE 'kept' END AS outcome,
 endpoints, pd AS positive_delta, nd AS negative_delta FROM t LEFT JOIN g ON g.p = t.p"""
)
def triplet_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives that a positive and its negative both preserve, and why other triplets go."""
    o = table(spark, sf_dir, "orders")
    negatives = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("negative_id"))
    t = o.filter("o_orderstatus = 'O'").join(negatives, "o_custkey").select(F.col("o_orderkey").alias("positive_id"), "negative_id")
    x = objectives.triplet_objectives(t, _pairs(spark, sf_dir))
    first = F.get(F.when(F.col("outcome") == "kept", F.col("objectives")), 0)
    names = F.when(F.col("outcome") == "kept", F.array_join(F.transform("objectives", lambda s: s["endpoint_name"]), ","))
    return x.select("positive_id", "negative_id", "outcome", names.alias("endpoints"), first["positive_delta"].alias("positive_delta"), first["negative_delta"].alias("negative_delta"))


@query(f"WITH {_TRIPLETS} SELECT format('sft_train_{{:08d}}', row_number() OVER (ORDER BY o_orderkey)) AS example_id, o_orderkey AS sample_id FROM orders JOIN pr ON k = o_orderkey WHERE o_orderstatus = 'O'")
def sft_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives only, renumbered."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("sample_id"))
    return rank.numbered(o.join(_pairs(spark, sf_dir), "sample_id").select("sample_id"), ["sample_id"], "example_id", "sft_train_%08d").select("example_id", "sample_id")


@query(
    """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber) AS n FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY n DESC, l_linenumber, l_extendedprice, l_orderkey, l_partkey) AS k FROM c WHERE n >= 3 AND l_quantity > 10)
SELECT l_suppkey, l_returnflag, l_linenumber, l_orderkey, l_partkey, k AS place FROM r WHERE k <= 5"""
)
def capped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five emitted rows of every target and metric, from its largest groups first."""
    x = rank.capped_groups(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_linenumber"], [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_partkey")], F.col("l_quantity") > 10, 5)
    return x.select("l_suppkey", "l_returnflag", "l_linenumber", "l_orderkey", "l_partkey", F.col("rank").cast("long").alias("place"))


@query(
    """
WITH q AS (SELECT o_orderkey AS q FROM orders WHERE o_orderkey % 11 <> 0),
rk AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS pos, CASE WHEN l_quantity > 2 THEN l_partkey END AS item FROM lineitem WHERE l_orderkey % 5 <> 0),
tp AS (SELECT * FROM rk WHERE pos <= 3 AND q IN (SELECT q FROM q)),
an AS (SELECT l_orderkey AS q, l_partkey AS item, l_discount * 10 AS conf, l_linestatus = 'O' AS ok, l_returnflag = 'N' AS ex, l_tax > 0.03 AS sc, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS z FROM lineitem WHERE l_returnflag <> 'A'),
h AS (SELECT tp.*, CASE WHEN ok THEN conf ELSE 0 END AS gain, coalesce(ex, false) AS ex, coalesce(sc, false) AS sc FROM tp LEFT JOIN an ON an.q = tp.q AND an.item = tp.item AND z = 1),
pq AS (SELECT q, max((gain > 0)::INT) AS success, max(ex::INT) AS fidelity, max(sc::INT) AS scaffold, count(DISTINCT item) / count(*) AS diversity, 1.0 / min(CASE WHEN gain > 0 THEN pos END) AS mrr, sum(gain / log2(pos + 1)) AS dcg, count(*) AS n, count(item) AS valid FROM h GROUP BY q),
i AS (SELECT q, sum(conf / log2(pos + 1)) AS ideal FROM (SELECT q, conf, row_number() OVER (PARTITION BY q ORDER BY conf DESC) AS pos FROM an) WHERE pos <= 3 GROUP BY q),
x AS (SELECT q.q, pq.*, CASE WHEN ideal > 0 THEN dcg / ideal END AS ndcg FROM q LEFT JOIN pq ON pq.q = q.q LEFT JOIN i ON i.q = q.q)
SELECT count(*)::BIGINT AS n_queries, count_if(n IS NULL)::BIGINT AS missing, (SELECT count(DISTINCT q) FROM rk WHERE q NOT IN (SELECT q FROM q))::BIGINT AS extra, round(sum(valid) / sum(n), 9) AS validity, round((SELECT count(DISTINCT item) / count(item) FROM tp), 9) AS uniqueness,
 round(avg(coalesce(success, 0)), 9) AS success, round(avg(coalesce(fidelity, 0)), 9) AS fidelity, round(avg(coalesce(scaffold, 0)), 9) AS scaffold, round(avg(coalesce(diversity, 0)), 9) AS diversity, round(avg(coalesce(mrr, 0)), 9) AS mrr, round(avg(coalesce(ndcg, 0)), 9) AS ndcg FROM x"""
)
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E3 over all queries: validity, uniqueness, success, fidelity, scaffold retention, diversity, rank metrics."""
    li = table(spark, sf_dir, "lineitem")
    q = table(spark, sf_dir, "orders").filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("query_id"))
    ranked = rank.top_k(li.filter("l_orderkey % 5 <> 0"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")], 1000, "pos")
    ranked = ranked.select(F.col("l_orderkey").alias("query_id"), "pos", F.when(F.col("l_quantity") > 2, F.col("l_partkey")).alias("item"))
    answers = li.filter("l_returnflag <> 'A'").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item"), F.struct("l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"), (F.col("l_discount") * 10).alias("confidence"),
        (F.col("l_linestatus") == "O").alias("success"), (F.col("l_returnflag") == "N").alias("experimental"), (F.col("l_tax") > 0.03).alias("scaffold_retained"),
    )
    m = metrics.prediction_summary(q, ranked, answers, 3)
    return m.select("n_queries", "missing", "extra", *(F.round(c, 9).alias(c) for c in ("validity", "uniqueness", "success", "fidelity", "scaffold", "diversity", "mrr", "ndcg")))


# The rates of one order, pair by pair instead of by arrays.
_J = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
_EDITS = f"""
pt AS (SELECT p_partkey AS k, p_name AS c, list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS f, p_retailprice / 5 AS mw, p_size / 10 AS logp, (p_partkey % 100) / 100 AS qed FROM part),
od AS (SELECT o_orderkey AS q, o_orderpriority AS source, o_orderstatus AS task, c AS ic, f AS fi, mw AS im, logp AS il, qed AS iq FROM orders LEFT JOIN pt ON k = o_custkey),
pd AS (SELECT * FROM (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, CASE WHEN l_quantity > 5 THEN c END AS c, f, mw, logp, qed FROM lineitem JOIN pt ON k = l_partkey WHERE l_returnflag <> 'N') WHERE pos <= 3),
gd AS (SELECT l_orderkey AS q, l_partkey, any_value(c) AS c, any_value(f) AS f, max(l_discount) AS delta FROM lineitem JOIN pt ON k = l_partkey WHERE l_returnflag = 'N' GROUP BY ALL),
gn AS (SELECT q, count(*) AS n_gold, avg(delta) AS gold_delta, avg(CASE WHEN EXISTS (SELECT 1 FROM pd WHERE pd.q = gd.q AND pd.c = gd.c) THEN delta END) AS matched_delta FROM gd GROUP BY q),
sm AS (SELECT pd.q, gd.l_partkey, {_J.format(a="pd.f", b="gd.f")} AS s FROM pd JOIN gd ON gd.q = pd.q WHERE pd.c IS NOT NULL),
bs AS (SELECT q, max(s) AS best_similarity FROM sm GROUP BY q), gc AS (SELECT q, avg(s) AS gold_coverage FROM (SELECT q, l_partkey, max(s) AS s FROM sm GROUP BY ALL) GROUP BY q),
mt AS (SELECT pd.q, count(DISTINCT pd.c) AS m FROM pd JOIN gd ON gd.q = pd.q AND gd.c = pd.c GROUP BY pd.q),
pn AS (SELECT od.q, count(pos) AS n, count(c) AS v, count(DISTINCT c) AS d, arg_min(c, pos) FILTER (c IS NOT NULL) AS first, count(*) FILTER (c = ic) AS u, max(CASE WHEN c IS NOT NULL AND ic IS NOT NULL THEN {_J.format(a="f", b="fi")} END) AS best_input_similarity,
 avg(CASE WHEN c IS NOT NULL AND ic IS NOT NULL THEN {_J.format(a="f", b="fi")} END) AS mean_input_similarity, avg(CASE WHEN c IS NOT NULL THEN (abs(mw - im) <= 100)::INT END) AS mw_pass, avg(CASE WHEN c IS NOT NULL THEN (abs(logp - il) <= 2)::INT END) AS logp_pass,
 avg(CASE WHEN c IS NOT NULL THEN (qed - iq >= -0.1)::INT END) AS qed_pass, avg(CASE WHEN c IS NOT NULL THEN (abs(mw - im) <= 100 AND abs(logp - il) <= 2 AND qed - iq >= -0.1)::INT END) AS all_pass, avg(CASE WHEN c IS NOT NULL THEN abs(mw - im) END) AS abs_mw,
 avg(CASE WHEN c IS NOT NULL THEN abs(logp - il) END) AS abs_logp, avg(CASE WHEN c IS NOT NULL THEN qed - iq END) AS delta_qed FROM od LEFT JOIN pd ON pd.q = od.q GROUP BY od.q),
r AS (SELECT source, task, (n > 0)::INT AS with_prediction, (n >= 2)::INT AS two_or_more, (n = 2)::INT AS exactly_two, n AS n_predicted, v AS n_valid, v / greatest(n, 1) AS valid_rate, (d < v)::INT AS duplicate,
 (first IS NOT NULL AND first IN (SELECT c FROM gd WHERE gd.q = od.q))::INT AS hit_1, (coalesce(m, 0) > 0)::INT AS exact_any, coalesce(m, 0) / greatest(coalesce(n_gold, 0), 1) AS exact_recall, (coalesce(m, 0) = n_gold AND n_gold > 0) IS TRUE AS all_gold_, best_similarity, gold_coverage,
 u / greatest(v, 1) AS unchanged_rate, (u > 0)::INT AS with_unchanged, best_input_similarity, mean_input_similarity, mw_pass, logp_pass, qed_pass, all_pass, abs_mw, abs_logp, delta_qed, gold_delta, matched_delta, all_gold_::INT AS all_gold
 FROM od JOIN pn ON pn.q = od.q LEFT JOIN gn ON gn.q = od.q LEFT JOIN mt ON mt.q = od.q LEFT JOIN bs ON bs.q = od.q LEFT JOIN gc ON gc.q = od.q)"""
_AVG = ", ".join(f"avg({c}) AS {c}" for c in objectives.RATES)


@query(
    f"""
WITH {_EDITS}, p AS (SELECT 'all' AS "view", count(*) AS n, {_AVG} FROM r UNION ALL SELECT 'source:' || source, count(*), {_AVG} FROM r GROUP BY source UNION ALL SELECT 'task:' || task, count(*), {_AVG} FROM r GROUP BY task),
a AS (SELECT * FROM p UNION ALL SELECT 'macro:' || string_split("view", ':')[1], count(*), {_AVG} FROM p WHERE "view" <> 'all' GROUP BY 1)
SELECT "view", n::BIGINT AS n, {", ".join(f"round({c}, 6) AS {c}" for c in objectives.RATES)} FROM a"""
)
def edit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of predicted edits for all rows, by source and task, and over sources and tasks."""
    r = objectives.rate_summary(objectives.edit_rates(edits(spark, sf_dir)), ["source", "task"])
    return r.select("view", "n", *(F.round(c, 6).alias(c) for c in objectives.RATES))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " "))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("canon"), words.alias("bits"), (F.col("p_retailprice") / 5).alias("mw"), (F.col("p_size") / 10).alias("logp"), ((F.col("p_partkey") % 100) / 100).alias("qed"))
    part = part.hint("merge")  # its files are small, but its rows with their words aren't: not for a broadcast
    li = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    first = rank.top_k(li.filter("l_returnflag <> 'N'"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 3, "pos")
    shown = F.struct("pos", F.when(F.col("l_quantity") > 5, F.col("canon")).alias("canon"), "bits", "mw", "logp", "qed")
    predicted = first.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(shown)).alias("predicted"))
    answers = li.filter("l_returnflag = 'N'").groupBy("l_orderkey", "l_partkey", "canon", "bits").agg(F.max("l_discount").alias("delta"))
    gold = answers.groupBy("l_orderkey").agg(F.collect_list(F.struct("canon", "bits", "delta")).alias("gold"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("task"))
    given = part.select(F.col("p_partkey").alias("o_custkey"), F.struct("canon", "bits", "mw", "logp", "qed").alias("given"))
    given = given.hint("merge")
    return o.join(given, "o_custkey", "left").join(predicted, "l_orderkey", "left").join(gold, "l_orderkey", "left")


@query(
    r"""
WITH f AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i - 1 END), lambda x: x IS NOT NULL) AS b FROM embeddings),
e AS (SELECT event_id AS id, a.b AS a, c.b AS i, event_type AS t, event_type || ' of ' || event_id % 7 AS x, value AS v FROM events LEFT JOIN f a ON a.vec_id = event_id % 50 LEFT JOIN f c ON c.vec_id = user_id),
s AS (SELECT id, unnest(a) AS k, 1.0 AS v FROM e UNION ALL SELECT id, 256 + unnest(i), 1.0 FROM e
 UNION ALL SELECT id, 512 + unnest(list_filter(list_distinct(list_concat(coalesce(a, []), coalesce(i, []))), lambda x: (list_contains(coalesce(a, []), x))::INT + (list_contains(coalesce(i, []), x))::INT = 1)), 1.0 FROM e
 UNION ALL SELECT id, 768 + ('0x' || substr(sha1('tok:' || w), 1, 12))::BIGINT % 64, 1.0 FROM (SELECT id, unnest(regexp_extract_all(lower(x), '[a-z0-9_+\-.]+')[1:96]) AS w FROM e)
 UNION ALL SELECT id, 832 + ('0x' || substr(sha1('t:' || t), 1, 12))::BIGINT % 32, 1.0 FROM e WHERE t <> '' UNION ALL SELECT id, 864, v / 100 FROM e WHERE v <> 0)
SELECT id, k::BIGINT AS "column", round(sum(v), 9) AS value FROM s GROUP BY ALL"""
)
def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 in full: on-bits of candidate, input and either alone, tokens, categoricals and numbers."""
    x, numbers = _candidates(spark, sf_dir)
    return features.candidate_cells(x, "id", "a", "i", "x", ["t"], numbers, 256, 64, 32).select("id", "column", F.round("value", 9).alias("value"))


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    f = table(spark, sf_dir, "embeddings").select("vec_id", structures.BitsProvider.fingerprint(F.col("embedding")).alias("b"))
    side = lambda key, name: f.select(F.col("vec_id").alias(key), F.col("b").alias(name))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 50).alias("c"), F.col("event_type").alias("t"), F.concat("event_type", F.lit(" of "), F.col("event_id") % 7).alias("x"), "value")
    return e.join(side("c", "a"), "c", "left").join(side("user_id", "i"), "user_id", "left"), [F.col("value") / 100]


@query()
def logistic_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker of events by their features, learned from five in six of them, and the score of every event."""
    x, numbers = _candidates(spark, sf_dir)
    cells = features.candidate_cells(x, "id", "a", "i", "x", ["t"], numbers, 256, 64, 32)
    labels = x.filter("id % 6 <> 0").select("id", (F.col("value") > 50).cast("int").alias("label"))
    return features.ranker_scores(cells, "id", features.logistic_ranker(cells, labels, "id", 865, rounds=10)).select("id", F.round("score", 6).alias("score"))


@query(
    """
WITH a AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), d AS (SELECT DISTINCT l_orderkey AS q, (l_partkey + 7) % 200 AS item FROM lineitem)
SELECT q, item, max(label)::INTEGER AS label FROM (SELECT q, item, 1 AS label FROM a UNION ALL SELECT q, item, 0 FROM d WHERE q IN (SELECT q FROM a)) GROUP BY ALL"""
)
def candidate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and decoys as labelled rows."""
    li = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "q", "l_partkey": "item"})
    return features.candidate_examples(li.filter("l_returnflag = 'R'").select("q", "item"), li.select("q", ((F.col("item") + 7) % 200).alias("item")), "q", "item")


_SMILES = """s AS (SELECT p_partkey, repeat('C', p_size) || CASE WHEN p_partkey % 3 = 0 THEN '[N+](C)C' ELSE 'Cl' END || CASE WHEN p_partkey % 5 = 0 THEN '[O-]' WHEN p_partkey % 7 = 0 THEN '[Se]' WHEN p_partkey % 11 = 0 THEN '[13CH3+2]' ELSE 'c1ccccc1Br' END AS s,
 p_size + CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 1 END + CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 11 = 0 THEN 1 ELSE 7 END AS n, p_partkey % 5 <> 0 AND p_partkey % 7 = 0 AS odd,
 (p_partkey % 3 = 0)::INT + CASE WHEN p_partkey % 5 = 0 THEN -1 WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 11 = 0 THEN 2 ELSE 0 END AS charge FROM part)"""


@query(f"WITH {_SMILES} SELECT p_partkey, s AS smiles, n::INTEGER AS heavy_atoms, charge::INTEGER AS charge, n BETWEEN 10 AND 40 AND NOT odd AND abs(charge) <= 1 AS passes FROM s")
def structure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F49 by the notation: atoms, elements and charge of built structures."""
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, "[O-]").when(k % 7 == 0, "[Se]").when(k % 11 == 0, "[13CH3+2]").otherwise("c1ccccc1Br")
    s = table(spark, sf_dir, "part").select(k, F.concat(F.repeat(F.lit("C"), F.col("p_size")), F.when(k % 3 == 0, "[N+](C)C").otherwise("Cl"), tail).alias("smiles"))
    c = F.col("smiles")
    return s.select("p_partkey", "smiles", F.size(structures.heavy_atoms(c)).alias("heavy_atoms"), structures.formal_charge(c).alias("charge"), structures.passes_structure(c, 10, 40).alias("passes"))


@query(
    """
WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS w FROM part), c AS (SELECT p_partkey, w, unnest(range(1, len(w))) AS i FROM w),
h AS (SELECT p_partkey, (i, length(array_to_string(w[1:i], ' ')), array_to_string(w[1:i], ' ')) AS a, (len(w) - i, length(array_to_string(w[i + 1:], ' ')), array_to_string(w[i + 1:], ' ')) AS b FROM c)
SELECT DISTINCT p_partkey, greatest(a, b)[3] AS core, least(a, b)[3] AS variable, greatest(a, b)[1]::INTEGER AS core_size FROM h WHERE a[3] <> b[3]"""
)
def single_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F45 on chains of words."""
    w = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    x = table(spark, sf_dir, "part").select("p_partkey", F.explode(structures.single_cuts(w)).alias("c"))
    return x.select("p_partkey", "c.core", "c.variable", "c.core_size")


@query(
    """
WITH x AS (SELECT CASE o_orderkey % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, o_orderstatus AS s, o_orderpriority AS e, l_partkey::VARCHAR AS a, CASE WHEN l_quantity > 3 THEN l_suppkey::VARCHAR ELSE '' END AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT split, count(DISTINCT k) AS n FROM (SELECT split, a AS k FROM x UNION ALL SELECT split, b FROM x WHERE b <> '') GROUP BY split)
SELECT split, count(*)::BIGINT AS "rows", count_if(s = 'O')::BIGINT AS positive, count_if(s = 'F')::BIGINT AS negative, count(DISTINCT e)::BIGINT AS unique_endpoints, any_value(n)::BIGINT AS unique_molecules FROM x JOIN m USING (split) GROUP BY split"""
)
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6."""
    k = F.col("o_orderkey") % 10
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = x.withColumn("split", F.when(k == 8, "val").when(k == 9, "test").otherwise("train")).withColumn("kind", F.when(F.col("o_orderstatus") == "O", "positive").when(F.col("o_orderstatus") == "F", "negative"))
    return audit.split_statistics(x.withColumn("b", F.when(F.col("l_quantity") > 3, F.col("l_suppkey").cast("string")).otherwise("")), "split", "kind", ["l_partkey", "b"], "o_orderpriority")


@query(
    """
WITH x AS (SELECT conv_id, any_value(CASE conv_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END) AS split, CASE WHEN count(*) > 4 THEN 'long' WHEN count(*) > 2 THEN 'middle' END AS s, sum(coalesce(length(text), 0)) AS c FROM conversations GROUP BY conv_id),
p AS (SELECT split, coalesce(s, 'unknown') AS source, count(*) AS n, avg(c) AS m, max(c) AS x FROM x GROUP BY ALL)
SELECT split, source, n::BIGINT AS "rows", round(m, 6) AS mean_prompt_chars, x::INTEGER AS max_prompt_chars, count(*) OVER (PARTITION BY split) > 1 AND n > 0.6 * sum(n) OVER (PARTITION BY split) AS imbalanced FROM p"""
)
def prompt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: prompt lengths and imbalance by split and source."""
    k = F.col("conv_id") % 10
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.col("text").alias("content"))).alias("messages"))
    x = c.withColumn("split", F.when(k == 8, "val").when(k == 9, "test").otherwise("train")).withColumn("source", F.when(F.size("messages") > 4, "long").when(F.size("messages") > 2, "middle"))
    return audit.prompt_audit(x, "split", "source", "messages").withColumn("mean_prompt_chars", F.round("mean_prompt_chars", 6))


#: The rules of the final rows' schema that a table's types don't give.
FINAL_ROW = {
    "required": ["query_id", "split", "primary_endpoint", "primary_direction"],
    "properties": {"split": {"enum": ["train", "val", "test"]}, "primary_direction": {"enum": ["increase", "decrease"]}, "num_property_objectives": {"const": 3}, "num_positive_answers": {"const": 2}},
}


@query(
    """
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'valid' WHEN 7 THEN NULL ELSE 'train' END AS split, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS e, CASE o_orderstatus WHEN 'O' THEN 'increase' WHEN 'F' THEN 'decrease' ELSE 'same' END AS d, 2 + o_orderkey % 3 AS n, 1 + o_custkey % 2 AS a FROM orders),
v AS (SELECT unnest(list_filter([CASE WHEN split IS NULL THEN 'required:split' END, CASE WHEN e IS NULL THEN 'required:primary_endpoint' END, CASE WHEN split NOT IN ('train', 'val', 'test') THEN 'enum:split' END, CASE WHEN d = 'same' THEN 'enum:primary_direction' END,
 CASE WHEN n <> 3 THEN 'const:num_property_objectives' END, CASE WHEN a <> 2 THEN 'const:num_positive_answers' END], lambda r: r IS NOT NULL)) AS rule FROM x)
SELECT rule, count(*)::BIGINT AS n FROM v GROUP BY rule"""
)
def schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: the declared schema of final rows as rules."""
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(
        k.alias("query_id"), F.when(k % 10 == 8, "val").when(k % 10 == 9, "valid").when(k % 10 != 7, "train").alias("split"), F.when(k % 13 != 0, F.col("o_orderpriority")).alias("primary_endpoint"),
        F.when(F.col("o_orderstatus") == "O", "increase").when(F.col("o_orderstatus") == "F", "decrease").otherwise("same").alias("primary_direction"),
        (k % 3 + 2).alias("num_property_objectives"), (F.col("o_custkey") % 2 + 1).alias("num_positive_answers"),
    )
    return audit.counted([audit.violations(x, "query_id", audit.schema_rules(FINAL_ROW))])


@query(
    """
WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '<' WHEN 2 THEN '>=' WHEN 3 THEN '~' END AS r, event_type || CASE event_id % 4 WHEN 0 THEN '_pKi' WHEN 1 THEN '_pChEMBL' WHEN 2 THEN '_pki' ELSE '_pKi_x' END AS e FROM events)
SELECT event_id, CASE WHEN r = '=' THEN 0.8 WHEN r IN ('<', '>=') THEN 0.65 ELSE 0.55 END::DOUBLE AS confidence, event_id % 4 <= 1 AS dynamic FROM x"""
)
def graded_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 (three levels), F24 (suffixes)."""
    k = F.col("event_id")
    r = F.when(k % 5 == 0, "=").when(k % 5 == 1, "<").when(k % 5 == 2, ">=").when(k % 5 == 3, "~")
    e = F.concat("event_type", F.when(k % 4 == 0, "_pKi").when(k % 4 == 1, "_pChEMBL").when(k % 4 == 2, "_pki").otherwise("_pKi_x"))
    return table(spark, sf_dir, "events").select(k, S.graded_confidence(r).alias("confidence"), S.has_dynamic_suffix(e).alias("dynamic"))


@query(
    """
WITH x AS (SELECT l_orderkey, list(l_partkey) AS a, min(l_linenumber) + 1 AS n, CASE WHEN l_orderkey % 8 = 0 THEN ' ' WHEN l_orderkey % 9 <> 0 THEN 'edit' END AS t, CASE WHEN l_orderkey % 3 = 0 THEN 'decrease' ELSE 'increase' END AS d, round(max(l_discount) - max(l_tax), 6) AS c FROM lineitem GROUP BY l_orderkey)
SELECT count(*)::BIGINT AS "rows", count_if(n <> 2)::BIGINT AS not_2_n, count_if(l_orderkey % 10 = 0 OR len(a) <> 2)::BIGINT AS length_answers, count_if(coalesce(trim(t), '') = '')::BIGINT AS empty_instruction,
 count_if(CASE WHEN d = 'decrease' THEN c >= 0 ELSE c <= 0 END)::BIGINT AS wrong_direction FROM x"""
)
def shape_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: numbers, list lengths, empty texts and directions of final rows."""
    k = F.col("l_orderkey")
    x = table(spark, sf_dir, "lineitem").groupBy(k).agg(F.to_json(F.collect_list("l_partkey")).alias("a"), (F.min("l_linenumber") + 1).alias("n"), F.round(F.max("l_discount") - F.max("l_tax"), 6).alias("delta"))
    x = x.withColumns({"answers": F.when(k % 10 == 0, "[broken").otherwise(F.col("a")), "instruction": F.when(k % 8 == 0, " ").when(k % 9 != 0, "edit"), "direction": F.when(k % 3 == 0, "decrease").otherwise("increase")})
    return audit.shape_audit(x, [("n", "answers", 2)], ["instruction"], "direction", "delta")


@query(
    """
WITH x AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY ALL), p AS (SELECT a.q AS aq, b.q AS bq, a.d AS ad, b.d AS bd FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)
SELECT count(*)::BIGINT AS pairs, round(avg(CASE WHEN aq > bq THEN 1.0 WHEN aq < bq THEN 0.0 ELSE 0.5 END), 9) AS similarity, round(avg(CASE WHEN ad > bd THEN 1.0 WHEN ad < bd THEN 0.0 ELSE 0.5 END), 9) AS evidence, 0.5::DOUBLE AS chance FROM p"""
)
def pairwise_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heuristics and chance on pairs of a positive and a negative."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    side = lambda n, p: x.filter(F.col("l_linenumber") == n).select("l_orderkey", F.col("q").alias(f"{p}q"), F.col("d").alias(f"{p}d"))
    m = metrics.pairwise_baselines(side(1, "a").join(side(2, "b"), "l_orderkey"), {"similarity": (F.col("aq"), F.col("bq")), "evidence": (F.col("ad"), F.col("bd"))})
    return m.select("pairs", F.round("similarity", 9).alias("similarity"), F.round("evidence", 9).alias("evidence"), "chance")
