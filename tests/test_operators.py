import re

from pyspark.sql import functions as F
from tests.conftest import SMALL

from tessera.operators import aggregate, audit, dedupe, features, metrics, pairs, rank, split
from tessera.plans.catalog import QUERIES


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replicates(spark):
    df = spark.createDataFrame([("a", 1.0, "", 2), ("a", 3.0, "p", 1), ("b", 5.0, "p", 3)], "k string, v double, pmid string, seq int")
    got = {r["k"]: r for r in aggregate.replicates(df, ["k"], "v", ["pmid"], ["pmid"], "seq").collect()}
    assert got["a"]["median_value"] == 2.0 and got["a"]["n_pmid"] == 1 and got["a"]["pmid"] == "p" and got["b"]["n_values"] == 1


def test_union_first_wins(spark):
    a = spark.createDataFrame([("u1", 1, "a"), ("", 2, "a"), (None, 3, "a")], "uid string, seq int, s string")
    b = spark.createDataFrame([("u1", 1, "b"), ("u2", 2, "b")], "uid string, seq int, s string")
    assert rows(dedupe.union_first_wins([a, b], "uid", "seq").select("uid", "s")) == [("u1", "a"), ("u2", "b")]
    with_key = dedupe.union_first_wins([a, b], "uid", "seq", F.concat_ws("|", "s", F.col("seq").cast("string")))
    assert with_key.count() == 4


def test_triplets(spark):
    df = spark.createDataFrame([("g", 1, 5.0, [1, 2]), ("g", 2, 6.0, [1, 2]), ("g", 3, 7.0, [9]), ("g", 4, 4.0, [1, 2, 3])], "g string, id long, p double, f array<int>")
    best = pairs.strongest_partner(df, ["g"], "id", "p", "f", gain=0.5, similarity=0.35)
    assert (1, 2) in {(r["a_id"], r["b_id"]) for r in best.collect()}  # 3 is stronger, but not similar
    neg = pairs.hard_negative(best, df, ["g"], "id", "p", "f")
    assert {(r["a_id"], r["b_id"], r["n_id"]) for r in neg.collect()} == {(1, 2, 4)}
    capped = pairs.strongest_partner(df, ["g"], "id", "p", "f", gain=0.5, similarity=0.35, scan=1)
    assert 1 not in {r["a_id"] for r in capped.collect()}  # the one candidate that is scanned isn't similar


def test_improved(spark):
    df = spark.createDataFrame([(1.0, 1.6), (0.0, 9.0), (2.0, 1.0)], "a double, b double")
    got = df.select(pairs.improved(F.col("a"), F.col("b"), relative=0.25).alias("up"), pairs.improved(F.col("a"), F.col("b"), "decrease").alias("down")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True)]


def test_components_and_bins(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, split.component_labels(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100
    assert split.component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leakage(spark):
    df = spark.createDataFrame([("train", 1), ("val", 1), ("test", 2), ("train", 2), ("train", 3)], "split string, k int")
    assert rows(split.leakage_matrix(df, "split", "k")) == [("test", "train", 1), ("train", "val", 1)]
    assert rows(dedupe.overlap_cleaned(df, "split", "k").select("split", "k")) == [("test", 2), ("train", 3), ("val", 1)]


def test_rank(spark):
    df = spark.createDataFrame([(f"k{i % 3}", i) for i in range(30)], "k string, v int")
    ids = rank.numbered(df, ["v"], "id").orderBy("v").collect()
    assert [r["id"] for r in ids] == [f"q_{i + 1:06d}" for i in range(30)]
    a, b = (rank.hash_sample(d, ["k"], F.col("v"), 4, "s") for d in (df, df.repartition(7)))
    assert rows(a) == rows(b) and a.count() == 12
    assert rank.budgeted(spark.createDataFrame([(1, 5.0), (2, 99.0), (3, 4.0), (4, 2.0), (5, 1.0)], "i int, mb double"), ["i"], "mb", 10, 10).count() == 2


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a")], "query_id int, pos int, item string")
    ans = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "query_id int, item string, gain double")
    got = {r["query_id"]: r for r in metrics.ranked_metrics(q, ranked, ans, 2).collect()}
    assert got[1]["mrr"] == 0.5 and got[1]["success"] == 1 and abs(got[1]["ndcg"] - 0.63093) < 1e-5 and got[2]["ndcg"] == 0
    c = spark.createDataFrame([(0.0, 0), (1.0, 1), (1.2, 1), (0.95, 0)], "c double, y int")
    bins = {r["bin"]: r for r in metrics.calibration_bins(c, "c", "y").collect()}
    assert bins[9]["n"] == 2 and abs(bins[9]["ece_part"] - 0.5 * abs(0.5 - 0.975)) < 1e-9
    p = spark.createDataFrame([("g", 1.0, True), ("g", 1.0, False), ("g", 0.5, False)], "g string, s double, y boolean")
    assert metrics.pairwise_accuracy(p, "g", "s", F.col("y")).first()["accuracy"] == 0.75
    assert metrics.average_precision(p.withColumn("o", F.monotonically_increasing_id()), "s", F.col("y"), "o").first()["average_precision"] in (0.5, 1.0)


def test_audit(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (2, 50)], "id int, v int")
    v = audit.violations(df, "id", [("null", F.col("v").isNull()), ("large", F.col("v") > 10)]).unionByName(audit.duplicates(df, "id", "twice"))
    assert rows(v) == [("2", "large"), ("2", "null"), ("2", "twice")]
    assert df.select(audit.reject_reason([("null", F.col("v").isNull()), ("large", F.col("v") > 10)])).collect()[0][0] is None


def test_features(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, t string")
    cells = features.hashed_tokens(df, "id", "t", 16)
    assert {r["value"] for r in cells.collect()} == {2.0, 1.0}
    pos = spark.createDataFrame([("e", 1, "a"), ("e", 2, "b")], "k string, q int, item string")
    uni = spark.createDataFrame([("e", x) for x in "abcd"], "k string, item string")
    d = features.decoys(pos, uni, "k", "q", "item", 2, "s").collect()
    assert len(d) == 4 and (1, "a") not in {(r["q"], r["item"]) for r in d}


def test_cells_are_shuffled_as_rows(spark):
    import re

    from pyspark.sql import functions as F

    from tessera.operators import features

    df = spark.createDataFrame([(1, [0, 1], [1], "x y", "t", 2.0), (1, [0], None, "y", "t", 1.0), (2, None, [3], None, "", 0.0)], "id long, a array<int>, b array<int>, x string, t string, v double")
    cells = features.candidate_cells(df, "id", "a", "b", "x", ["t"], [F.col("v")], 8, 8, 8)
    assert {r["column"]: r["value"] for r in cells.filter("id = 1 and column < 24").collect()} == {0: 2.0, 1: 1.0, 9: 1.0, 16: 2.0}
    packed = cells.groupBy("id").agg(F.sum("value"))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_first_bucket_of_each_ordered_pair(spark):
    from tessera.operators import dedupe

    x = spark.createDataFrame([(1, 2, 9), (1, 2, 4), (2, 1, 7), (1, 3, 5)], "a long, b long, k long")
    assert sorted(map(tuple, dedupe.first_buckets(x, "a", "b", "k").collect())) == [(1, 2, 4), (1, 3, 5), (2, 1, 7)]


def test_component_labels_contract_the_graph(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(1, 300)] + [(1000 + k % 7, 2000 + k) for k in range(300)] + [(5, 5), (9000, 9000)]
    seen, keep = [], split.kept
    monkeypatch.setattr(split, "kept", lambda df: (x := keep(df), seen.append(x.count() if x.columns == ["a", "b"] else None))[0])
    got = dict(map(tuple, split.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(1, 301), 1), **{2000 + k: 1000 + k % 7 for k in range(300)}, **{1000 + k: 1000 + k for k in range(7)}, 9000: 9000}
    sizes = [n for n in seen if n is not None]
    assert sizes[0] == len(edges) and sizes[-1] == 0 and all(b < a for a, b in zip(sizes, sizes[1:]))


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    assert (split.tasks(spark.range(100), 10), split.tasks(spark.range(100), 1000)) == (11, 4)
    monkeypatch.setattr(split, "tasks", lambda df: 37)
    for name, keys in {"violations": ["q", "o_custkey"], "ranked_metrics": ["l_orderkey", "query_id"]}.items():
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\((\w+)#\d+L?(?:, \w+#\d+L?)*, (\d+)\)", plan)
        assert {(k, "37") for k in keys} <= set(dealt) and not {(k, n) for k, n in dealt if k in keys and n != "37"}
