import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import structures
from tessera.operators import audit, features, objectives


def test_ranker_equals_plain_gradient_steps(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (40, 5)).astype(float)
    x[7] = 0  # a row without cells
    y = (x[:, 0] + rng.normal(0, 0.5, 40) > 1).astype(float)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(5) if x[i, j]], "id int, column long, value double")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(40)], "id int, label int")
    got = features.logistic_ranker(cells, labels, "id", 5, rounds=6)
    one = np.hstack([x, np.ones((40, 1))])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (40 - y.sum()))
    w, moved = np.zeros(6), np.zeros(6)
    for _ in range(6):
        ahead = w + 0.9 * moved
        moved = 0.9 * moved - 0.5 * (one.T @ (share * (1 / (1 + np.exp(-one @ ahead)) - y)) + 1e-4 * np.append(ahead[:5], 0))
        w = w + moved
    assert np.allclose(got, w, atol=1e-9)
    scores = {r["id"]: r["score"] for r in features.ranker_scores(cells, "id", got).collect()}
    assert 7 not in scores and abs(scores[0] - one[0] @ w) < 1e-9
    with pytest.raises(ValueError):
        features.logistic_ranker(cells, labels.withColumn("label", F.lit(1)), "id", 5)


def test_triplet_objectives_take_the_last_and_say_why(spark):
    kind = "sample_id int, objectives array<struct<endpoint_name:string,delta:double,tolerance:double>>"
    pairs = spark.createDataFrame([(1, [("b", 1.0, 0.3), ("a", 2.0, 0.3), ("a", 3.0, 0.3), ("c", 1.0, 0.3)]), (2, [("a", -1.0, 0.2), ("b", -2.0, 0.2), ("c", 0.0, 0.2)]), (3, [("z", 0.0, 0.1), ("", 0.0, 0.1)]), (4, None)], kind)
    t = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 9)], "positive_id int, negative_id int")
    got = {r["negative_id"]: r for r in objectives.triplet_objectives(t, pairs).collect()}
    assert [tuple(o) for o in got[2]["objectives"]] == [("a", 3.0, -1.0, 0.3), ("b", 1.0, -2.0, 0.3)]
    assert [got[k]["outcome"] for k in (2, 3, 4, 9)] == ["kept", "no_shared_preserved_secondary", "missing_filtered_pair", "missing_filtered_pair"]


def test_pair_policy(spark):
    df = spark.createDataFrame([("positive", True, True, 1), ("positive", False, True, 1), ("negative", False, True, 2), ("negative", False, False, 2), ("negative", None, True, 2), ("other", True, True, 3), ("positive", True, True, 0)], "k string, p boolean, s boolean, n int")
    assert [r[0] for r in df.select(objectives.pair_kept(F.col("k"), F.col("p"), F.col("s"), F.col("n"))).collect()] == [True, False, True, False, False, False, False]


def test_rates_of_empty_lists(spark):
    one = "struct<canon:string,bits:array<string>,mw:double,logp:double,qed:double>"
    df = spark.createDataFrame([(None, None, None), ([], [], None), ([(None, ["x"], 1.0, 1.0, 1.0)], [("g", ["x"], 2.0)], ("i", ["x"], 1.0, 1.0, 1.0))], f"predicted array<{one}>, gold array<struct<canon:string,bits:array<string>,delta:double>>, given {one}")
    got = objectives.edit_rates(df).collect()
    assert [(r["n_predicted"], r["valid_rate"], r["exact_recall"], r["all_gold"], r["best_similarity"], r["mw_pass"]) for r in got] == [(0, 0, 0, 0, None, None), (0, 0, 0, 0, None, None), (1, 0, 0, 0, None, None)]
    assert [r["gold_delta"] for r in got] == [None, None, 2.0]


def test_structures_by_notation(spark):
    df = spark.createDataFrame([("c1ccccc1Cl",), ("[Na+].[Cl-]",), ("[NH4+]",), ("C[C@@H](N)C(=O)[O-]",), ("[O--]",), ("[Fe+3]",), (None,)], "s string")
    c = F.col("s")
    got = df.select(F.size(structures.heavy_atoms(c)), structures.formal_charge(c), structures.passes_structure(c, 1, 9)).collect()
    assert [tuple(r) for r in got][:6] == [(7, 0, True), (2, 0, False), (1, 1, True), (6, -1, True), (1, -2, False), (1, 3, False)] and got[6][2] is False


def test_single_cuts(spark):
    df = spark.createDataFrame([(["a", "bb", "c"],), (["x", "x"],), (["x"],), ([],), (None,)], "w array<string>")
    got = [r[0] for r in df.select(structures.single_cuts(F.col("w"))).collect()]
    assert [tuple(c) for c in got[0]] == [("a bb", "c", 2, 1), ("bb c", "a", 2, 1)] and not any(got[1:])


def test_schema_rules(spark):
    df = spark.createDataFrame([(1, "train", 3), (2, None, 2), (3, "x", None)], "id int, split string, n int")
    rules = audit.schema_rules({"required": ["split"], "properties": {"split": {"enum": ["train"]}, "n": {"const": 3}, "id": {"type": "string"}}})
    assert sorted(map(tuple, audit.violations(df, "id", rules).collect())) == [("2", "const:n"), ("2", "required:split"), ("3", "enum:split")]


def test_answer_records_keep_first_rows_and_all_cores(spark):
    kind = "q int, i int, t string, d double, s double, good boolean, core string, a string"
    df = spark.createDataFrame([(1, 2, "x", 9.0, 0.1, True, "c2", "late"), (1, 1, "x", 1.0, 0.1, True, "c1", "first"), (1, 3, "y", 5.0, 0.1, True, "", "z"), (1, 4, "n", 1.0, 0.2, False, None, "z"), (1, 5, "m", 1.0, 0.9, False, "c3", "z"), (1, 6, "", 1.0, 0.9, True, "c3", "z"), (1, 7, "k", 1.0, 0.9, None, "c4", "z"), (2, 1, "x", 1.0, 0.0, True, "c", "z")], kind)
    from tessera.operators import aggregate

    x = df.withColumns({"up": -F.col("d"), "near": -F.col("s")})
    r = aggregate.answer_records(x, ["q"], F.col("i"), "t", F.col("good"), [F.col("up")], [F.col("near"), F.col("up")], "core", ["a"]).collect()
    assert len(r) == 1 and (r[0]["a"], r[0]["cores"], r[0]["positives"], r[0]["negatives"]) == ("first", ["c1", "c2", "c3", "c4"], ["y", "x"], ["m", "n"])


def test_edits_broadcast_no_parts(spark):
    from tests.conftest import SMALL

    from tessera.plans import editing

    plan = editing.edits(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("l_partkey" in line or "o_custkey" in line)]


def test_rate_summary_computes_rates_once(spark):
    """Before, the means over the values of a view computed all rates a second time, with all joins below them."""
    rates = spark.createDataFrame([("macro", 1.0), ("macro", 3.0), (None, 8.0)], "macro string, x double")
    rates = rates.withColumns({c: F.col("x") for c in objectives.RATES}).withColumn("hit_1", F.when(F.col("x") > 5, F.col("x")))
    made = objectives.rate_summary(rates, ["macro"])
    assert sorted((r["view"], r["n"], r["mw_pass"], r["hit_1"]) for r in made.collect()) == [
        ("all", 3, 4.0, 8.0), ("macro:macro", 2, 2.0, None), ("macro:macro", 2, 5.0, 8.0), ("macro:unknown", 1, 8.0, 8.0),
    ]
    from tests.conftest import SMALL

    from tessera.plans import editing

    plan = editing.edit_summary(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("lineitem" in line or "l_partkey#" in line and "Relation" in line for line in plan.splitlines()) == 2 and "Union" not in plan


def test_ranker_keeps_no_rows_in_memory(spark):
    """Before, all rows and their cells were persisted by the executors."""
    from unittest import mock

    cells = spark.createDataFrame([(i, i % 3, 1.0) for i in range(20)], "id int, column long, value double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(22)], "id int, label int")
    with mock.patch.object(type(cells), "persist", side_effect=AssertionError("persisted")), mock.patch.object(type(cells), "cache", side_effect=AssertionError("cached")):
        weights = features.logistic_ranker(cells, labels, "id", 3, rounds=4)
    assert weights[0] > 0 > weights[1]
