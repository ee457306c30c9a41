"""Pair joins, running sums and bins against plain restatements."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import ordered, pairs
from tessera.plans.catalog import QUERIES


def sets(seed, n, most):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, rng.choice("gh"), [words[min(int(rng.expovariate(0.4)), 11)] for _ in range(rng.randint(0, most))]) for k in range(n)]
    return [*rows, (n, "g", None), (n + 1, "g", []), *((n + 2 + k, "h", ["w0", "w1", "w2"]) for k in range(15)), (900, None, ["w0", "w1"]), (901, None, ["w0", "w1"])]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_pairs_by_overlap(spark, least):
    rows = sets(least, 50, 4)
    df = spark.createDataFrame([(*r, r[0] % 3) for r in rows], "id long, g string, parts array<string>, v long").repartition(3)
    got = sorted(map(tuple, pairs.overlap_pairs(df, ["g"], "id", "parts", least, ["v"]).select("a_id", "b_id", "n_parts", "a_v", "b_v").collect()))
    want = [(a[0], b[0], n, a[0] % 3, b[0] % 3) for a, b in itertools.combinations(sorted(rows, key=lambda r: r[0]), 2) if a[1] and a[1] == b[1] and (n := len({*(a[2] or [])} & {*(b[2] or [])})) >= least]
    assert got == sorted(want)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 1.0])
def test_pairs_by_similarity(spark, threshold):
    rows = sets(7, 70, 9)
    df = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, parts array<string>").repartition(3)
    got = {(r["a_id"], r["b_id"]): r["similarity"] for r in pairs.similar_pairs(df, "id", "parts", threshold).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r[0]), 2):
        x, y = {*(a[2] or [])}, {*(b[2] or [])}
        if x and y and len(x & y) / len(x | y) >= threshold:
            want[a[0], b[0]] = len(x & y) / len(x | y)
    assert got == pytest.approx(want) and got.keys() == want.keys()


def test_pairs_in_bands(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("gh"), rng.choice([-3.0, -0.1, 0.0, 0.1, 2.5, 5.0, 7.49, rng.uniform(-20, 20)]), rng.randint(-5, 5)) for k in range(120)] + [(500, "g", None, 1), (501, None, 1.0, 1), (502, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y long")
    got = {(r["a_id"], r["b_id"]) for r in pairs.band_pairs(df, ["g"], "id", ["y"], {"x": 2.5, "y": 2}).collect()}
    want = {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if a[1] and a[1] == b[1] and a[2] is not None and b[2] is not None and abs(b[2] - a[2]) <= 2.5 and abs(a[3] - b[3]) <= 2}
    assert got == want
    counts = {r["g"]: r["held"] for r in pairs.value_pairs(df.filter("g is not null"), ["g"], "y", lambda a, b: b - a <= 1).collect()}
    assert counts == {g: sum(1 for a, b in itertools.permutations([r for r in rows if r[1] == g], 2) if b[3] - a[3] <= 1) for g in "gh"}


def test_running_sums(spark):
    rows = [(k * 37 % 101, k, k % 5) for k in range(101)] + [(7, 1000 + k, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "x long, id long, v long").repartition(5)
    got = {r["id"]: (r["rank"], r["sum"]) for r in ordered.running(df, [F.asc("x"), F.asc("id")], {"rank": F.lit(1), "sum": F.col("v")}).collect()}
    total, want = 0, {}
    for k, (_, i, v) in enumerate(sorted(rows)):
        total += v
        want[i] = (k + 1, total)
    assert got == want
    assert ordered.running(df.limit(0), [F.asc("x")], {"rank": F.lit(1)}).count() == 0


def test_overall_metrics(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1.0, 2.0, 2.5, 3.0]), rng.random() < 0.3) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, s double, y boolean").repartition(4)
    low = lambda s: -1e9 if s is None else s
    pos, neg = [low(s) for _, s, y in rows if y], [low(s) for _, s, y in rows if not y]
    r = ordered.overall_accuracy(df, "s", F.col("y")).first()
    assert (r["positives"], r["negatives"]) == (len(pos), len(neg))
    assert r["accuracy"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    known = [x for x in rows if x[1] is not None]
    hits, precision = 0, []
    for k, (_, _, y) in enumerate(sorted(known, key=lambda x: (-x[1], x[0])), 1):
        hits += y
        precision += [hits / k] * y
    p = ordered.overall_precision(df.filter("s is not null"), "s", F.col("y"), [F.col("id")]).first()
    assert p["average_precision"] == pytest.approx(sum(precision) / len(precision))
    assert ordered.overall_accuracy(df.filter("y"), "s", F.col("y")).first()["accuracy"] is None


def greedy(sizes, ratios):
    total = sum(n for _, n in sizes)
    share = [max(total * r / sum(ratios.values()), 1.0) for r in ratios.values()]
    filled, out = [0] * len(share), {}
    for key, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        j = min(range(len(share)), key=lambda j: ((filled[j] + n) / share[j], j))
        filled[j] += n
        out[key] = list(ratios)[j]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_bins_by_runs(spark, seed):
    rng = random.Random(seed)
    sizes = [(f"k{k:05d}", rng.choice([1, 1, 1, 2, 2, 3, 7, 50, rng.randint(1, 400)])) for k in range((1, 10, 700, 9000)[seed])]
    ratios = {"train": 0.8, "val": 0.1, "test": 0.1} if seed % 2 else {"a": 1.0, "b": 1.0, "c": 2.0, "d": 0.5}
    df = spark.createDataFrame(sizes, "label string, n long")
    got = {r["label"]: r["split"] for r in ordered.filled_bins(df, "label", "n", ratios).collect()}
    assert got == greedy(sizes, ratios)


def test_shares_of_long_runs():
    rng = random.Random(9)
    for _ in range(300):
        filled, share = [rng.randint(0, 500) for _ in range(3)], [rng.uniform(1, 300) for _ in range(3)]
        size, count = rng.randint(1, 40), rng.randint(1, 60)
        want, now = [0, 0, 0], list(filled)
        for _ in range(count):
            j = min(range(3), key=lambda j: ((now[j] + size) / share[j], j))
            now[j], want[j] = now[j] + size, want[j] + 1
        assert ordered._shared_out(size, count, filled, share) == want


def test_pairs_of_large_groups_are_dealt_to_many_partitions(spark):
    rows = [(k, "g" if k % 50 else "h", k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    x = pairs.group_pairs(df, ["g"], "id", ["v"])
    assert x.count() == sum(n * (n - 1) for n in (2940, 60)) and x.select("a_id", "b_id").distinct().count() == x.count()
    assert x.groupBy(F.spark_partition_id()).count().count() > 2  # one group has nearly all rows


def test_preserved_pairs_equal_preserved_secondary(spark):
    rng = random.Random(4)
    rows = [(u, e, rng.choice([None, 0.0, 1.0, 1.2, 5.0, 6.1])) for u in range(40) for e in "vwxyz" if rng.random() < 0.7]
    profile = spark.createDataFrame(rows, "u long, e string, median_value double")
    tolerance = lambda e, v: F.greatest(F.lit(0.3), F.abs(v) * 0.25)
    met = pairs.group_pairs(profile, ["e"], "u", []).filter("a_u < b_u").select(F.col("a_u").alias("a"), F.col("b_u").alias("b"), F.col("e").alias("primary"))
    want = pairs.preserved_secondary(met, profile, "u", "e", tolerance, 2)
    got = pairs.preserved_pairs(profile, "u", "e", tolerance, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_similarity_is_found_once_for_two_classes(spark):
    df = spark.createDataFrame([(k, ["a", "b"] if k % 2 else ["a", "b", "c"]) for k in range(60)], "id long, f array<string>")
    x = pairs.overlap_pairs(df.withColumn("top", F.slice("f", 1, 2)), [], "id", "top", 2, ["f"], ("f", lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))))
    got = {(r["a_id"], r["b_id"]): round(r["similarity"], 6) for r in x.collect()}
    assert got == {(a, b): 1.0 if (a + b) % 2 == 0 else 0.666667 for a in range(60) for b in range(a + 1, 60)}


def _close(a, b):
    return len({*a} & {*b}) / len({*a} | {*b})


def test_most_similar_worse_row(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("gh"), rng.choice([1.0, 1.5, 2.0, 2.5, 3.0, 9.0]), sorted(rng.sample(range(8), rng.randint(1, 4)))) for k in range(60)]
    df = spark.createDataFrame(rows, "u long, g string, p double, f array<int>").repartition(3)
    x = pairs.most_similar_worse(df, ["g"], "u", "p", "f", gain=0.5, loss=1.0)
    want = set()
    for a, b in itertools.permutations(rows, 2):
        worse = [n for n in rows if n[1] == a[1] and n[2] - a[2] <= -1.0]
        if a[1] == b[1] and b[2] - a[2] >= 0.5 and worse:
            want.add((a[0], b[0], min(worse, key=lambda n: (-_close(b[3], n[3]), n[2], n[0]))[0]))
    assert set(map(tuple, x.select("a_id", "b_id", "n_id").collect())) == want


def test_largest_decreases_by_sizes(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("gh"), float(rng.randint(1, 9)), rng.randint(1, 6)) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, g string, v double, s int").repartition(3)
    task = spark.createDataFrame([("x", -1.0, 4), ("y", -3.0, 1)], "task string, most double, band int")
    want = set()
    for name, most, band in (("x", -1.0, 4), ("y", -3.0, 1)):
        for a in rows:
            ok = [b for b in rows if b[1] == a[1] and b[0] != a[0] and b[2] - a[2] <= most and abs(b[3] - a[3]) <= band]
            want |= {(name, a[0], b[0]) for b in sorted(ok, key=lambda b: (b[2] - a[2], b[0]))[:3]}
    assert {(r["task"], r["a_id"], r["b_id"]) for r in pairs.extreme_partners(df, ["g"], "id", "v", "s", task, 3).collect()} == want


def test_scoped_negatives_of_unknown_improvement_go_by_id(spark):
    kind = "id long, k string, t long, d double, b array<int>"
    positives = spark.createDataFrame([(1, "k", 1, None, [1, 2]), (2, "k", 1, 0.5, [1, 2])], kind)
    negatives = spark.createDataFrame([(10, "k", 2, 0.4, [1, 2]), (11, "k", 2, 0.1, [1, 2]), (9, "k", 1, 0.0, [1, 2]), (2, "k", 3, 0.0, [1, 2])], kind)
    got = {r["positive_id"]: r["negative_id"] for r in pairs.scoped_hard_negative(positives, negatives, ["k"], ["k"], "id", "t", "d", "b", fallback=False).collect()}
    assert got == {1: 2, 2: 11}
    few = negatives.filter("id in (10, 11)")
    got = {r["positive_id"]: r["negative_id"] for r in pairs.scoped_hard_negative(positives, few, ["k"], ["k"], "id", "t", "d", "b", fallback=False).collect()}
    assert got == {1: 10, 2: 11}


def test_triplets_equal_a_plain_search(spark):
    rng = random.Random(7)
    rows = [(k, "g", rng.choice([1.0, 1.5, 2.0, 2.5, 3.0]), sorted(rng.sample(range(8), rng.randint(2, 4)))) for k in range(40)]
    df = spark.createDataFrame(rows, "u long, g string, p double, f array<int>").repartition(3)
    for gain in (0.5, -0.5):
        best = pairs.strongest_partner(df, ["g"], "u", "p", "f", gain=gain, similarity=0.3, scan=7)
        want, triplets = {}, {}
        for a in rows:
            c = sorted((b for b in rows if b[0] != a[0] and b[2] >= a[2] + gain), key=lambda b: (-b[2], b[0]))[:7]
            if ok := [b for b in c if _close(a[3], b[3]) >= 0.3]:
                want[a[0]] = ok[0][0]
                n = sorted((n for n in rows if n[0] not in (a[0], ok[0][0]) and n[2] <= a[2] - 0.25), key=lambda n: (n[2], n[0]))[:5]
                if good := [x for x in n if _close(a[3], x[3]) >= 0.2 and _close(ok[0][3], x[3]) >= 0.2]:
                    triplets[a[0]] = good[0][0]
        assert {r["a_u"]: r["b_u"] for r in best.collect()} == want
        got = pairs.hard_negative(best, df, ["g"], "u", "p", "f", 0.25, 0.2, 0.2, scan=5)
        assert {r["a_u"]: r["n_id"] for r in got.collect()} == triplets


@pytest.mark.parametrize("block", [5, 1 << 18])
def test_window_counts(spark, block):
    rng, nan = random.Random(4), float("nan")
    rows = [(k, rng.choice("gh"), rng.choice([-3.0, 0.0, 0.1, 2.5, 5.0, rng.uniform(-9, 9)]), rng.choice([0.0, 0.1, 0.2, 0.3, nan]), rng.randint(0, 4)) for k in range(150)]
    rows += [(500, "g", None, 0.1, 1), (501, None, 1.0, 0.1, 1), (502, None, 1.0, 0.1, 1), (503, "g", nan, 0.1, 1), (504, "g", float("inf"), 0.1, 1), (505, "g", 1.0, None, 1)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, z long").repartition(3)
    checks = {"y": lambda a, b: a - b <= 0.1, "z": lambda a, b: (b - a <= 1) & (a - b <= 1)}
    got = pairs.window_counts(df, ["g"], ("x", 2.5), checks, block).first()
    near = [(a, b) for a, b in itertools.permutations(rows, 2) if a[1] and a[1] == b[1] and a[2] is not None and b[2] is not None and abs(b[2] - a[2]) <= 2.5]
    held = [1 for a, b in near if a[3] is not None and b[3] is not None and a[3] - b[3] <= 0.1 and abs(a[4] - b[4]) <= 1]
    assert (got["near"], got["held"]) == (len(near), len(held))
    assert tuple(pairs.window_counts(df.limit(0), ["g"], ("x", 2.5), checks).first()) == (0, 0)


def test_descriptor_windows_are_counted_without_pairs(spark, tmp_path):
    """60,000 parts of one brand make 3.6 billion pairs."""
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), (900 + F.col("id") % 1000 / 10).alias("p_retailprice"))
    df.write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["descriptor_window"](spark, str(tmp_path))
    assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString()
    row = got.first()
    assert row["n"] == row["mw"] == n * (n - 1)
    size = collections.Counter(k % 50 for k in range(n))
    assert row["logp"] == sum(x * y for i, x in size.items() for j, y in size.items() if abs((i + 1) / 10 - (j + 1) / 10) <= 2) - n
    both = collections.Counter((k % 100, k % 7) for k in range(n))
    assert row["success"] == sum(x * y for (i, s), x in both.items() for (j, t), y in both.items() if abs((j % 50 + 1) / 10 - (i % 50 + 1) / 10) <= 2 and i / 100 - j / 100 <= 0.1 and t - s <= 1) - n


def test_similarities_are_rounded_once_for_two_classes(spark):
    df = spark.createDataFrame([(k, ["a", "b", "c"]) for k in range(20)] + [(20 + k, ["a", "b"]) for k in range(20)], "id long, parts array<string>")
    x = pairs.similar_pairs(df, "id", "parts", 0.6, 2)
    assert sorted(map(tuple, x.groupBy("similarity").count().collect())) == [(0.67, 400), (1.0, 380)]
    plan = QUERIES["fragment_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("round(")  # below the rows that a pair of classes becomes


def test_preserved_pairs_are_not_joined(spark):
    """Before, every pair was a joined row whose changes were found one by one. Here are ties, NULL, NaN, infinite and negative values, blocks of both
    sides and profiles of different endpoints."""
    rng, nan, inf = random.Random(8), float("nan"), float("inf")
    rows = [(u, e, rng.choice([None, nan, inf, -1.0, 0.0, 1.0, 1.1, 1.2, 6.0])) for u in range(600) for e in "abcdef" if rng.random() < 0.6] + [(None, "a", 1.0), (1, None, 1.0)]
    profile = spark.createDataFrame(rows, "u long, e string, median_value double")
    x = pairs.preserved_pairs(profile, "u", "e", lambda e, v: F.greatest(F.lit(0.3), F.abs(v) * 0.25), 2)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan
    of = collections.defaultdict(dict)
    for u, e, v in rows:
        if u is not None and e is not None:
            of[u][e] = v
    want = set()
    for a, b in itertools.combinations(sorted(of), 2):
        near = []
        for e in of[a].keys() & of[b].keys():
            if (v := of[a][e]) is not None and (w := of[b][e]) is not None and (ratio := abs(w - v) / max(0.3, abs(v) * 0.25)) <= 1:
                near.append((ratio, e))
        for p in of[a].keys() & of[b].keys():
            want |= {(a, b, p, e, k) for k, (_, e) in enumerate([n for n in sorted(near) if n[1] != p][:2], 1)}
    assert set(map(tuple, x.select("a", "b", "primary", "endpoint", "rank").collect())) == want
    words = profile.filter("u < 90").withColumn("u", F.concat(F.lit("m"), "u"))
    assert pairs.preserved_pairs(words, "u", "e", lambda e, v: F.greatest(F.lit(0.3), F.abs(v) * 0.25), 2).filter("a < b").count() > 1000


def test_similarity_of_words_equals_that_of_sets(spark):
    rng = random.Random(11)
    rows = [(k, sorted(rng.sample(range(130), rng.randint(0, 90)))) for k in range(40)] + [(90, None), (91, []), (92, [0, 63, 64, 127, 129]), (93, [63])]
    df = spark.createDataFrame(rows, "u long, f array<int>").withColumn("p", F.lit(1))
    x, words, similar = pairs.packed(df.withColumn("kept", F.col("f")), "f", 130)
    assert words == ["f_0", "f_1", "f_2"]
    met = pairs.group_pairs(x, ["p"], "u", [*words, "kept"]).select(similar("a", "b").alias("got"), scalars.jaccard(F.col("a_kept"), F.col("b_kept")).alias("want"))
    assert met.count() == 44 * 43 and met.filter("got <> want or got is null").count() == 0
    plan = QUERIES["scaffold_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "array_intersect" not in plan


def test_rounding_by_arithmetic(spark):
    inf = float("inf")
    df = spark.createDataFrame([(0.0,), (0.5,), (-0.5,), (1.25,), (-1.25,), (2.345678949,), (0.49999999999999994,), (1e300,), (inf,), (-inf,), (None,), (4503599627370497.5,)], "x double")
    assert [r[0] for r in df.select(scalars.rounded(F.col("x"), 0)).collect()] == [0.0, 1.0, -1.0, 1.0, -1.0, 2.0, 0.0, 1e300, inf, -inf, None, 4503599627370497.5]
    assert [r[0] for r in df.select(scalars.rounded(F.col("x"), 1)).collect()][3:6] == [1.3, -1.3, 2.3]


def test_triplets_by_words_equal_those_by_sets(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice("gh"), rng.choice([1.0, 1.5, 2.0, 2.5, 3.0]), sorted(rng.sample(range(80), rng.randint(0, 60)))) for k in range(80)] + [(90, "g", 2.0, None)]
    df = spark.createDataFrame(rows, "u long, g string, p double, f array<int>")

    def triplets(bits):
        best = pairs.strongest_partner(df, ["g"], "u", "p", "f", gain=0.5, similarity=0.3, scan=7, bits=bits)
        x = pairs.hard_negative(best, df, ["g"], "u", "p", "f", 0.25, 0.3, 0.3, scan=5, bits=bits)
        return sorted(map(tuple, x.select("a_u", "b_u", "n_id", "input_similarity", "positive_similarity").collect()))

    assert triplets(80) == triplets(None) != []
    plan = QUERIES["hard_negative_triplet"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "array_intersect" not in plan


def test_most_similar_worse_by_words_and_without_sorting_pairs(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice("gh"), rng.choice([1.0, 1.5, 2.0, 2.5, 3.0]), sorted(rng.sample(range(80), rng.randint(0, 60)))) for k in range(70)] + [(90, "g", 2.0, None)]
    df = spark.createDataFrame(rows, "u long, g string, p double, f array<int>")
    x, y = (pairs.most_similar_worse(df, ["g"], "u", "p", "f", 0.5, 0.5, bits) for bits in (80, None))
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())) != []
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_min(_r" in plan  # a minimum of structs sorts all pairs of fingerprints


def test_copies_of_a_large_group_are_bounded(spark):
    """Before, a group of 40,000 rows had 79 blocks, and each row as many copies."""
    df = spark.range(40_000).select("id", F.lit("g").alias("g"))
    one, two, _ = pairs._dealt_blocks(df, df.withColumnRenamed("id", "other"), ["g"], (512, 512))
    assert one.count() == two.count() == 32 * 40_000
