"""Objectives of edited pairs and triplets, and the metrics of predicted edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import jaccard


def pair_kept(kind: Column, primary_ok: Column, secondary_ok: Column, n_objectives: Column, least: int = 1) -> Column:
    """Enough preserved objectives; positives pass both checks, negatives fail the primary one alone. NULLs fail."""
    both = ((kind == "positive") & primary_ok & secondary_ok) | ((kind == "negative") & ~primary_ok & secondary_ok)
    return F.coalesce((n_objectives >= least) & both, F.lit(False))


def triplet_objectives(triplets: DataFrame, pairs: DataFrame, most: int = 2) -> DataFrame:
    """Triplets (positive_id, negative_id) looked up twice in the kept pairs (sample_id, objectives: array of
    endpoint_name, delta, tolerance); the first ``most`` endpoints by name that both preserve. ``outcome`` says why a triplet
    goes, so one pass gives the rows and the counters. Of repeated endpoints of one pair the last counts."""
    side = lambda p: pairs.select(F.col("sample_id").alias(f"{p}_id"), F.filter("objectives", lambda o: F.length(o["endpoint_name"]) > 0).alias(f"_{p}"))
    x = triplets.join(side("positive"), "positive_id", "left").join(side("negative"), "negative_id", "left")
    names = lambda c: F.transform(c, lambda o: o["endpoint_name"])
    last = lambda c, n: F.element_at(F.filter(c, lambda o: o["endpoint_name"] == n), -1)
    shared = F.slice(F.array_sort(F.array_intersect(names(F.col("_positive")), names(F.col("_negative")))), 1, most)
    chosen = F.transform(
        shared,
        lambda n: F.struct(
            n.alias("endpoint_name"), last(F.col("_positive"), n)["delta"].alias("positive_delta"), last(F.col("_negative"), n)["delta"].alias("negative_delta"), last(F.col("_positive"), n)["tolerance"].alias("tolerance")
        ),
    )
    outcome = F.when(F.col("_positive").isNull() | F.col("_negative").isNull(), "missing_filtered_pair").when(F.size(shared) == 0, "no_shared_preserved_secondary").otherwise("kept")
    return x.withColumn("outcome", outcome).withColumn("objectives", chosen).drop("_positive", "_negative")


#: Metrics of a row; their means are the summary.
RATES = (
    "with_prediction", "two_or_more", "exactly_two", "n_predicted", "n_valid", "valid_rate", "duplicate", "hit_1", "exact_any", "exact_recall", "all_gold", "best_similarity",
    "gold_coverage", "unchanged_rate", "with_unchanged", "best_input_similarity", "mean_input_similarity", "mw_pass", "logp_pass", "qed_pass", "all_pass", "abs_mw", "abs_logp",
    "delta_qed", "gold_delta", "matched_delta",
)


def _mean(values: Column) -> Column:
    """Mean of an array's values that aren't NULL; NULL for none."""
    there = F.filter(values, lambda v: v.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(there), F.lit(0))


def edit_rates(df: DataFrame, mw: float = 100.0, logp: float = 2.0, qed: float = 0.1) -> DataFrame:
    """Metrics of each row. Columns: ``predicted`` (array of canon, bits, mw, logp, qed; canon is NULL for invalid ones),
    ``gold`` (array of canon, bits, delta) and ``given`` (struct of canon, bits, mw, logp, qed). Lists of a model are short, so
    all is done by array functions without a shuffle. NULL lists are empty; a rate without a base is NULL and is no part of means."""
    empty = lambda c: F.coalesce(F.col(c), F.filter(F.col(c), lambda _: F.lit(False)))
    x = df.withColumn("_all", F.coalesce(F.size("predicted"), F.lit(0))).withColumn("_all", F.greatest("_all", F.lit(0)))
    x = x.withColumn("_valid", F.filter("predicted", lambda p: p["canon"].isNotNull())).withColumn("_gold", F.filter("gold", lambda g: g["canon"].isNotNull()))
    valid, gold, given = F.col("_valid"), F.col("_gold"), F.col("given")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    canon = lambda c: F.transform(c, lambda s: s["canon"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    n, n_valid, n_gold = F.col("_all"), size(valid), size(gold)
    matched = size(F.array_intersect(canon(valid), canon(gold)))
    near = lambda a, bs: F.array_max(F.transform(bs, lambda b: jaccard(a, b["bits"])))
    unchanged = size(F.filter(valid, lambda p: p["canon"] == given["canon"]))
    to_input = F.when(given["canon"].isNotNull(), F.transform(valid, lambda p: jaccard(p["bits"], given["bits"])))
    described = F.when(given["canon"].isNotNull(), valid)
    passes = {
        "mw_pass": lambda p: F.abs(p["mw"] - given["mw"]) <= mw,
        "logp_pass": lambda p: F.abs(p["logp"] - given["logp"]) <= logp,
        "qed_pass": lambda p: p["qed"] - given["qed"] >= -qed,
    }
    share = lambda test: _mean(F.transform(described, lambda p: test(p).cast("double")))
    rates = {
        "with_prediction": flag(n > 0),
        "two_or_more": flag(n >= 2),
        "exactly_two": flag(n == 2),
        "n_predicted": n.cast("double"),
        "n_valid": n_valid.cast("double"),
        "valid_rate": n_valid / F.greatest(n, F.lit(1)),
        "duplicate": flag(size(F.array_distinct(canon(valid))) < n_valid),
        "hit_1": flag(F.array_contains(canon(gold), F.get(canon(valid), 0))),
        "exact_any": flag(matched > 0),
        "exact_recall": matched / F.greatest(n_gold, F.lit(1)),
        "all_gold": flag((matched == n_gold) & (n_gold > 0)),
        "best_similarity": F.array_max(F.transform(valid, lambda p: near(p["bits"], gold))),
        "gold_coverage": _mean(F.transform(gold, lambda g: near(g["bits"], valid))),
        "unchanged_rate": unchanged / F.greatest(n_valid, F.lit(1)),
        "with_unchanged": flag(unchanged > 0),
        "best_input_similarity": F.array_max(to_input),
        "mean_input_similarity": _mean(to_input),
        **{name: share(test) for name, test in passes.items()},
        "all_pass": share(lambda p: passes["mw_pass"](p) & passes["logp_pass"](p) & passes["qed_pass"](p)),
        "abs_mw": _mean(F.transform(described, lambda p: F.abs(p["mw"] - given["mw"]))),
        "abs_logp": _mean(F.transform(described, lambda p: F.abs(p["logp"] - given["logp"]))),
        "delta_qed": _mean(F.transform(described, lambda p: p["qed"] - given["qed"])),
        "gold_delta": _mean(F.transform(empty("gold"), lambda g: g["delta"])),
        "matched_delta": _mean(F.transform(F.filter(gold, lambda g: F.array_contains(canon(valid), g["canon"])), lambda g: g["delta"])),
    }
    return x.withColumns(rates).drop("_all", "_valid", "_gold")


def rate_summary(rates: DataFrame, views: Sequence[str]) -> DataFrame:
    """Means of all rows, of every value of each view, and over the values of each view (macro). The means of the values are
    few rows and go on to their macro row; the rates, the dear part, are computed once."""
    named = [F.concat(F.lit(f"{v}:"), F.coalesce(F.col(v).cast("string"), F.lit("unknown"))) for v in views]
    rows = rates.withColumn("view", F.explode(F.array(F.lit("all"), *named)))
    per = rows.groupBy("view").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in RATES))
    macro = F.concat(F.lit("macro:"), F.substring_index("view", ":", 1))
    own = F.struct(F.col("view"), F.lit(False).alias("macro"))
    to = per.withColumn("_to", F.explode(F.when(F.col("view") == "all", F.array(own)).otherwise(F.array(own, F.struct(macro.alias("view"), F.lit(True).alias("macro"))))))
    both = to.groupBy("_to").agg(F.when(F.col("_to.macro"), F.count("*")).otherwise(F.max("n")).alias("n"), *(F.avg(c).alias(c) for c in RATES))  # the mean of one row is that row
    return both.select("_to.view", "n", *RATES)


def replacement_summary(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """E12, one row: predictions of a single replacement against a positive, a negative and the input. ``records``: sample_id (unique),
    positive, negative, input (canonical texts) with positive_fp and input_fp (bits); ``predictions``: sample_id, parsed (as read),
    canonical (NULL if it is no structure), fp, error. Predictions without a record are only counted; every prediction of a record counts, so
    coverage can exceed 1."""
    joined = predictions.withColumnRenamed("sample_id", "_id").join(records, F.col("_id") == F.col("sample_id"), "left")
    here = F.col("sample_id").isNotNull()
    rate = lambda c: F.coalesce(F.avg(F.when(here, F.coalesce(c.cast("int"), F.lit(0)))), F.lit(0.0))
    near = lambda fp: F.coalesce(F.avg(F.when(here & F.col("canonical").isNotNull(), jaccard(F.col("fp"), F.col(fp)))), F.lit(0.0))
    same = lambda c: F.col("canonical") == F.col(c)
    got = joined.agg(
        F.count("*").alias("n_predictions"), F.count_if(here).alias("n_evaluated"), rate(F.col("canonical").isNotNull()).alias("valid_rate"), rate(same("positive")).alias("positive_rate"),
        rate(same("negative")).alias("negative_rate"), rate(same("input")).alias("unchanged_rate"), near("positive_fp").alias("similarity_to_positive"), near("input_fp").alias("similarity_to_input"),
        F.count_if(~here).alias("without_record"), F.count_if(here & (F.coalesce("error", F.lit("")) != "")).alias("errors"), F.count_if(here & (F.coalesce("parsed", F.lit("")) == "")).alias("empty"),
    )
    total = records.agg(F.count("*").alias("n_samples"))
    return got.crossJoin(F.broadcast(total)).withColumn("coverage", F.coalesce(F.col("n_evaluated") / F.nullif("n_samples", F.lit(0)), F.lit(0.0)))
