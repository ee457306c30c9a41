"""Rank and calibration metrics of predictions against answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_metrics(queries: DataFrame, ranked: DataFrame, answers: DataFrame, k: int = 10, tasks: int | None = None) -> DataFrame:
    """Per query success, mrr, ndcg and diversity at k. ``ranked``: query_id, pos (from 1), item; ``answers``: query_id,
    item, gain (the last duplicate of an item must be chosen before); queries without predictions score 0. ``tasks``: in how many
    partitions rows are dealt out; without it as many as Spark's setting says, whatever their number."""
    dealt = (lambda x, *keys: x.repartition(tasks, *keys)) if tasks else (lambda x, *keys: x)
    top = dealt(ranked.filter(F.col("pos") <= k).select("query_id", "pos", "item"), "query_id", "item")
    known = answers.select("query_id", "item", "gain")
    hits = top.join(dealt(known, "query_id", "item"), ["query_id", "item"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    dcg = F.sum(F.col("gain") / F.log2(F.col("pos") + 1))
    got = dealt(hits, "query_id").groupBy("query_id").agg(F.max((F.col("gain") > 0).cast("int")).alias("success"), F.min(F.when(F.col("gain") > 0, F.col("pos"))).alias("_first"), dcg.alias("_dcg"), (F.count_distinct("item") / F.count("*")).alias("diversity"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item"))
    ideal = dealt(known, "query_id").withColumn("pos", place).filter(F.col("pos") <= k).groupBy("query_id").agg(dcg.alias("_ideal"))
    out = dealt(queries.select("query_id"), "query_id").join(got, "query_id", "left").join(ideal, "query_id", "left")
    zero = F.lit(0.0)
    return out.select("query_id", F.coalesce("success", F.lit(0)).alias("success"), F.coalesce(1 / F.col("_first"), zero).alias("mrr"), F.coalesce(F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")), zero).alias("ndcg"), F.coalesce("diversity", zero).alias("diversity"))


def prediction_summary(queries: DataFrame, ranked: DataFrame, answers: DataFrame, k: int = 10) -> DataFrame:
    """E1-E3 over all queries, in one row. ``ranked``: query_id, pos (from 1), item (NULL if the structure is invalid); ``answers``:
    query_id, item, seq, confidence, success, experimental, scaffold_retained. The last answer of an item is its match, the ideal
    order counts every answer; queries without predictions score 0, predictions without a query are only counted."""
    known = queries.select("query_id").distinct()
    top = ranked.filter(F.col("pos") <= k).join(known, "query_id", "left_semi")
    valid = answers.filter(F.col("item").isNotNull())
    last = valid.groupBy("query_id", "item").agg(F.max_by(F.struct("confidence", "success", "experimental", "scaffold_retained"), "seq").alias("m"))
    hits = top.join(last, ["query_id", "item"], "left").withColumn("gain", F.when(F.coalesce("m.success", F.lit(True)), F.coalesce("m.confidence", F.lit(0.0))).otherwise(0.0))
    dcg = F.sum(F.col("gain") / F.log2(F.col("pos") + 1))
    seen = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    per = hits.groupBy("query_id").agg(
        F.max((F.col("gain") > 0).cast("int")).alias("success"), seen("m.experimental").alias("fidelity"), seen("m.scaffold_retained").alias("scaffold"),
        (F.count_distinct("item") / F.count("*")).alias("diversity"), (1 / F.min(F.when(F.col("gain") > 0, F.col("pos")))).alias("mrr"), dcg.alias("_dcg"), F.count("*").alias("_n"), F.count("item").alias("_valid"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence")))
    ideal = valid.select("query_id", F.col("confidence").alias("gain"), "confidence").withColumn("pos", place).filter(F.col("pos") <= k).groupBy("query_id").agg(dcg.alias("_ideal"))
    out = known.join(per, "query_id", "left").join(ideal, "query_id", "left").withColumn("ndcg", F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")))
    mean = [F.avg(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("success", "fidelity", "scaffold", "diversity", "mrr", "ndcg")]
    total = out.agg(F.count("*").alias("n_queries"), F.count_if(F.col("_n").isNull()).alias("missing"), (F.sum("_valid") / F.sum("_n")).alias("validity"), *mean)
    unique = top.agg((F.count_distinct("item") / F.nullif(F.count("item"), F.lit(0))).alias("uniqueness"))
    extra = ranked.join(known, "query_id", "left_anti").agg(F.count_distinct("query_id").alias("extra"))
    # three tables of one row
    return total.crossJoin(F.broadcast(unique)).crossJoin(F.broadcast(extra)).fillna(0.0)


def pairwise_baselines(df: DataFrame, scores: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """For heuristics given as (score of the positive, score of the negative) the share of pairs in the right order, ties and
    missing scores for one half, beside the 0.5 of chance; one pass for all of them."""
    right = {name: F.when(a > b, 1.0).when(a < b, 0.0).otherwise(0.5) for name, (a, b) in scores.items()}
    return df.agg(F.count("*").alias("pairs"), *(F.avg(c).alias(name) for name, c in right.items())).withColumn("chance", F.lit(0.5))


def calibration_bins(df: DataFrame, confidence: str, outcome: str, bins: int = 10) -> DataFrame:
    """Per bin its rows, mean confidence and accuracy, and the share of |difference| in the error; values outside 0 to 1 count
    in the denominator only."""
    total = df.agg(F.count(confidence).alias("_total"))
    inside = df.filter(F.col(confidence).between(0, 1)).withColumn("bin", F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int"))
    per = inside.groupBy("bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(outcome).cast("double")).alias("accuracy"))
    return per.crossJoin(F.broadcast(total)).select("bin", "n", "mean_confidence", "accuracy", (F.col("n") / F.col("_total") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("ece_part"))


def pairwise_accuracy(df: DataFrame, group: str, score: str, positive: Column) -> DataFrame:
    """Per group the share of (positive, negative) pairs in the right order, ties for one half, by ranks instead of pairs."""
    ranked = df.withColumn("_pos", positive.cast("int"))
    w = Window.partitionBy(group).orderBy(score)
    below = F.sum(1 - F.col("_pos")).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ties = F.sum(1 - F.col("_pos")).over(w.rangeBetween(0, 0))
    ranked = ranked.withColumn("_won", F.when(F.col("_pos") == 1, below - ties / 2))
    return ranked.groupBy(group).agg(F.sum("_pos").alias("positives"), F.sum(1 - F.col("_pos")).alias("negatives"), F.sum("_won").alias("_w")).filter("positives > 0 and negatives > 0").select(group, "positives", "negatives", (F.col("_w") / (F.col("positives") * F.col("negatives"))).alias("accuracy"))


def average_precision(df: DataFrame, score: str, positive: Column, order: str, group: str | None = None) -> DataFrame:
    """Mean precision at the positives, rows in descending score (ties by ``order``); per ``group``, if there is one."""
    keys = [group] if group else []
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    ranked = df.withColumn("_pos", positive.cast("int")).withColumn("_rank", F.row_number().over(w)).withColumn("_hits", F.sum("_pos").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter("_pos = 1").groupBy(*keys).agg(F.count("*").alias("positives"), F.avg(F.col("_hits") / F.col("_rank")).alias("average_precision"))


def candidate_metrics(df: DataFrame, query: str, score: str, positive: Column, order: str, k: int = 5) -> DataFrame:
    """E5: hit@1, recall@k, all-gold@k and reciprocal rank of scored candidates; score ties keep their first order."""
    ranked = df.withColumn("_pos", positive.cast("int")).withColumn("_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), order)))
    found = F.sum(F.when(F.col("_rank") <= k, F.col("_pos")).otherwise(0))
    per = ranked.groupBy(query).agg(F.sum("_pos").alias("gold"), F.max(F.when(F.col("_rank") == 1, F.col("_pos")).otherwise(0)).alias("hit1"), found.alias("found"), F.min(F.when(F.col("_pos") == 1, F.col("_rank"))).alias("_first"))
    return per.filter("gold > 0").select(query, "gold", "hit1", (F.col("found") / F.col("gold")).alias("recall"), (F.col("found") == F.col("gold")).cast("int").alias("all_gold"), (1 / F.col("_first")).alias("reciprocal_rank"))
