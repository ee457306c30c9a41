"""Running sums and ranks over all rows of a table, by range partitions and their totals; no window over one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .split import kept


def running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with the running sum of each of ``sums``, the row itself included. ``order`` must be total; sums are of whole numbers.

    Rows are dealt out by ranges of the order and kept; a row for each partition holds what stands before it."""
    values = {f"_v{k}": c.cast("long") for k, c in enumerate(sums.values())}
    ranged = df.withColumns(values).repartitionByRange(*order).sortWithinPartitions(*order)
    # that id is the partition, and below it 33 bits of the row's place in the partition
    placed = kept(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before{v}") for v in values))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_in{v}": F.sum(v).over(inside) for v in values})
    joined = summed.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *((F.col(f"_in{v}") + F.col(f"_before{v}")).alias(name) for v, name in zip(values, sums, strict=True)))


def overall_accuracy(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """E6 over all rows, in one row: positives, negatives and the share of (positive, negative) pairs in the right order, ties for one
    half. Rows are summed by score first, so no tie crosses a partition. NULL scores are lowest and tie with each other."""
    y = F.coalesce(positive.cast("long"), F.lit(0))
    per = df.groupBy(F.col(score).alias("_score")).agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"))
    ranked = running(per, [F.asc_nulls_first("_score")], {"_upto": F.col("_n")})
    won = F.col("_p").cast("double") * (F.col("_upto") - F.col("_n") / 2)
    out = ranked.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("_n"), F.lit(0)).alias("negatives"), F.sum(won).alias("_w"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select("positives", "negatives", F.when(pairs > 0, F.col("_w") / pairs).alias("accuracy"))


def overall_precision(df: DataFrame, score: str, positive: Column, order: Sequence[Column]) -> DataFrame:
    """E6 over all rows, in one row: positives and the mean precision at them, rows in descending score, ties by ``order``."""
    y = F.coalesce(positive.cast("long"), F.lit(0))
    ranked = running(df.withColumn("_y", y), [F.desc(score), *order], {"_rank": F.lit(1), "_hits": F.col("_y")})
    return ranked.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("positives"), F.avg(F.when(F.col("_y") == 1, F.col("_hits") / F.col("_rank"))).alias("average_precision"))


def _shared_out(size: int, count: int, filled: list[int], share: list[float]) -> list[int]:
    """How many of ``count`` items of one size each bin takes, one after the other to the bin that is least full with it."""
    level, taken = _level(size * count, filled, share), []
    for f, s in zip(filled, share, strict=True):  # what lies surely below the common level; the rest, a few, one by one
        taken.append(max(0, int((level * s - f) // size) - 1))
    while sum(taken) > count:  # rounding
        taken = [max(0, t - 1) for t in taken]
    for _ in range(count - sum(taken)):
        best = min(range(len(share)), key=lambda j: ((filled[j] + (taken[j] + 1) * size) / share[j], j))
        taken[best] += 1
    return taken


def _level(amount: float, filled: list[int], share: list[float]) -> float:
    """The level to which an amount fills bins of these widths: the lowest are filled up first."""
    low = sorted((f / s, f, s) for f, s in zip(filled, share, strict=True))
    f_sum = s_sum = 0.0
    for k, (_, f, s) in enumerate(low):
        f_sum, s_sum = f_sum + f, s_sum + s
        level = (amount + f_sum) / s_sum
        if k + 1 == len(low) or level <= low[k + 1][0]:
            return level
    return 0.0


def filled_bins(parts: DataFrame, label: str, size: str, ratios: Mapping[str, float]) -> DataFrame:
    """(label, size, split): the largest first, ties by label, each to the split that it fills least against its share, ties in the order of
    ``ratios``. Sizes are whole numbers above 0, labels unique.

    Items of one size are a run. The k-th item of a run that a split takes raises it to (filled + k * size) / share, so the run's items go
    to the splits in the order of these numbers. The driver sees the histogram of sizes only and finds how many of each run a split takes; the
    numbers and the items are ranked in range partitions, and meet by rank."""
    spark = parts.sparkSession
    runs = parts.groupBy(F.col(size).cast("long").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()  # distinct sizes: at most the root of twice their sum
    names, total = list(ratios), sum(r["n"] * r["k"] for r in runs)
    share = [max(total * ratios[s] / sum(ratios.values()), 1.0) for s in names]
    filled, rows = [0] * len(names), []
    for r in runs:
        taken = _shared_out(r["n"], r["k"], filled, share)
        rows += [(r["n"], j, filled[j], t, share[j]) for j, t in enumerate(taken) if t]
        filled = [f + t * r["n"] for f, t in zip(filled, taken, strict=True)]
    turns = spark.createDataFrame(rows, "n long, bin int, filled long, taken long, share double")
    step = 4096
    blocks = turns.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(taken - 1) div {step}"))))
    each = blocks.withColumn("_k", F.explode(F.sequence(F.col("_block") * step + 1, F.least(F.col("taken"), (F.col("_block") + 1) * step))))
    offers = each.select("n", "bin", ((F.col("filled") + F.col("_k") * F.col("n")) / F.col("share")).alias("level"), "_k")
    placed = running(offers, [F.desc("n"), F.asc("level"), F.asc("bin"), F.asc("_k")], {"_rank": F.lit(1)}).select("_rank", "bin")
    items = running(parts.select(label, F.col(size).cast("long").alias(size)), [F.desc(size), F.asc(label)], {"_rank": F.lit(1)})
    split = F.element_at(F.array(*(F.lit(s) for s in names)), F.col("bin") + 1)
    return items.join(placed, "_rank").select(label, size, split.alias("split"))
