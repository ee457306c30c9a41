"""Aggregations: replicate collapse, profiles, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import frequent, hash_sample


def distinct_text(c: str) -> Column:
    """Distinct non-empty values of a text column."""
    return F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit("")))


def replicates(df: DataFrame, keys: Sequence[str], value: str, evidence: Sequence[str] = (), first: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """A1, A2: one row per key: median, mean, min, max, range and number of values, distinct evidence, and attributes of
    the row that comes first by ``order``."""
    v = F.col(value)
    made = [
        F.median(v).alias("median_value"), F.avg(v).alias("mean_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        (F.max(v) - F.min(v)).alias("value_range"), F.count(v).alias("n_values"), *(distinct_text(c).alias(f"n_{c}") for c in evidence),
    ]
    if first:
        made.append(F.min_by(F.struct(*first), F.col(order)).alias("_first"))
    out = df.groupBy(*keys).agg(*made)
    return out.select(*(c for c in out.columns if c != "_first"), *((F.col("_first")[c].alias(c)) for c in first)) if first else out


def supported_replicates(df: DataFrame, molecule: str, endpoint: str, keys: Sequence[str], value: str, supported: Column, least: int) -> DataFrame:
    """A3: replicates of the supported endpoints (NULL: not supported), for molecules with ``least`` different ones or more. A molecule
    is judged on the collapsed rows, which are fewer than the observations."""
    collapsed = replicates(df.filter(supported), [molecule, endpoint, *keys], value)
    enough = collapsed.groupBy(molecule).agg(F.count_distinct(endpoint).alias("_n")).filter(F.col("_n") >= least).select(molecule)
    return collapsed.join(enough, molecule, "left_semi")


def profiled_replicates(df: DataFrame, molecule: str, endpoint: str, keys: Sequence[str], value: str, observation: str, assay: str, least: int) -> DataFrame:
    """A5: replicates with their distinct observation and assay ids, for molecules with ``least`` different endpoints or more, and with the
    molecule's profile: for each endpoint its median over all keys and its observations. Rows without a molecule or value go; empty ids don't
    count. Ids are part of the result, so a group holds its own."""
    x = df.filter((F.col(molecule).cast("string") != "") & F.col(value).isNotNull() & F.col(endpoint).isNotNull())
    ids = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit(""))))
    per = x.groupBy(molecule, endpoint).agg(F.median(value).alias("median_value"), ids(observation).alias("observations"))
    entry = F.struct(F.col(endpoint).alias("endpoint"), "median_value", "observations")
    profiles = per.groupBy(molecule).agg(F.array_sort(F.collect_list(entry)).alias("profile")).filter(F.size("profile") >= least)
    collapsed = x.groupBy(molecule, endpoint, *keys).agg(F.median(value).alias("median_value"), F.count(value).alias("n_values"), ids(observation).alias("observations"), ids(assay).alias("assays"))
    return collapsed.join(profiles, molecule)


def capped_replicates(df: DataFrame, molecule: str, endpoint: str, value: str, top: int, cap: int, seed: str) -> DataFrame:
    """A4: replicates of the ``top`` endpoints with the most molecules (ties by name), at most ``cap`` molecules of each by a seeded
    hash; the cap is the feature."""
    collapsed = replicates(df, [molecule, endpoint], value)
    largest = frequent(collapsed, endpoint, top).select(endpoint)
    return hash_sample(collapsed.join(F.broadcast(largest), endpoint, "left_semi"), [endpoint], F.col(molecule), cap, seed)


def answer_records(df: DataFrame, keys: Sequence[str], seq: Column, target: str, positive: Column, order: Sequence[Column], negative_order: Sequence[Column], core: str, first: Sequence[str], least: int = 2) -> DataFrame:
    """One row per query with the attributes of its first row by ``seq``, all its cores, and its positives and negatives (rows
    whose ``positive`` is false), each target once (its first row wins), sorted; queries with fewer than ``least`` positives go.
    Empty targets and cores don't count; rows with a NULL ``positive`` give attributes and cores only, and rows with
    a NULL key go."""
    x = df.withColumns({"_seq": seq, "_positive": positive, "_up": F.struct(*order, F.col(target)), "_down": F.struct(*negative_order, F.col(target))})
    one = x.filter(F.col(target).cast("string") != "").filter(F.col("_positive").isNotNull()).groupBy(*keys, "_positive", target).agg(F.min_by(F.struct("_up", "_down"), "_seq").alias("_a"))
    listed = lambda which, c: F.transform(F.array_sort(F.collect_list(F.when(which, F.col(f"_a.{c}")))), lambda a: a[target])
    answers = one.groupBy(*keys).agg(listed(F.col("_positive"), "_up").alias("positives"), listed(~F.col("_positive"), "_down").alias("negatives")).filter(F.size("positives") >= least)
    whole = x.groupBy(*keys).agg(F.min_by(F.struct(*first), "_seq").alias("_first"), F.array_sort(F.collect_set(F.when(F.col(core) != "", F.col(core)))).alias("cores"))
    return answers.join(whole, list(keys)).select(*keys, *(F.col("_first")[c].alias(c) for c in first), "cores", "positives", "negatives")


def profiles(df: DataFrame, molecule: str, endpoint: str, value: str, least: int = 1) -> DataFrame:
    """Median per molecule and endpoint, for molecules with ``least`` endpoints or more."""
    medians = df.groupBy(molecule, endpoint).agg(F.median(value).alias("median_value"))
    enough = medians.groupBy(molecule).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(molecule)
    return medians.join(enough, molecule, "left_semi")


def profile_maps(profile: DataFrame, molecule: str, endpoint: str) -> DataFrame:
    """Molecule with a map from endpoint to median."""
    return profile.groupBy(molecule).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(endpoint, "median_value")))).alias("profile"))


def groups_of(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Groups with at least so many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def endpoint_summary(df: DataFrame, endpoint: str, molecule: str, value: str, bucket: str, kind: str, censored: Column) -> DataFrame:
    """A10: counts, distinct sets, conditional counts, order statistics, the most frequent type (ties by name) and the joined set of types."""
    kinds = df.groupBy(endpoint, kind).agg(F.count("*").alias("_n"))
    mode = kinds.groupBy(endpoint).agg(F.min_by(kind, F.struct(-F.col("_n"), F.col(kind))).alias("mode_type"), F.array_join(F.array_sort(F.collect_set(kind)), "|").alias("types"))
    stats = df.groupBy(endpoint).agg(
        F.count("*").alias("n_rows"), F.count_distinct(molecule).alias("n_molecules"), F.count_distinct(bucket).alias("n_buckets"),
        F.count_if(censored).alias("n_censored"), F.min(value).alias("min_value"), F.median(value).alias("median_value"), F.max(value).alias("max_value"),
    )
    return stats.join(mode, endpoint)


def first_wins_summary(df: DataFrame, endpoint: str, molecule: str, bucket: str, value: str, attributes: Sequence[str], seq: str) -> DataFrame:
    """Counts, distinct molecules and buckets, the range of values, and the attributes of each endpoint's first row by ``seq``."""
    g = df.groupBy(endpoint).agg(
        F.count("*").alias("n_rows"), F.count_distinct(molecule).alias("n_molecules"), F.count_distinct(bucket).alias("n_buckets"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.min_by(F.struct(*attributes), seq).alias("_first"),
    )
    return g.select(*(c for c in g.columns if c != "_first"), *(F.col("_first")[c].alias(c) for c in attributes))


def group_size_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest, median and largest group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"))


def macro_micro(df: DataFrame, source: str, value: str) -> DataFrame:
    """Mean of the sources' means beside the mean of all rows, from one pass and one small pass."""
    per = df.groupBy(source).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return per.agg(F.count("*").alias("sources"), F.avg(F.col("_s") / F.col("_n")).alias("macro"), (F.sum("_s") / F.sum("_n")).alias("micro"))


def with_counts(dimension: DataFrame, facts: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A dimension with the number of its facts, 0 where there is none."""
    return dimension.join(facts.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
