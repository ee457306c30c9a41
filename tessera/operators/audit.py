"""Validation: reject chains with counters, rules that give a table of violations, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that holds, else NULL: one pass gives the kept rows and a counter for every reason."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in rules))


def violations(df: DataFrame, row_id: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """V1: (row_id, rule) for every rule that a row breaks: rules are an array per row, so the rows are read once."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules)))
    return df.select(F.col(row_id).cast("string").alias("row_id"), F.explode(broken).alias("rule"))


def schema_rules(schema: Mapping) -> list[tuple[str, Column]]:
    """V7: rules for ``violations`` from a JSON schema: required (present, not NULL), const and enum; a NULL breaks
    its required rule only."""
    rules = [(f"required:{name}", F.col(name).isNull()) for name in schema.get("required", ())]
    for name, rule in schema.get("properties", {}).items():
        if "const" in rule:
            rules.append((f"const:{name}", F.col(name) != F.lit(rule["const"])))
        if "enum" in rule:
            rules.append((f"enum:{name}", ~F.col(name).isin(*rule["enum"])))
    return rules


def split_statistics(df: DataFrame, split: str, kind: str, molecules: Sequence[str], endpoint: str) -> DataFrame:
    """V6: per split its rows, positives, negatives, molecules (over several columns, empty ones apart) and endpoints."""
    counts = df.groupBy(split).agg(F.count("*").alias("rows"), F.count_if(F.col(kind) == "positive").alias("positive"), F.count_if(F.col(kind) == "negative").alias("negative"), F.count_distinct(endpoint).alias("unique_endpoints"))
    every = df.select(split, F.explode(F.array(*(F.col(m).cast("string") for m in molecules))).alias("m")).filter("m <> ''")
    return counts.join(every.groupBy(split).agg(F.count_distinct("m").alias("unique_molecules")), split, "left").fillna(0, ["unique_molecules"])


def prompt_audit(df: DataFrame, split: str, source: str, messages: str, most: float = 0.6) -> DataFrame:
    """V5: rows and prompt lengths of each split and source, and whether one source has more than ``most`` of its split.
    ``messages`` is an array of structs with a content; NULL contents and lists count 0 characters."""
    chars = F.aggregate(F.coalesce(F.transform(messages, lambda m: F.coalesce(F.length(m["content"]), F.lit(0))), F.array().cast("array<int>")), F.lit(0), lambda a, b: a + b)
    per = df.withColumn("_chars", chars).groupBy(split, F.coalesce(F.col(source), F.lit("unknown")).alias(source)).agg(F.count("*").alias("rows"), F.avg("_chars").alias("mean_prompt_chars"), F.max("_chars").alias("max_prompt_chars"))
    total = per.groupBy(split).agg(F.sum("rows").alias("_total"), F.count("*").alias("_sources"))
    return per.join(total, split).withColumn("imbalanced", (F.col("_sources") > 1) & (F.col("rows") > most * F.col("_total"))).drop("_total", "_sources")


def shape_audit(df: DataFrame, counts: Sequence[tuple[str, str, int]], texts: Sequence[str], direction: str, delta: str) -> DataFrame:
    """V3: one row: per (number, JSON list, wanted) how often the number is another and how often the list's length is; per text how
    often it is NULL or empty; changes against the direction. A list that is no JSON array has the wrong length."""
    made = [F.count("*").alias("rows")]
    for number, listed, wanted in counts:
        made.append(F.count_if(~F.col(number).eqNullSafe(wanted)).alias(f"not_{wanted}_{number}"))
        made.append(F.count_if(F.coalesce(F.json_array_length(F.col(listed)), F.lit(-1)) != wanted).alias(f"length_{listed}"))
    made += [F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"empty_{c}") for c in texts]
    wrong = F.coalesce(F.when(F.col(direction) == "decrease", F.col(delta) >= 0).otherwise(F.col(delta) <= 0), F.lit(True))
    return df.agg(*made, F.count_if(wrong).alias("wrong_direction"))


def duplicates(df: DataFrame, key: str | Sequence[str], rule: str) -> DataFrame:
    """Keys of more than one row; the columns of a key are joined by ``|``."""
    keys = [key] if isinstance(key, str) else list(key)
    row_id = F.col(keys[0]).cast("string") if len(keys) == 1 else F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(row_id.alias("row_id"), F.lit(rule).alias("rule"))


def orphans(child: DataFrame, parent: DataFrame, key: str, row_id: str, rule: str) -> DataFrame:
    """Children without a parent."""
    return child.join(parent.select(key), key, "left_anti").select(F.col(row_id).cast("string").alias("row_id"), F.lit(rule).alias("rule"))


def leaks(df: DataFrame, key: str, split: str, rule: str) -> DataFrame:
    """V2: keys in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("_n")).filter("_n > 1").select(F.col(key).cast("string").alias("row_id"), F.lit(rule).alias("rule"))


def counted(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("rule").agg(F.count("*").alias("n"))


def branches(df: DataFrame, relation: str) -> tuple[DataFrame, DataFrame]:
    """(observations, exact): every row goes to the observations, rows of the relation ``=`` alone to what is ranked."""
    return df, df.filter(F.coalesce(F.col(relation) == "=", F.lit(False)))


def looked_up(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their key; a key that isn't known is an error, raised by the task that meets it."""
    found = rows.join(known.withColumn("_known", F.lit(True)), key, "left")
    miss = F.raise_error(F.concat(F.lit(f"no {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    # the check stands in a column that stays, so it can't be pruned away
    return found.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(miss.cast(rows.schema[key].dataType))).drop("_known")
