"""From raw documents to packed sequences: quality, toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last returns the pieces of packed sequences. ``run`` writes each stage's result to the shared folder
and reads it again, so a lost executor costs one stage at most.

Null doc_ids pass through the duplicate stages untouched; null texts have no words and fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import jaccard, packing, quality, substring, toxicity
from tessera.llm.session import stored, table
from tessera.operators import ordered

#: Packing on by this tokenizer of the installed public files.
TOKENIZER = "word_bpe_49k.json"

_NEEDED = ("doc_id", "text", "lang")


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """Columns that no operator reads get names that clash with nothing; and the way back."""
    names = {c: c if c in _NEEDED else f"_other_{k}" for k, c in enumerate(docs.columns)}
    return docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, back = _aside(docs)
    return quality.judge(rows).filter("kept").select(back)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    rows, back = _aside(docs)
    return toxicity.score(rows, toxicity.train(rows, table(spark, sf_dir, "labels"))).filter("predicted = 0").select(back)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates, once; different texts of one doc_id are different documents."""
    rows, back = _aside(docs)
    keyed = rows.filter("doc_id is not null").withColumn("_h", F.xxhash64("text"))
    keys = keyed.select("doc_id", "_h").distinct()
    if keys.groupBy("doc_id").count().filter("count > 1").isEmpty():
        nodes = keyed.withColumn("_node", F.col("doc_id"))
    else:  # numbers in the order of doc_ids
        numbers = stored(ordered.running(keys, [F.asc("doc_id"), F.asc("_h")], {"_node": F.lit(1)}))
        nodes = stored(keyed.join(numbers, ["doc_id", "_h"]))
    stay = jaccard.join_classes(nodes.select(F.col("_node").alias("doc_id"), "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    kept = nodes.join(stay, nodes["_node"] == stay["_stay"]).withColumn("_r", F.row_number().over(Window.partitionBy("_node").orderBy("_h")))
    return kept.filter("_r = 1").select(back).unionByName(rows.filter("doc_id is null").select(back))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that a smaller document has; n_chars follows the text."""
    rows, back = _aside(docs)
    cut = substring.remove_repeats(rows).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    out = cut.select(*back, F.col("n_removed").alias("_n_removed"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't express trained models and a tokenizer; the tests restate the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
