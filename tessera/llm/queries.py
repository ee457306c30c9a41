"""The queries of this subpackage, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, extraction, jaccard, negatives, neighbours, packing, pieces, quality, resampling, scoring, substring, toxicity, urls
from .oracles import ORACLES
from .session import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(column: str, n: int):  # noqa: ANN201
    return F.expr(f"crc32(cast(cast({column} as string) as binary)) % {n}")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = chat.read_back(chat.windows(told.unionByName(more)))
    return read.select("conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))[0]


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(fold("doc_id", 5) != 0))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), with_ids=False)


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return negatives.mine(told, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat, op2_packing, op3_substring, op4_neighbours, op5_quality, op6_jaccard, op7_toxicity, op8_extraction, op9_pieces, op10_scoring, op11_resampling, op12_urls, op13_negatives)
}

__all__ = ["ORACLES", "QUERIES"]
