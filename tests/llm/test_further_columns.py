"""Every operator on tables with further columns that bear the names of its own, and on empty ones: the same rows as without them."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, extraction, jaccard, negatives, neighbours, packing, pieces, quality, resampling, scoring, substring, toxicity, urls
from tessera.llm.queries import _tokenizer

DOCS = [(k, f"word{k % 5} and some other words of row {k} " * 6, "en") for k in range(12)] + [(20, None, None), (21, "", "en"), (None, "no id here", "en")]
TEXT = "doc_id long, text string, lang string"
#: Names that the operators use inside.
CLASH = "host part key kind rank rule verdict node block word n h w seg rk places ids offset open sequence_id nth label q turns sums upto cost body name score_ n_ list m token set text_ page html_ stream slot slots wrapper keys counts".split()


def crowded(df):
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH) if c not in df.columns))


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, TEXT).repartition(2)


OPERATORS = {
    "packing": lambda d: packing.pack(d, _tokenizer("word_bpe_49k.json")).groupBy("doc_id", "length", "ids_crc32").count(),
    "substring": lambda d: substring.remove_repeats(d).select("doc_id", "n_words", "n_removed", "kept_text"),
    "quality": lambda d: quality.judge(d).select("doc_id", "n_words", "base_failed", "kept"),
    "jaccard": lambda d: jaccard.join_classes(d),
    "toxicity": lambda d: toxicity.score(d, None).select("doc_id", "score", "predicted"),
    "pieces": lambda d: pieces.encode(d, _tokenizer("piece_bpe_32k.model")),
    "scoring": lambda d: scoring.score(d, F.col("doc_id") % 2 == 0).select("doc_id", "n_tokens", "n_known", F.round("score", 6)),
    "resampling": lambda d: resampling.resample(d, d.select("text"), 50, 5),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(docs, name):
    assert rows(OPERATORS[name](crowded(docs))) == rows(OPERATORS[name](docs))
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_conversations(spark):
    told = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert rows(chat.windows(crowded(told))) == rows(chat.windows(told))
    assert chat.read_back(chat.windows(told.limit(0))).count() == 0


def test_vectors(spark):
    found = spark.createDataFrame([(k, [float(k % 3), 1.0, 0.5 * (k % 2)], k % 2) for k in range(30)], "vec_id long, embedding array<float>, label int")
    assert rows(neighbours.near_duplicates(crowded(found))[0]) == rows(neighbours.near_duplicates(found)[0])
    assert neighbours.near_duplicates(found.limit(0))[0].count() == 0
    assert rows(negatives.mine(crowded(found), F.col("vec_id") % 5 == 0)) == rows(negatives.mine(found, F.col("vec_id") % 5 == 0))


def test_pages(spark):
    found = spark.createDataFrame([(k, f"http://a.org/es/{k}", f"<article><p>Text {k}</p></article>") for k in range(5)] + [(9, None, None)], "page_id long, url string, html string")
    assert rows(extraction.extract(crowded(found))) == rows(extraction.extract(found))
    assert extraction.extract(found.limit(0)).count() == 0
    assert rows(urls.judge(crowded(found), urls.rules_table(spark))) == rows(urls.judge(found, urls.rules_table(spark)))
