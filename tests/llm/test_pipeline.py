"""The corpus pipeline, stage by stage, against restatements on each stage's own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import MIDDLE, brute_components, brute_repeats, check_pieces, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    from tessera.llm.session import stored

    out = [spark.read.parquet(f"{MIDDLE}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], MIDDLE)))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "jaccard_join", "substring_dedup", "packing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])
    counts = [s.count() for s in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0


def test_filters_keep_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    good = stages[0].join(labels, "doc_id").filter("quality = 1 and toxic = 0").select("doc_id", F.size(F.split("text", r"\s+")).alias("n")).filter("n >= 60")
    kept = good.join(stages[2].select("doc_id"), "doc_id", "left_semi")
    assert kept.count() > 0.95 * good.count()


def test_near_duplicates(stages):
    groups = brute_components(texts(stages[2]))
    assert {d for d, _ in texts(stages[3])} == {d for d, _, c in groups if d == c}


def test_repeats(stages):
    want = {d: (n, gone) for (d, n, gone, _) in brute_repeats(texts(stages[3]))}
    after = dict(texts(stages[4]))
    before = dict(texts(stages[3]))
    assert set(after) == set(want)
    for d, (n, gone) in want.items():
        assert len(words(after[d])) == n - gone
        if not gone:
            assert after[d] == before[d]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect() if want[r["doc_id"]][1])


def test_packing(stages):
    assert check_pieces(stages[5].collect(), texts(stages[4])) > 0.97


def test_odd_documents(spark):
    """Nulls everywhere, repeated rows and columns whose names clash with the operators' own."""
    base = " ".join(f"word{i} and the of in" for i in range(60))
    rows = [(1, base, "en", "a", 1, "k", 0.5), (1, base, "en", "a", 1, "k", 0.5), (2, base + " tail", None, None, None, None, None), (3, None, None, None, None, None, None), (None, base, "en", "a", 1, None, None), (4, "", "en", "", 0, "", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, MIDDLE)
        assert docs.columns == [*COLUMNS, "kept", "score"]
    got = Counter(r["doc_id"] for r in docs.collect())
    assert got[1] == 1 and 2 not in got and 3 not in got and got[None] <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, MIDDLE).count() > 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, MIDDLE)
    assert none.count() == 0


def test_texts_of_one_doc_id_are_judged_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, b), (2, c), (2, a), (3, c + " tail"), (4, b), (2, c), (None, a)], "doc_id long, text string").withColumns({"lang": F.lit("en")})
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_stage(spark, docs, MIDDLE).collect())
    assert got == Counter([(1, a), (2, b), (2, c), (None, a)])
