"""Packing, substring dedup, quality, Jaccard join and toxicity against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import jaccard, packing, quality, substring, toxicity
from tessera.llm.queries import QUERIES, _tokenizer
from tessera.llm.text import Words

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string"


def words(text):
    return WORD.findall(text or "")


def odd_rows():
    base = " ".join(f"w{i}" for i in range(120))
    return [
        (1, base, "en", "a", 1, "x"),
        (2, base, "en", "a", 1, None),
        (2, base, "en", "a", 1, None),
        (3, base.replace("w7 ", "W7\n"), None, None, None, None),
        (4, "", "en", "a", 0, None),
        (5, None, "en", "a", None, None),
        (6, " \n\t ", "xx", "a", 3, None),
        (7, "one two three", "en", "a", 3, None),
        (8, "One two\x0bthree", "en", "a", 3, None),
        (9, "same " * 3000, "en", "a", 3, None),
        (10, "x " * 20 + base[100:420] + " tail", "en", "b", 3, None),
        (11, "<|endoftext|> é ü 日本語 \U0001f600 end", "en", "b", 3, None),
        (12, "line a\nline a\n\n\nline b\r\nline b\r\nidiot scum", "en", "b", 3, None),
        (None, base, "en", "b", 3, None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(folder):
    t = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


# substring


def brute_repeats(rows):
    least = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if doc is not None:
                least[key] = min(least.get(key, doc), doc)
    out = Counter()
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - 49):
            if doc is not None and least[tuple(w[i : i + 50])] < doc:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_substring_query(spark):
    got = as_counter(QUERIES["op3_substring"](spark, MIDDLE).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == brute_repeats(texts(MIDDLE))


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_odd_rows(spark, odd, empty, batches):
    got = substring.remove_repeats(odd, batches=batches)
    assert got.columns[:6] == odd.columns
    rows = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.collect())
    assert rows == brute_repeats([r[:2] for r in odd_rows()])
    assert substring.remove_repeats(empty, batches=batches).count() == 0


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_copies_in_one_document(spark, batches):
    """A block that a document, or another text of the same doc_id, holds again loses the passage at every place."""
    part = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = []
    for k in range(0, 300, 10):
        passage, block = part(f"p{k}_", 60), f"{part(f'x{k}_', 40)} {part(f'p{k}_', 60)} {part(f'y{k}_', 40)}"
        rows += [(k, f"{part(f'u{k}_', 30)} {passage} {part(f'v{k}_', 30)}"), (k + 1, f"{block} {part(f'm{k}_', 5)} {block}"), (k + 2, f"{block} alone"), (k + 3, f"a{k} {passage} z{k}"), (k + 3, f"b{k} {passage} c{k} {passage}")]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.collect()) == brute_repeats(rows)


def test_index_is_incremental(spark, odd):
    index = substring.FingerprintIndex(spark, fanout=2)
    rows = substring.run_rows(odd)
    for doc in (1, 2, 10):
        index.append(rows.filter(f"doc_id = {doc}"))
    assert len(index.runs) < 3  # compacted
    hit = index.probe(rows.filter("doc_id = 3").select("h").distinct())
    assert {r["doc_id"] for r in hit.collect()} <= {1, 2, 10} and hit.count() > 0
    index.drop()
    assert not index.runs


def test_batches_lose_no_window(spark):
    """Documents that come in several calls lose the same words as in one, although earlier texts aren't there any more."""
    draw = random.Random(3)
    pool = [" ".join(f"p{k}_{i}" for i in range(draw.randrange(51, 130))) for k in range(6)]
    rows = []
    for doc in range(40):
        parts = [f"u{doc}_{i}" for i in range(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            passage = draw.choice(pool).split()
            cut = draw.randrange(20)
            parts += passage[cut:] + [f"v{doc}_{draw.randrange(99)}_{i}" for i in range(draw.randrange(25))]
        rows.append((doc, " ".join(parts)))
    want = brute_repeats(rows)
    assert sum(n * k for (_, _, n, _), k in want.items()) > 500
    index, got = substring.FingerprintIndex(spark, fanout=3), Counter()
    cuts = [0, *sorted(draw.sample(range(1, 40), 3)), 40]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = substring.remove_repeats(spark.createDataFrame(rows[a:b], "doc_id long, text string"), batches=1, index=index)
        got += Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in part.collect())
    assert got == want
    index.drop()


def test_substring_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", "b", "c", 1), (2, text, "a", "b", "c", 2)], "doc_id long, text string, ranges string, TEXT_ string, key string, n_removed int")
    got = substring.remove_repeats(docs, batches=1)
    assert got.columns == ["doc_id", "text", "ranges", "TEXT_", "key", "n_words", "n_removed", "kept_text"]
    assert {tuple(r)[2:7] for r in got.collect()} == {("a", "b", "c", 60, 0), ("a", "b", "c", 60, 60)}


# quality


def brute_base(text):
    w = words(text)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again), failed)


def test_quality_query(spark):
    rows = QUERIES["op5_quality"](spark, MIDDLE).collect()
    want = dict(texts(MIDDLE))
    assert len(rows) == len(want)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(want[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    labels = {a: b for a, b in zip(*[pq.read_table(f"{MIDDLE}/labels.parquet").to_pydict()[c] for c in ("doc_id", "quality")], strict=True)}
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0 and not r["base_failed"]]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad)


def test_quality_odd_rows(spark, odd, empty):
    got = quality.judge(odd)
    by = {r["doc_id"]: r for r in got.collect()}
    for row in odd_rows():
        r = by[row[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(row[1])
    assert quality.judge(empty).count() == 0


def brute_distance(p, q):
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    half = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    return math.sqrt(max((half(p) + half(q)) / 2, 0))


def brute_classes(text):
    kinds = [0] * 7
    for c in text:
        k = 6 if ord(c) > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\x0b\f\r" else 4 if c in ".,;:?'\"()-" else 5
        kinds[k] += 1
    return [k / max(sum(kinds), 1) for k in kinds]


def brute_verdict(rows):
    """(js_chars, js_words, kept) by row; no language has more than 40 different words."""
    held = defaultdict(list)
    for _, text, lang in rows:
        held[lang].append(text)
    refs = {}
    for lang, parts in held.items():
        count = Counter(w.lower() for t in parts for w in words(t))
        if lang is not None and count.total() >= quality.MIN_REFERENCE:
            refs[lang] = (brute_classes("".join(parts)), count)
    out = []
    for _, text, lang in rows:
        own = Counter(w.lower() for w in words(text))
        n = own.total()
        chars, near = [], []
        for name, (classes, count) in refs.items():
            if lang in (name, None):
                vocabulary = sorted(count)
                chars.append(brute_distance(brute_classes(text), classes))
                mine = [own[w] / n for w in vocabulary]
                near.append(brute_distance([*mine, 1 - sum(mine) if any(w not in count for w in own) else 0], [*(count[w] / count.total() for w in vocabulary), 0]))
        c, w = min(chars, default=0), min(near, default=0)
        off = (n >= 20 and c > 0.25 + 0.35 / math.sqrt(n)) or (n >= 30 and w > 0.42 + 0.5 / math.sqrt(n))
        out.append((c, w, not off and not brute_base(text)[-1]))
    return out


@pytest.mark.parametrize("at_once", [8192, 1])
def test_quality_verdict(spark, monkeypatch, at_once):
    """A language of few documents has its own reference, one of few words has none, and those without a language take the nearest."""
    monkeypatch.setattr(quality, "PASS", at_once)
    rng = random.Random(5)
    vocabulary = {"en": [f"The{i}" if i % 3 else f"and-{i}," for i in range(30)], "ja": [f"日本{chr(0x3041 + i)}" for i in range(30)], "xx": ["q0", "q1", "q2", "q3", "q4", "q5", "q6"]}

    def text(lang, n):
        return " ".join(rng.choices(vocabulary[lang], weights=range(1, len(vocabulary[lang]) + 1), k=n))

    rows = [(k, text("en", 60), "en") for k in range(400)] + [(1000 + k, text("ja", 60), "ja") for k in range(17)] + [(2000, text("xx", 60), "xx")]
    rows += [(3000 + k, text(lang, 80), None) for k, lang in enumerate(("en", "ja", "xx"))] + [(4000, " ".join(rng.choices(vocabulary["ja"][:9], k=90)), "en"), (4001, "#$% " * 3 + text("xx", 70), "ja")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for (doc, _, _), (c, w, kept) in zip(rows, brute_verdict(rows), strict=True):
        r = got[doc]
        assert abs(r["js_chars"] - c) < 1e-6 and abs(r["js_words"] - w) < 1e-6 and r["kept"] == kept
    assert got[1000]["kept"] and got[2000]["js_words"] == 0 and got[3000]["kept"] and got[3001]["kept"] and not got[4000]["kept"]


def test_js_distance():
    import numpy as np

    p, q = np.array([[0.5, 0.5], [1.0, 0.0]]), np.array([0.5, 0.5])
    d = quality.js_distance(p, q)
    assert d[0] == 0 and abs(d[1] ** 2 - 0.3112781) < 1e-6
    assert quality.js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == 1


# Jaccard join


def brute_components(rows):
    sets = {}
    for doc, text in rows:
        if doc is None:
            continue
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            lists[x].add(d)
    pairs = {(a, b) for v in lists.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(d, len(s), find(d)) for d, s in sets.items()}


def test_jaccard_query(spark):
    got = QUERIES["op6_jaccard"](spark, MIDDLE).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_components(texts(MIDDLE))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_jaccard_long_lists(spark):
    """Groups of near copies whose lists are long, with chains that don't all link to the leader."""
    import random

    rng = random.Random(5)
    rows, base = [], [f"b{i}" for i in range(80)]
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(80)] = f"c{k}_{rng.randrange(10)}"
        rows.append((k, " ".join(w)))
    for k in range(60, 100):  # a passage that all share, with a body of their own
        rows.append((k, " ".join(base[:60] + [f"d{k % 17}_{i}" for i in range(rng.randrange(5, 30))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join_classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in got} == brute_components(rows)


def test_jaccard_odd_rows(spark, odd, empty):
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.join_classes(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7)} <= got
    assert jaccard.join_classes(empty).count() == 0


# packing


def check_pieces(pieces, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_tokenizer("word_bpe_49k.json"))
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            piece = ids[d][at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids[d]) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
            at += p["length"]
        assert at == len(ids[d])
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    return sum(len(x) for x in ids.values()) / (4096 * len(by_sequence))


def test_packing_query(spark):
    assert check_pieces(QUERIES["op2_packing"](spark, MIDDLE).collect(), texts(MIDDLE)) > 0.98


def test_packing_odd_rows(spark, odd, empty):
    once = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack(once.repartition(3), _tokenizer("word_bpe_49k.json"), with_ids=True)
    rows = pieces.collect()
    check_pieces(rows, list(dict((r[0], r[1]) for r in odd_rows() if r[0] is not None).items()))
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(odd, _tokenizer("word_bpe_49k.json")).filter("doc_id = 2").count() >= 2
    assert packing.pack(empty, _tokenizer("word_bpe_49k.json")).count() == 0


def test_packer_emits_the_fullest():
    p = packing.Packer(0, window=100, open_windows=2, min_cut=10)
    assert p.place(60) == [(0, 60, 0, 0)]
    assert p.place(30) == [(0, 30, 0, 60)]  # best fit
    assert p.place(70) == [(0, 70, 1, 0)]
    assert p.place(50) == [(0, 10, 0, 90), (10, 40, 2, 0)]  # the fullest is filled by a head and emitted
    assert p.place(250)[:2] == [(0, 100, 3, 0), (100, 100, 4, 0)]


# toxicity


def test_toxicity_query(spark):
    rows = QUERIES["op7_toxicity"](spark, MIDDLE).collect()
    assert len(rows) == 1000
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_held_out(spark):
    """At sf0.1 the models rank held-out documents well, although many toxic labels have no sign in the text."""
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["score"] for r in QUERIES["op7_toxicity"](spark, folder).filter("held_out").collect()}
    t = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    pairs = [(got[d], y) for d, y in zip(t["doc_id"], t["toxic"], strict=True) if d in got]
    one, zero = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / len(one) / len(zero)
    assert auc > 0.97
    assert sum(s >= 0.5 for s in zero) < 0.012 * len(zero) and sum(s >= 0.5 for s in one) > 0.9 * len(one)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(12, 1), (1, 0), (2, None), (3, 7)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == len(odd_rows())
    assert toxicity.train(odd, labels.filter("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.score(empty, None).count() == 0


def test_toxicity_passes_over_long_texts(spark):
    """Texts beyond the bound, wherever the order has them, leave the sample to those that fit."""
    rows = [(k, "".join("idiot scum " if k % 2 else "fine day ") * (2000 if k < 10 else 5)) for k in range(60)]
    docs = spark.createDataFrame([(k, t, k % 2) for k, t in rows], "doc_id long, text string, toxic int")
    seen = []
    original, toxicity.ToxicityModel = toxicity.ToxicityModel, lambda *args: seen.append(args) or "model"
    try:
        assert toxicity.train(docs, docs.select("doc_id", "toxic"), sample_chars=3000) == "model"
    finally:
        toxicity.ToxicityModel = original
    assert sorted(seen[0][0]) == sorted(t for _, t in rows[10:]) and set(seen[0][1].tolist()) == {0, 1}
    long = docs.filter("doc_id < 10")
    assert toxicity.train(long, long.select("doc_id", "toxic"), sample_chars=3000) is not None


def test_toxicity_equals_plain_models():
    """Evidence against a restatement with dictionaries: two-sided continuation counts of two levels, discounts, shared backoff, means, peaks."""
    draw = random.Random(5)
    common = [f"{x}w{i}" for i, x in enumerate("abcdefghijklmnopqrstuvwx")]
    texts_of = {0: [], 1: []}
    for label in (0, 1):
        for _ in range(300):
            row = [draw.choice(common) for _ in range(20)]
            for _ in range(3):
                row[draw.randrange(20)] = draw.choice(("idiot", "idiotic", "scum") if label else ("kindness", "thanks")) if draw.random() < 0.9 else f"{draw.randrange(400)}r"
            if draw.random() < 0.5:
                row += ["not", "good"] if label else ["very", "good"]
            texts_of[label].append(" ".join(row) if draw.random() < 0.95 else "")
    folds = [k % 3 for k in range(300)]
    model = toxicity.ToxicityModel(texts_of[0] + texts_of[1], np.array([0] * 300 + [1] * 300), np.array(folds * 2))
    by_word, by_pair = model.discount
    assert model.discount in toxicity.DISCOUNTS

    def split(text):
        return [w[: toxicity.STEM] for w in re.findall("[a-z0-9]+", text)]

    sides, shared = [], Counter()
    for label in (0, 1):
        left, right = defaultdict(set), defaultdict(set)
        for text in texts_of[label]:
            seq = [None, *split(text), None]
            for k in range(1, len(seq) - 1):
                left[seq[k],].add(seq[k - 1])
                right[seq[k],].add(seq[k + 1])
                pair = seq[k - 1], seq[k]
                left[pair].add(seq[k - 2] if k > 1 else None)
                right[pair].add(seq[k + 1])
        places = {key: min(len(left[key]), len(right[key])) for key in left}
        words_of, pairs = {k[0]: n for k, n in places.items() if len(k) == 1}, {k: n for k, n in places.items() if len(k) == 2}
        context = Counter()
        for (v, _), n in pairs.items():
            context[v] += n
        sides.append((words_of, pairs, context))
        shared.update(words_of)

    def word(label, w):
        words_of = sides[label][0]
        base = (shared[w] + 0.5) / (sum(shared.values()) + 0.5 * (len(shared) + 1))
        return (max(words_of.get(w, 0) - by_word, 0) + sum(min(n, by_word) for n in words_of.values()) * base) / sum(words_of.values())

    def after(label, v, w):
        _, pairs, context = sides[label]
        if not context[v]:
            return word(label, w)
        freed = sum(min(n, by_pair) for (b, _), n in pairs.items() if b == v)
        return (max(pairs.get((v, w), 0) - by_pair, 0) + freed * word(label, w)) / context[v]

    for label in (0, 1):
        assert 0.9 < sum(word(label, w) for w in shared) < 1.0  # and the rest for the unseen
        assert 0.9 < sum(after(label, "not", w) for w in shared) < 1.0
    cases = ["", "idiot", "aw0 idiot scum not good", "very good thanks", "never seen words here", "not not good", texts_of[0][0], texts_of[1][0], "aw0 bw1 " * 400]
    got, n = model.evidence(pa.array(cases, pa.string()))
    for text, (mean, peak), tokens in zip(cases, got.tolist(), n.tolist(), strict=True):
        seq = split(text)
        assert tokens == len(seq)
        x = [math.log(after(1, v, w) / after(0, v, w)) for v, w in zip([None, *seq], seq, strict=False)]
        size = toxicity.WINDOW
        windows = [sum(x[k : k + size]) for k in range(max(1, len(x) - size + 1))]
        want = (sum(x) / len(x), math.log(sum(math.exp(toxicity.SHARP * s) for s in windows) / len(windows))) if seq else (0, 0)
        assert (mean, peak) == pytest.approx(want, rel=1e-9, abs=1e-9)
    s = model.score(pa.array(["idiot scum", "very good thanks", ""], pa.string()))
    assert s[0] > 0.9 and s[1] < 0.1 and s[2] <= 0.49


def test_toxicity_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 3)], "doc_id long, text string, _text string, TEXT_ string, score int")
    got = toxicity.score(docs, None)
    assert got.columns == ["doc_id", "text", "_text", "TEXT_", "score", "predicted"]
    assert got.collect()[0][:4] == (1, "a b", "x", "y")


# hashes


def test_word_hashes():
    """No structure of the bytes cancels out: Thue-Morse words, zero bytes, common beginnings and every length differ."""
    thue = "a"
    for _ in range(12):
        thue += thue.translate(str.maketrans("ab", "ba"))
    made = ["a", "a\0", "\0", "ab", "ba", thue, thue.translate(str.maketrans("ab", "ba")), *("x" * n for n in range(1, 40)), *("y" * 8 + c * 8 + d for c in "abc" for d in "de")]
    once = Words(pa.array([" ".join(made)])).hashes()
    assert len(set(once.tolist())) == len(made)
    again = Words(pa.array([None, *(f" {w}\n" for w in made)])).hashes()
    assert (once == again).all()
    assert len(set(Words(pa.array([" ".join(made)])).hashes(5).tolist())) == len({w[:5] for w in made})


def test_long_words_do_not_collide(spark):
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, thue), (2, thue.translate(str.maketrans("ab", "ba"))), (3, thue)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join_classes(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_encoder_bounds_its_words_and_keeps_the_first(monkeypatch):
    """Before, up to two million words stayed in a worker, and all of them went at once."""
    assert packing.CACHE_WORDS <= 1_000_000
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    import public_tokenizers

    made = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["the common words", *(" ".join(f"the w{k}x{j}" for j in range(25)) for k in range(12)), "the common words again"]
    for text in texts:
        ids, at = made.encode(pa.array([text, ""]))
        want = made.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == [*want, packing.END, packing.END] and at.tolist() == [0, len(want) + 1, len(want) + 2]
        assert b"the" in made.slot and b"common" in made.slot and len(made.slot) <= 60 + 26


def test_encoder_tokenizes_words_without_their_signs(monkeypatch):
    """Before, each form of a word before punctuation was tokenized for itself."""
    import public_tokenizers

    made = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    made.encode(pa.array(["heat heat. heat, heat!! heat*** heat", "heat", ".heat"]))
    assert sorted(made.slot) == [b"!!", b"***", b",", b".", b".heat", b"heat"]
    odd = ["it's. don't's, 's.x a.'s!", "a<|endoftext|>. <|ENDOFTEXT|>, x<|startoftext|>!y <|.|>", "e\u0301. e.\u0301 W\u030a, n.\u0338 \u0130, \u01c5. \xa0a.\xa0", "1.5a.5 a,b;c:d!e?f*g$h x\u2026. x.\u2026 \U0001f600.a", "a", ".b", "", None, "\x1ca.\x85b, A.B. Stra\xdfe."]
    for texts in (odd, odd[::-1]):
        ids, at = made.encode(pa.array(texts))
        for text, i, j in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[i:j].tolist() == [*made.tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
