"""Importance resampling, URL filters and hard negatives against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import negatives, resampling, urls

# resampling

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = FEATURE_WORD.findall(lower)
    grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(g.encode()) % 10000 for g in grams]


def brute_resample(docs, target, percent=5, least=20):
    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for doc_id, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in f)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


def odd_texts():
    rng = random.Random(5)
    some = ["alpha Beta", "gamma-delta", "x1", "é日本語\U0001f600", "a" * 300, "end."]
    out = [(k, " ".join(rng.choice(some) for _ in range(rng.randint(0, 60)))) for k in range(90)]
    return [*out, (90, None), (91, ""), (92, " \x00 [] {} \x7f"), (93, "one"), (94, "one TWO"), (95, "word " * 30000), (None, "w " * 25), (7, out[7][1]), (7, out[7][1]), (-3, "w " * 25)]


@pytest.mark.parametrize("percent", [5, 100])
def test_resampling_restated(spark, percent):
    docs, target = odd_texts(), ["alpha beta gamma", None, "", "X1 delta"]
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, weight string, _row int").repartition(3)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resample(df, aim, percent).collect())
    assert got == brute_resample(docs, target, percent)


def test_resampling_empty(spark):
    docs = spark.createDataFrame([(1, "w " * 30), (2, "v " * 30)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, docs).count() == 0
    assert {r["rank"] for r in resampling.resample(docs, none, 50).collect()} == {1, None}
    assert resampling.drawn_documents(docs, resampling.resample(docs, none, 50)).columns == docs.columns


@pytest.mark.parametrize("texts", [["a bc def ghij", "", None, "ü " * 3, "x" * 1000 + " y"], []])
def test_buckets_are_those_of_zlib(texts):
    stream, offsets, n = resampling.buckets(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        words, want = features(text)
        assert (n[k], stream[offsets[k] : offsets[k + 1]].tolist()) == (words, want)


def test_counts_don_t_depend_on_the_runs(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(odd_texts())], "doc_id long, text string")
    a, b = (dict(map(tuple, resampling.counts(resampling.streams(docs.repartition(n))).collect())) for n in (1, 7))
    assert a == b == Counter(x for _, t in odd_texts() for x in features(t)[1])


# url filters

WIDE = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/12", "allow"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
    ("a.com", "", "block"), ("b.a.com", "/x", "allow"), ("com", "/x/long/path", "block"), ("Example.ORG", "/EN/", "block"), ("a.com", "/é", "allow"), ("a.com", "/é", "block"),
    (None, "/", "block"), ("net", None, "block"), ("", "/", "block"), ("x\x01y.com", "/", "block"), (".org", "/q", "block"),
)


def brute_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h.lower() + p), len(h), v == "block", h.lower() + p, v) for h, p, v in rules if h and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def odd_urls():
    rng = random.Random(3)
    hosts = ["org", "example.org", "www.EXAMPLE.org", "xexample.org", "a.com", "b.a.com", "c.b.a.com", "com", "net", "", "org.", "x\x01y.com", "y.com", "q..org", ".org", "user@a.com:80", "x\x02.com", "x-y.com", "a.b" * 400 + ".com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/3", "/EN/x", "/fr/", "/de/x", "/x/long/path/z", "/x", "/é/1", "/e", "?q=/es/", "#/es/", "/en/1?x#y", "/\n/es/", "/q"]
    out = [f"{s}://{h}{p}" for h in hosts for p in paths for s in [rng.choice(["http", "https", "", "a\nb"])]]
    return [*out, None, "", "no scheme/es/", "://", "http:/x.org/", "http://a.com/x://b.org/", "x://" + "y" * 50000 + ".org/"]


@pytest.mark.parametrize("rules", [WIDE, urls.RULES, ()])
def test_urls_restated(spark, rules):
    rows = [(k, u, "z") for k, u in enumerate(odd_urls())] + [(None, "http://a.org/", "z"), (3, "http://com/de/", "z"), (3, "http://com/de/", "y"), (5, None, None)] + [(9, "http://w.com/de/", "hot")] * 400
    df = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(5)
    table = urls.rules_table(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
    got = Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, table).collect())
    assert got == Counter((k, u, *brute_judge(u, rules)) for k, u, _ in rows)


def test_urls_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.rules_table(spark)).count() == 0


def test_many_rules_of_one_host(spark):
    rules = tuple(("h.com", "/" + "/".join(str(k)[:n]), ("allow", "block")[n % 2]) for k in range(0, 3000, 7) for n in range(1, 5))
    rules = tuple(dict.fromkeys(rules))
    rows = [(k, f"http://{'s.' * (k % 3)}h.com/{'/'.join(str(k))}") for k in range(3000)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rules_table(spark, rules)).collect()}
    assert got == {k: brute_judge(u, rules)[2:] for k, u in rows}


# hard negatives


def brute_mine(rows, divisor, k=5, m=10):
    fit = [(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted(set(fit))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    out = Counter()
    for a in (r for r in fit if r[0] % divisor == 0):
        others = sorted(((-score(a, b), b[0], b) for b in fit if b[0] != a[0] and len(b[2]) == len(a[2])), key=lambda t: t[:2])
        for p, i, _ in [x for x in others if x[2][1] == a[1]][:k]:
            window = [(n, j) for n, j, b in others if b[1] != a[1] and 30 * -p <= 100 * -n <= 90 * -p][:m]
            out.update((a[0], i, r + 1, j, -p, -n) for r, (n, j) in enumerate(window))
    return out


def vectors(seed, n, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 8))
    return [(k, int(rng.integers(labels)), (centre[k % 6] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 7), (3, 40)])
def test_negatives_restated(spark, monkeypatch, seed, block):
    monkeypatch.setattr(negatives, "ROWS", block)
    monkeypatch.setattr(negatives, "PASS", 8)
    rows = vectors(seed, 150)
    rows += [(1000 + k, k % 3, rows[k % 2][2]) for k in range(60)]  # ties, negative windows
    rows += [(2000, None, rows[0][2]), (2010, 1, None), (2020, 1, [math.nan] * 8), (2030, 1, [math.inf] + [0.0] * 7), (2040, 1, [None] * 8), (None, 1, rows[0][2]), (2050, 0, [0.0] * 8), (2060, 1, [1.0, 2.0]), (2070, 2, [1.0, 1.0]), (2080, 1, [1.0, 2.0]), (2090, 1, []), (20, rows[20][1], rows[20][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, q string, nth int").repartition(3)
    got = Counter(tuple(r) for r in negatives.mine(df, (df["vec_id"] % 10) == 0).collect())
    assert got == brute_mine(rows, 10)


def test_negatives_without_anchors(spark):
    df = spark.createDataFrame(vectors(1, 9), "vec_id long, label int, embedding array<float>")
    assert negatives.mine(df, df["vec_id"] > 99).count() == 0
    assert negatives.mine(df.limit(0), df["vec_id"] >= 0).columns == "anchor_id positive_id rank negative_id positive_score negative_score".split()
