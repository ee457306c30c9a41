"""Quality rules: distribution divergence against language references.

A document is compared with the reference of its language by two Jensen-Shannon distances (square root of
the divergence, base 2, 0 to 1): of its character classes, and of its histogram over the language's COMMON
most frequent words with one further bin for all other words. References are counted over all documents.
Short texts have noisy histograms, so each distance has a minimum length below which it isn't applied.

Two base rules stand before the method: fewer than 10 words, or more than a fifth of the words in 5-word
windows that the text repeats.

Every language with MIN_REFERENCE words or more has a reference (some 700 bytes). They go to the executors
PASS languages at a time; a table with more takes further passes over its rows.

Defined cases: null or empty text has no words and fails the base rules; for a language with fewer words than
MIN_REFERENCE no distance can be counted (they are 0), so only the base rules hold; documents without a language
are held against the nearest of all references, or the base rules alone if there is none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import free_name, stored
from .text import WORDS, Words, chunks, mix, per_document, signed, window_starts

COMMON, MIN_REFERENCE, PASS = 40, 1000, 8192
#: A distance over LIMIT + SLACK / sqrt(words) is too far: the histogram of a short text is noisy.
CHAR_LIMIT, CHAR_SLACK, WORD_LIMIT, WORD_SLACK = 0.25, 0.35, 0.42, 0.5
MIN_CHAR_WORDS, MIN_WORD_WORDS = 20, 30
FLUSH_WORDS = 1_000_000

#: Character classes by UTF-8 byte: lower, upper, digit, white space, sentence marks, other ASCII, beyond ASCII.
N_CLASSES = 7
_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[192:], _CLASS[128:192] = 6, N_CLASSES  # continuation bytes count for nothing
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def class_counts(words: Words) -> np.ndarray:
    """Documents by character classes."""
    row = np.repeat(np.arange(words.n_docs), np.diff(words.offsets))
    flat = np.bincount(row * (N_CLASSES + 1) + _CLASS[words.data], minlength=words.n_docs * (N_CLASSES + 1))
    return flat.reshape(words.n_docs, N_CLASSES + 1)[:, :N_CLASSES]


def base_counts(texts: pa.Array, words: Words) -> list[np.ndarray]:
    h = words.hashes()
    repeat = np.zeros(words.n_docs, dtype=np.int64)
    starts = np.flatnonzero(window_starts(words.first, 5))
    if len(starts):
        row = np.searchsorted(words.first, starts, side="right") - 1
        key = mix(WORDS.span(WORDS.prefix(h), starts, starts + 5) ^ mix(row.astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        edge[starts[twice]] += 1
        edge[starts[twice] + 5] -= 1
        repeat = per_document(np.cumsum(edge[:-1]) > 0, words.first)
    inside = np.zeros(len(words.data) + 1, dtype=np.int64)
    inside[words.starts] += 1
    np.add.at(inside, words.ends, -1)
    chars = per_document((np.cumsum(inside[:-1]) > 0) & ((words.data & 0xC0) != 0x80), words.offsets)
    dup = []
    for text in texts.cast(pa.binary()).to_pylist():
        lines = [x for x in (text or b"").split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return [words.counts.astype(np.int64), chars, per_document(_SYMBOL[words.data], words.offsets), np.array(dup, dtype=np.int64), repeat]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, kind, key, n): kind 0 a word's hash, 1 a character class, 2 documents."""

    def rows(lang: str | None, kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        size = len(key)
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(size, dtype=np.int64))), pa.array(np.full(size, kind, dtype=np.int32)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "kind", "key", "n"])

    held: dict[str | None, list[np.ndarray]] = defaultdict(list)
    waiting = 0
    small: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES + 1, dtype=np.int64))
    for batch in chunks(batches):
        words = Words(batch.column("text"), lower=True)
        raw = Words(batch.column("text"))
        h, classes = words.hashes(), class_counts(raw)
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            mask = np.array([x == lang for x in langs])
            held[lang].append(h[np.repeat(mask, words.counts)])
            small[lang][:N_CLASSES] += classes[mask].sum(axis=0)
            small[lang][N_CLASSES] += int(mask.sum())
        waiting += len(h)
        if waiting >= FLUSH_WORDS:
            for lang, parts in held.items():
                yield rows(lang, 0, *_unique(parts))
            held.clear()
            waiting = 0
        if len(small) > 4096:
            for lang, n in small.items():
                yield rows(lang, 1, np.arange(N_CLASSES + 1), n)
            small.clear()
    for lang, parts in held.items():
        yield rows(lang, 0, *_unique(parts))
    for lang, n in small.items():
        yield rows(lang, 1, np.arange(N_CLASSES + 1), n)


def _unique(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.unique(np.concatenate(parts), return_counts=True)
    return signed(key), n


def references(docs: DataFrame) -> dict[str, dict]:
    """Per language: hashes and shares of its common words, and shares of the character classes."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = stored(rows.mapInArrow(_count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    per_word = counts.filter("kind = 0")
    best = Window.partitionBy("lang", "_part").orderBy(F.desc("n"), "key")
    top = per_word.withColumn("_part", F.pmod("key", F.lit(64))).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= COMMON)
    top = top.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).filter(F.col("_r") <= COMMON).select("lang", "kind", "key", "n")
    total = per_word.groupBy("lang").agg(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("key"), F.sum("n").alias("n"))
    small = counts.filter("kind = 1")
    known = total.filter((F.col("n") >= MIN_REFERENCE) & F.col("lang").isNotNull()).select("lang")
    found: dict[str, dict] = defaultdict(lambda: {"words": [], "classes": np.zeros(N_CLASSES), "total": 0})
    for lang, kind, key, n in top.unionByName(total).unionByName(small).join(known, "lang").collect():
        ref = found[lang]
        if kind == 0:
            ref["words"].append((n, key))
        elif kind == 2:
            ref["total"] = n
        elif key < N_CLASSES:
            ref["classes"][key] = n
    out = {}
    for lang, ref in sorted(found.items()):
        if ref["total"] and ref["classes"].sum():
            pairs = sorted((key, n) for n, key in ref["words"])
            share = np.array([n for _, n in pairs] + [ref["total"] - sum(n for _, n in pairs)]) / ref["total"]
            out[lang] = {"key": np.array([k for k, _ in pairs], dtype=np.int64), "words": share, "classes": ref["classes"] / ref["classes"].sum()}
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def distances(words: Words, h: np.ndarray, classes: np.ndarray, langs: list, model: dict[str, dict]) -> tuple[np.ndarray, np.ndarray]:
    """Per document the distance of its classes and of its common words; infinite where there is no reference."""
    by_class, by_word = np.full(words.n_docs, np.inf), np.full(words.n_docs, np.inf)
    row_of = words.doc_of_word()
    missing = np.array([x is None for x in langs], dtype=bool)
    for lang in model if missing.any() else {x for x in langs if x in model}:
        ref = model[lang]
        docs = np.array([x == lang for x in langs], dtype=bool) | missing
        if not docs.any():
            continue
        at = np.flatnonzero(docs)
        place = np.full(words.n_docs, -1)
        place[at] = np.arange(len(at))
        mask = docs[row_of]
        own, row = signed(h)[mask], place[row_of[mask]]
        k = len(ref["key"])
        slot = np.minimum(np.searchsorted(ref["key"], own), max(k - 1, 0))
        slot = np.where(ref["key"][slot] == own, slot, k) if k else np.zeros(len(own), dtype=np.int64)
        hist = np.bincount(row * (k + 1) + slot, minlength=len(at) * (k + 1)).reshape(len(at), k + 1)
        c, w = js_distance(_shares(classes[at]), ref["classes"]), js_distance(_shares(hist), ref["words"])
        for store, value in ((by_class, c), (by_word, w)):
            store[at] = np.minimum(store[at], value)
    return by_class, by_word


def judge(docs: DataFrame, model: dict[str, dict] | None = None) -> DataFrame:
    """``docs`` with the base counts, js_chars, js_words, base_failed and kept."""
    model = references(docs) if model is None else model
    added = f"{BASE}, js_chars double, js_words double, base_failed boolean, kept boolean"
    names = [x.split()[0] for x in added.split(", ")]
    columns = [c for c in docs.columns if c not in names]
    text_name, lang_name = free_name(docs, "_text"), free_name(docs, "_lang")

    def measured(batches: Iterator[pa.RecordBatch], part: dict[str, dict], first: bool, carried: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_name):
            text = batch.column(text_name)
            words = Words(text)
            found = distances(words, Words(text, lower=True).hashes(), class_counts(words), batch.column(lang_name).to_pylist(), part)
            if first:
                base = [pa.array(c) for c in base_counts(text, words)]
            else:
                base = [batch.column(c) for c in names[:5]]
                found = tuple(np.minimum(new, batch.column(c).to_numpy()) for new, c in zip(found, names[5:7], strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *base, *map(pa.array, found)], names=[*carried, *names[:7]])

    rows = docs.select(*columns).withColumn(text_name, F.col("text").cast("string")).withColumn(lang_name, F.col("lang").cast("string"))
    types, langs = dict(rows.dtypes), list(model)
    for start in range(0, max(len(langs), 1), PASS):
        part = {x: model[x] for x in langs[start : start + PASS]}
        carried = columns if start + PASS >= len(langs) else [*columns, text_name, lang_name]
        schema = ", ".join(f"`{c}` {types[c]}" for c in carried)
        rows = rows.mapInArrow(partial(measured, part=part, first=start == 0, carried=carried), f"{schema}, {BASE}, js_chars double, js_words double")
    for c in names[5:7]:
        rows = rows.withColumn(c, F.when(F.col(c) < float("inf"), F.col(c)).otherwise(0.0))
    n = F.col("n_words")
    noise = 1 / F.sqrt(F.greatest(n, F.lit(1)))
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    off = ((n >= MIN_CHAR_WORDS) & (F.col("js_chars") > CHAR_LIMIT + CHAR_SLACK * noise)) | ((n >= MIN_WORD_WORDS) & (F.col("js_words") > WORD_LIMIT + WORD_SLACK * noise))
    return rows.select(*columns, *names[:7], failed.alias("base_failed"), (~failed & ~off).alias("kept"))
