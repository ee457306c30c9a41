"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words of one document. Every window has one *anchor*: the leftmost
smallest hash among the GRAM-word grams inside it. The anchor depends on the window's words alone, so
equal windows have equal anchors. Neighbouring windows with the same anchor form a *segment*, and a
document of n words has about n / 18 segments instead of n windows. The index keeps one row per
distinct segment (anchor hash, segment hash): the smallest document that has it, its places there, and the hashes of its windows.

Index: immutable runs, each a bucketed and sorted table in the shared folder. A new batch of documents becomes a run of its own;
every earlier run is merge-joined with it on the anchor hash (same buckets, same order, so runs are not shuffled).
``compact`` merges runs when there are ``fanout`` of them. Texts of earlier batches aren't needed again.

A segment that a smaller document also has is covered as a whole. Anchors with two or more different segments may share only some
windows, so the window hashes of their segments, old and new, are compared one by one. A window is told by its anchor's hash (64
bits over the anchor's words) and verified by WINDOW_BYTES bytes of another hash over all its words; a segment by anchor and 64 bits over all its words.

Defined cases: null text has no words; documents of fewer than WINDOW words lose nothing; rows that repeat
a doc_id are judged each on its own text and never against each other; a null doc_id is never a source and
loses nothing; further columns, whatever their names, pass unchanged, but for n_words, n_removed and kept_text, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import free_name, partitions, releasing_shuffles, shared_folder, stored
from .text import WORDS, Poly, Words, chunks, mix, signed, sliding_min, window_starts

WINDOW, GRAM, WINDOW_BYTES = 50, 16, 5
_SPAN = WINDOW - GRAM + 1
_LOW = np.uint64((1 << 28) - 1)
_SECOND, _OTHER = Poly(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)

SEGMENT = "h long, seg long, doc_id long, rk long, a int, n int"
RUN = "h long, seg long, doc_id long, rk long, places array<int>, n int, w binary"


def segments(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Anchor hash, segment hash, document (row of ``texts``), first window, its word among all words, and number of windows;
    and the hashes of all words."""
    words = Words(texts)
    h = words.hashes()
    if len(h) < WINDOW:
        return {k: np.zeros(0, dtype=np.int64) for k in ("h", "seg", "row", "a", "at", "n")}, h
    prefix = WORDS.prefix(h)
    at = np.arange(len(h) - GRAM + 1)
    gram = WORDS.span(prefix, at, at + GRAM)
    anchor = (sliding_min((gram & ~_LOW) | at.astype(np.uint64), _SPAN) & _LOW).astype(np.int64)
    starts = np.flatnonzero(window_starts(words.first, WINDOW)[: len(anchor)])
    anchor, row = anchor[starts], np.searchsorted(words.first, starts, side="right") - 1
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    first = starts[head]
    return {"h": signed(gram[anchor[head]]), "seg": signed(WORDS.span(prefix, first, first + count + WINDOW - 1)), "row": row[head], "a": first - words.first[row[head]], "at": first, "n": count}, h


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        s, _ = segments(batch.column("text"))
        row = pa.array(s["row"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(s["h"]), pa.array(s["seg"]), batch.column("doc_id").take(row), batch.column("rk").take(row), pa.array(s["a"].astype(np.int32)), pa.array(s["n"].astype(np.int32))],
            names=["h", "seg", "doc_id", "rk", "a", "n"],
        )


def _each(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _with_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a run: of each chunk's equal segments those of the smallest document, with all its places and the hashes of the windows."""
    for batch in chunks(batches):
        s, words = segments(batch.column("text"))
        doc, rk = (batch.column(c).to_numpy(zero_copy_only=False)[s["row"]] for c in ("doc_id", "rk"))
        order = np.lexsort((s["a"], rk, doc, s["seg"], s["h"]))
        h, seg, doc, rk, a, at, n = (x[order] for x in (s["h"], s["seg"], doc, rk, s["a"], s["at"], s["n"]))
        head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1]))) if len(h) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
        own = (doc == doc[head][group]) & (rk == rk[head][group])
        places = np.concatenate([[0], np.cumsum(np.bincount(group[own], minlength=len(head)))]).astype(np.int32)
        n = n[head]
        start = _each(at[head], n)
        prefix = _SECOND.prefix(mix(words ^ _OTHER))
        window = _SECOND.span(prefix, start, start + WINDOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WINDOW_BYTES]
        ends = np.concatenate([[0], np.cumsum(n) * WINDOW_BYTES]).astype(np.int32)
        w = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(window))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[head]), pa.array(seg[head]), pa.array(doc[head].astype(np.int64)), pa.array(rk[head].astype(np.int64)), pa.ListArray.from_arrays(pa.array(places), pa.array(a[own].astype(np.int32))), pa.array(n.astype(np.int32)), w],
            names=["h", "seg", "doc_id", "rk", "places", "n", "w"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("rk"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")


def fingerprints(docs: DataFrame) -> DataFrame:
    """All places of all segments."""
    return _keyed(docs).mapInArrow(_fingerprint, SEGMENT)


def run_rows(docs: DataFrame) -> DataFrame:
    """Rows for a run of the index; equal segments of different chunks aren't merged yet."""
    return _keyed(docs).mapInArrow(_with_windows, RUN)


class FingerprintIndex:
    """Sorted immutable runs of the fingerprints of all earlier documents."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = 4) -> None:
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        self.buckets = buckets or partitions(spark)
        self.runs: list[str] = []

    def write(self, rows: DataFrame) -> str:
        """A run of the distinct segments of ``rows``, each with its smallest document: one shuffle, on the anchor hash."""
        name = f"tessera_run_{uuid.uuid4().hex}"
        least = rows.repartition(self.buckets, "h").groupBy("h", "seg").agg(F.min(F.struct("doc_id", "rk", "places", "n", "w")).alias("_s")).select("h", "seg", "_s.*")
        with releasing_shuffles(self.spark):
            least.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    def add(self, run: str) -> None:
        """Count a written run in, and compact when runs have become many."""
        self.runs.append(run)
        if len(self.runs) >= self.fanout:
            self.compact()

    def append(self, rows: DataFrame) -> None:
        self.add(self.write(rows))

    def compact(self) -> None:
        """Merge all runs into one; the old runs are dropped after the new one is complete."""
        old = self.runs
        self.runs = [self.write(reduce(DataFrame.unionByName, [self.spark.table(r) for r in old]))]
        self._drop(old)

    def probe(self, anchors: DataFrame) -> DataFrame | None:
        """Historical segments whose anchor is among ``anchors`` (distinct column h): one merge join per run."""
        found = [self.spark.table(r).join(anchors.hint("merge"), "h", "left_semi") for r in self.runs]
        return reduce(DataFrame.unionByName, found) if found else None

    def _drop(self, runs: list[str]) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            folder = path(f"{self.path}/{name}")  # of a table with a path of its own, the files stay
            folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def drop(self) -> None:
        """Remove all runs."""
        self._drop(self.runs)
        self.runs = []


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments, at each of their places."""
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer(b"".join(batch.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW_BYTES)
        window = np.zeros((len(flat), 8), dtype=np.uint8)
        window[:, :WINDOW_BYTES] = flat
        row = np.repeat(np.arange(batch.num_rows), batch.column("places").value_lengths().to_numpy(zero_copy_only=False))
        place = batch.column("places").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at, size = (np.cumsum(n) - n)[row], n[row]
        take = pa.array(np.repeat(row, size))
        yield pa.RecordBatch.from_arrays(
            [batch.column("h").take(take), pa.array(window.view("<i8").ravel()[_each(at, size)]), batch.column("doc_id").take(take), batch.column("rk").take(take), pa.array(_each(place, size).astype(np.int32)), batch.column("fresh").take(take)],
            names=["h", "w", "doc_id", "rk", "start", "fresh"],
        )


def _covered_in_batch(prints: DataFrame, run: DataFrame, old: DataFrame | None) -> DataFrame:
    """Stored ranges of the windows of one batch that also start in a smaller document of it or of history."""
    light = run.select("h", "seg", "doc_id", "rk")
    if old is not None:
        light = light.unionByName(old.select("h", "seg", "doc_id", "rk")).groupBy("h", "seg").agg(F.min(F.struct("doc_id", "rk")).alias("_s")).select("h", "seg", "_s.*")
    least = stored(light.select("h", "seg", F.col("doc_id").alias("_min"), F.col("rk").alias("_rk")))
    again = stored(prints.join(least, ["h", "seg"]).filter("doc_id > _min or doc_id = _min and rk <> _rk").select("h", "seg", "doc_id", "rk", "a", "n", F.expr("doc_id = _min").alias("twin")))
    several = least.groupBy("h").agg(F.count("*").alias("_k")).filter("_k > 1").select("h")
    parts = [run.withColumn("fresh", F.lit(True))] + ([old.withColumn("fresh", F.lit(False))] if old is not None else [])
    parts = [x.join(several.hint("merge"), "h", "left_semi") for x in parts]
    twins = again.filter("twin")
    if not twins.isEmpty():  # other texts of a segment's smallest doc_id, which nothing covers as a whole
        known = reduce(DataFrame.unionByName, parts).select("h", "seg", "w")
        parts.append(twins.join(known, ["h", "seg"]).select("h", "seg", "doc_id", "rk", F.array("a").alias("places"), "n", "w", F.lit(True).alias("fresh")))
    rows = reduce(DataFrame.unionByName, parts).select("h", "doc_id", "rk", "places", "n", "w", "fresh")
    windows = stored(rows.mapInArrow(_expand, "h long, w long, doc_id long, rk long, start int, fresh boolean"))
    smallest = windows.groupBy("h", "w").agg(F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max")).filter("_min < _max").select("h", "w", "_min")
    single = windows.filter("fresh").join(smallest, ["h", "w"]).filter("doc_id > _min").select("doc_id", "rk", F.col("start").alias("a"), F.lit(1).alias("n"))
    # A copy of a segment in a larger document is covered as a whole; so windows are needed of representatives and their twins only.
    return stored(again.filter("not twin").select("doc_id", "rk", "a", "n").unionByName(single))


def covered(docs: DataFrame, index: FingerprintIndex, batches: int = 2) -> DataFrame:
    """Ranges of window starts (doc_id, rk, a, n) whose windows also start in a smaller document, of ``docs`` or of the index.

    Documents go through the index in ``batches`` ascending ranges of doc_id, as they would arrive over time.
    """
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = known.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    found = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        new = docs
        if low is not None:
            new = new.filter(F.col("doc_id") > low)
        if high is not None:
            new = new.filter(F.col("doc_id") <= high)
        run = index.write(run_rows(new))
        rows = docs.sparkSession.table(run)
        found.append(_covered_in_batch(stored(fingerprints(new)), rows, index.probe(rows.select("h").distinct())))
        index.add(run)
    return reduce(DataFrame.unionByName, found)


def _kept_words(text: str | None, ranges: list | None) -> tuple[list[bytes], int]:
    """The words that stay, and the number of all words."""
    words = (text or "").encode().split()
    if not ranges:
        return words, len(words)
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    a = np.fromiter((r["a"] for r in ranges), dtype=np.int64)
    n = np.fromiter((r["n"] for r in ranges), dtype=np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + n + WINDOW - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


def _cut(names: tuple[str, str]):  # noqa: ANN202
    """Adds n_words, n_removed and kept_text by the columns of a text and its ranges, which go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, names[0]):
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": []}
            for text, ranges in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                kept, n = _kept_words(text, ranges)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                out["kept_text"].append(b" ".join(kept).decode())
            rest = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string())], names=[*rest, *out])

    return run


def remove_repeats(docs: DataFrame, batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the remaining words joined by one space).

    With an ``index``, passages of the documents that went through it before count as well, and the index learns ``docs``.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    text, ranges, key, hashed, left = (free_name(docs, c) for c in ("text", "ranges", "key", "hash", "left"))
    used = index or FingerprintIndex(docs.sparkSession)
    found = stored(covered(docs.select("doc_id", "text"), used, batches).groupBy("doc_id", "rk").agg(F.collect_list(F.struct("a", "n")).alias(ranges)).select(F.col("doc_id").alias(key), F.col("rk").alias(hashed), ranges))
    if index is None:
        used.drop()
    rows = docs.select(*columns, F.col("text").cast("string").alias(text)).withColumn(left, F.xxhash64(text))
    joined = rows.join(found, (rows["doc_id"].cast("long") == found[key]) & (rows[left] == found[hashed]), "left").select(*columns, text, ranges)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)
    return joined.mapInArrow(_cut((text, ranges)), f"{schema}, n_words long, n_removed long, kept_text string")
