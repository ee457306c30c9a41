"""Hard-negative mining: for each anchor all scores, sorted, and a window of them for each of its positives.

Scores are inner products of floor(256 * x), integers in double precision. An anchor's positives are its first ``positives`` other rows of
its label by (score descending, vec_id); a positive of score p takes the first ``negatives`` rows of other labels
whose score n has LOW * p <= 100 * n <= HIGH * p.

The anchors are a stated query set and meet all rows in blocks: rows stay where they are, anchors come to them in passes of at most ``PASS``
(their vectors are ``PASS_MB`` MB at most), so nothing is shuffled but what each task found. For every block of rows a
task computes the scores of all anchors of the pass, sorts them by score and id (rows lie in the order of ids, the sort is stable), finds
the upper limit of each positive by binary search and reads the next entries down to the lower limit. It keeps the
best ``positives`` (``negatives``) of its blocks, so a task sends a fixed number of rows for each anchor, and a grouped
sort of these gives the answer: the first rows of all are among the first rows of each block.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; vectors of another length than the
anchor's aren't its partners; rows that repeat in vec_id, label and vector count once; different rows of one vec_id are rows (and anchors)
of their own, an anchor's other rows are those with another vec_id; positives below 0 have an empty window. Scores are exact
up to 2**53, rounded beyond, and cut at 2**56. Only vec_id, embedding and label are read; further columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Anchors a pass, MB of their vectors, rows a block, anchors whose scores are held at once.
PASS, PASS_MB, ROWS, ANCHORS = 16_384, 64, 4096, 256
_NONE = -np.inf
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rows_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q, h): the rows that take part; h tells different rows of one vec_id apart."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    some = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fit)
    q = F.transform(x, lambda v: F.floor(v * 256).cast("double"))
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"), F.xxhash64("label", x).alias("h"))


def _matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, size)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of vec_id, h, label and vectors of one length, in the order of ids, repeated rows once."""
    for batch in batches:
        batch = batch.filter(pc.equal(pc.list_value_length(batch.column("q")), size))
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, h = part.column("vec_id").to_numpy(), part.column("h").to_numpy()
            order = np.lexsort((h, ids))
            fresh = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (h[order][1:] != h[order][:-1])))
            order = order[fresh]
            yield ids[order], h[order], part.column("label").to_numpy()[order], _matrix(part, "q", size)[order]


def _first(score: np.ndarray, ids: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row by score descending, then id; of a row that is there twice, one."""
    order = np.lexsort((h, ids, -score), axis=1)
    score, ids, h = (np.take_along_axis(x, order, axis=1) for x in (score, ids, h))
    twice = np.zeros(score.shape, dtype=bool)
    twice[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (h[:, 1:] == h[:, :-1]) & (score[:, 1:] == score[:, :-1])
    if twice.any():
        score = np.where(twice, _NONE, score)
        order = np.argsort(-score, axis=1, kind="stable")
        score, ids, h = (np.take_along_axis(x, order, axis=1) for x in (score, ids, h))
    return score[:, :k], ids[:, :k], h[:, :k]


class _Best:
    """The best k entries so far of so many lists."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.score, self.ids, self.h = np.full((lists, k), _NONE), np.zeros((lists, k), dtype=np.int64), np.zeros((lists, k), dtype=np.int64)

    def add(self, rows: slice | np.ndarray, score: np.ndarray, ids: np.ndarray, h: np.ndarray) -> None:
        new = (np.concatenate(x, axis=1) for x in ((self.score[rows], score), (self.ids[rows], ids), (self.h[rows], h)))
        self.score[rows], self.ids[rows], self.h[rows] = _first(*new, self.k)

    def rows(self, name: str, **more: np.ndarray) -> pa.RecordBatch:
        """The lists that have entries; ``more`` has a value for each list."""
        one, place = np.nonzero(self.score > _NONE)
        score = np.clip(self.score[one, place], -(2.0**56), 2.0**56).astype(np.int64)
        values = {"nth": one.astype(np.int64)} | {k: v[one] for k, v in more.items()} | {f"{name}_id": self.ids[one, place], f"{name}_h": self.h[one, place], f"{name}_score": score}
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values.values()], names=list(values))


def _sorted_scores(block: np.ndarray, anchors: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the scores of a block, sorted downwards (negated, so upwards), ties in the block's order; what ``other`` forbids is last."""
    score = anchors @ block.T
    key = np.where(other, np.inf, -score)
    order = np.argsort(key, axis=1, kind="stable")
    return np.take_along_axis(key, order, axis=1), order


def _positives(batches: Iterator[pa.RecordBatch], ids: np.ndarray, label: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    best = _Best(len(ids), k)
    for row_ids, h, row_label, vectors in _blocks(batches, q.shape[1]):
        for lo in range(0, len(ids), ANCHORS):
            some = slice(lo, lo + ANCHORS)
            out = (row_label[None, :] != label[some, None]) | (row_ids[None, :] == ids[some, None])
            key, order = _sorted_scores(vectors, q[some], out)
            top = order[:, :k]
            best.add(some, -key[:, :k], row_ids[top], h[top])
    yield best.rows("positive", anchor_id=ids)


def _negatives(batches: Iterator[pa.RecordBatch], ids: np.ndarray, label: np.ndarray, q: np.ndarray, owner: np.ndarray, positive: np.ndarray, p: np.ndarray, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``owner`` (the anchor's place, ascending), ``positive`` and ``p``: anchor, id and score of each positive."""
    best = _Best(len(p), k)
    upper, lower = np.floor_divide(high * p, 100), -np.floor_divide(-low * p, 100)
    for row_ids, h, row_label, vectors in _blocks(batches, q.shape[1]):
        for lo in range(0, len(label), ANCHORS):
            some = slice(lo, lo + ANCHORS)
            key, order = _sorted_scores(vectors, q[some], row_label[None, :] == label[some, None])
            ours = slice(*np.searchsorted(owner, [lo, lo + ANCHORS]).tolist())
            own = owner[ours] - lo
            start = np.fromiter((np.searchsorted(key[a], -float(u), side="left") for a, u in zip(own, upper[ours], strict=True)), dtype=np.int64, count=len(own))
            place = start[:, None] + np.arange(k)
            fits = place < key.shape[1]
            place = np.minimum(place, key.shape[1] - 1)
            score, at = -key[own[:, None], place], order[own[:, None], place]
            fits &= score >= lower[ours][:, None]
            best.add(ours, np.where(fits, score, _NONE), row_ids[at], h[at])
    yield best.rows("negative", anchor_id=ids[owner], positive_id=positive, positive_score=p)


def _ranked(found: DataFrame, keys: list[str], name: str, k: int) -> DataFrame:
    """The first k of each list; a row that several tasks found counts once."""
    one = found.dropDuplicates([*keys, f"{name}_id", f"{name}_h"])
    order = Window.partitionBy(*keys).orderBy(F.desc(f"{name}_score"), f"{name}_id", f"{name}_h")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` names."""
    rows = rows_of(embeddings)
    asked = rows.filter(anchor)
    sizes = asked.groupBy(F.size("q").alias("size")).agg(F.count("*").alias("n")).collect()  # a row a length of vectors
    out = rows.sparkSession.createDataFrame([], RESULT)
    for size, n in sizes:
        passes = -(-n // max(1, min(PASS, (PASS_MB << 20) // max(8, 8 * size)) // 2))  # a hash deals them out: half of what fits, on average
        for k in range(passes):
            chosen = asked.filter((F.size("q") == size) & (F.pmod(F.xxhash64("vec_id", "h"), F.lit(passes)) == k)).dropDuplicates(["vec_id", "h"])
            got = chosen.toArrow().combine_chunks()
            if got.num_rows:
                out = out.unionByName(_mined(rows, got, size, positives, negatives, low, high))
    return out


def _mined(rows: DataFrame, anchors: pa.Table, size: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    batch = anchors.to_batches()[0]
    ids, label, q = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch, "q", size)
    near = rows.mapInArrow(partial(_positives, ids=ids, label=label, q=q, k=positives), "nth long, anchor_id long, positive_id long, positive_h long, positive_score long")
    # PASS anchors at most, with so many positives each
    pairs = _ranked(near, ["nth"], "positive", positives).select("nth", "positive_id", "positive_score", "rank").orderBy("nth", "rank").toArrow()
    owner, positive, p = (pairs.column(k).combine_chunks().to_numpy() for k in ("nth", "positive_id", "positive_score"))
    kind = "nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_h long, negative_score long"
    found = rows.mapInArrow(partial(_negatives, ids=ids, label=label, q=q, owner=owner, positive=positive, p=p, k=negatives, low=low, high=high), kind)
    return _ranked(found, ["nth"], "negative", negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
