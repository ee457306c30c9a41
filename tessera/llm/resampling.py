"""Target-distribution importance resampling: hashed word runs, an external sort-count, a Gumbel draw.

Features of a text are its runs of one to three words (words: runs of letters, digits and characters beyond ASCII,
A-Z lower-cased), joined by one space; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.

* ``streams`` writes the buckets of all features once, as packed little-endian uint16 runs of about a megabyte with the
  offsets of the documents in them. Texts aren't read again.
* ``counts`` sorts each run, run-length encodes it and merges the lengths; a task sends one row a bucket at most.
* ``weights`` gathers the gains of each run and adds them up between the document offsets (``np.add.reduceat``).
* ``resample`` adds a Gumbel number made from a hash of the document's id and ranks the highest sums: a draw without replacement, in
  proportion to how much likelier a text is under the target than in the corpus. Ranks come from range partitions and
  their sizes, never from one task.

The CRC of a longer run comes from those of its parts: appending n bytes is a linear map, kept as four tables of 256
entries for each power of two of n. Only the gains (``BUCKETS`` numbers) and the sizes of partitions pass through the driver.

Defined cases: null and empty texts, and texts without a word, have no features and weigh 0; an empty corpus gives no row;
an empty target counts 0 everywhere; every row of a repeated doc_id is a document of its own, and rows that tie in score and
doc_id rank in any order; a null doc_id hashes as the empty string and comes last among ties. Further columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import released, stored
from .text import Words, chunks

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 5, 42

#: Bytes outside words; lower-casing comes first, so A-Z belong to words.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[:0x80] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _BETWEEN[_low : _high + 1] = False

_BYTE = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32) ^ np.uint32(zlib.crc32(b"\0"))  # linear part
_FULL = np.uint32(0xFFFFFFFF)


def _step(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _BYTE[(register ^ byte) & 255] ^ (register >> np.uint32(8))


def _image(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = tables[0][register & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= tables[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class _Shifts:
    """The register after n further zero bytes, for many registers and lengths at once."""

    def __init__(self) -> None:
        basis = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        self.tables = [_step(basis, 0)]

    def __call__(self, register: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = register.copy()
        for k in range(int(n.max(initial=0)).bit_length()):
            if k == len(self.tables):
                self.tables.append(_image(self.tables[-1], self.tables[-1]))
            at = np.flatnonzero((n >> k) & 1)
            out[at] = _image(self.tables[k], out[at])
        return out


_shift = _Shifts()


def word_crcs(words: Words) -> np.ndarray:
    """CRC-32 of each word, one byte of all words a step."""
    size = words.ends - words.starts
    out = np.full(len(size), _FULL, dtype=np.uint32)
    rest, at = np.arange(len(size)), 0
    while len(rest):
        out[rest] = _step(out[rest], words.data[words.starts[rest] + at].astype(np.uint32))
        at += 1
        rest = rest[size[rest] > at]
    return ~out


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uint16 buckets of all features, document by document; offsets of the documents in them; words per document)."""
    words = Words(texts, lower=True, separators=_BETWEEN)
    one, n = word_crcs(words), words.counts.astype(np.int64)
    size = words.ends - words.starts
    sizes = np.stack([n, np.maximum(n - 1, 0), np.maximum(n - 2, 0)])
    offsets = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(sizes.sum(axis=0), out=offsets[1:])
    out = np.empty(offsets[-1], dtype=np.uint16)
    doc = words.doc_of_word()
    place = np.arange(len(one)) - words.first[:-1][doc]
    run, start = one, offsets[:-1]
    for k in range(3):
        if k:  # the runs of k words, a space, and the word after them, for all that have one
            more = np.flatnonzero(place + k < n[doc])
            run_ = ~_step(~run[more], np.uint32(0x20))
            run = np.zeros(len(one), dtype=np.uint32)
            run[more] = _shift(run_, size[more + k]) ^ one[more + k]
        else:
            more = np.arange(len(one))
        out[start[doc[more]] + place[more]] = run[more] % BUCKETS
        start = start + sizes[k]
    return out, offsets, n


_STREAM = "doc_ids array<long>, words array<long>, offsets array<long>, stream binary"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        stream, offsets, words = buckets(batch.column("text"))
        lists = [batch.column("doc_id"), pa.array(words), pa.array(offsets)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        yield pa.RecordBatch.from_arrays([*lists, pa.array([stream.astype("<u2").tobytes()], pa.binary())], names=["doc_ids", "words", "offsets", "stream"])


def streams(docs: DataFrame) -> DataFrame:
    """One row per run of documents; stored, so texts are read and hashed once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_write, _STREAM))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for packed in batch.column("stream"):
            run = np.sort(np.frombuffer(packed.as_buffer(), dtype="<u2"), kind="stable")
            if len(run):
                first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
                total[run[first]] += np.diff(np.append(first, len(run)))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["bucket", "n"])


def counts(runs: DataFrame) -> DataFrame:
    """(bucket, n) of all features; buckets without one have no row."""
    return runs.select("stream").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the floored, thousandfold logarithm of its smoothed share in the
    target over that in the corpus. ``BUCKETS`` numbers, so they are made on the driver."""
    seen = np.zeros((2, BUCKETS), dtype=np.int64)
    for k, frame in enumerate((corpus, target)):
        for bucket, n in frame.collect():  # BUCKETS rows at most
            seen[k, bucket] = n
    (s, t), (all_s, all_t) = seen.astype(float), seen.sum(axis=1).astype(float)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + BUCKETS) / ((a + 1) * (all_t + BUCKETS)))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def _gather(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, words, offsets = (batch.column(k).slice(row, 1).flatten() for k in ("doc_ids", "words", "offsets"))
            at, stream = offsets.to_numpy(), np.frombuffer(batch.column("stream")[row].as_buffer(), dtype="<u2")
            n = np.diff(at)
            weight, some = np.zeros(len(n), dtype=np.int64), n > 0
            if some.any():
                weight[some] = np.add.reduceat(gain[stream], at[:-1][some])
            yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def weights(runs: DataFrame, gain: np.ndarray) -> DataFrame:
    return runs.mapInArrow(partial(_gather, gain=gain), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank: of the N documents with ``min_words`` words or more, the
    floor(percent * N / 100) highest scores rank 1, 2, 3 ..., ties to smaller ids; all others have none."""
    runs, aim = streams(docs), streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gain = gains(counts(runs), counts(aim))
    released(aim)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(weights(runs, gain).withColumn("score", F.col("weight") + gumbel).withColumn("_in", F.col("n_words") >= min_words))
    released(runs)
    # the row's place in the stored table splits a doc_id with many rows
    order = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    rows = scored.withColumn("_row", F.monotonically_increasing_id())
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    released(scored)
    # an id of that function is the partition, and below it 33 bits of the row's place there
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(x) for x in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("_in").alias("m")).collect())  # a row a partition
    drawn = percent * sum(m for _, _, m in sizes) // 100
    before = accumulate((n for _, n, _ in sizes), initial=0)
    table = placed.sparkSession.createDataFrame([(p, b) for (p, _, _), b in zip(sizes, before, strict=False)], "_part long, _before long")
    rank = place + F.col("_before") + 1
    joined = placed.join(F.broadcast(table), part == F.col("_part"))
    return joined.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_in") & (rank <= drawn), rank).alias("rank"))


def drawn_documents(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id was drawn; doc_ids have to tell documents apart."""
    return docs.join(resampled.filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct(), F.col("doc_id") == F.col("_drawn"), "left_semi")
