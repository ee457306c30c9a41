"""Bounded-space online packing of token sequences.

Each partition keeps at most OPEN windows of WINDOW tokens. A document's tokens (with an end token) are
cut at whole windows; what remains is placed best-fit: into the open window with the least sufficient room.
If none fits and all windows are in use, the fullest is emitted; if its gap is MIN_CUT tokens or more, the head of
the document fills it first. At the end each partition leaves at most OPEN windows that aren't full; these leftovers,
by their lengths alone, are merged best-fit-decreasing in groups of bounded size, and keep their tokens' order.

Words are tokenized once each (white space separates tokens of this tokenizer, so the ids of a text are those
of its words in order) and kept in a cache of bounded size. They are also cut between an ASCII letter and one of ``.,;:!?*$``:
the tokenizer's runs of letters end there, its runs of signs begin there, nothing composes across, and none of its control
tokens holds such a place. So a word and its forms before punctuation are one entry.

Defined cases: null and empty text give the end token alone; repeated rows and ids are packed like any other rows;
a null doc_id stays null; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored
from .text import Words, chunks

WINDOW, OPEN, MIN_CUT, END = 4096, 64, 64, 2
CACHE_WORDS, CHUNK, MERGE_ROWS = 600_000, 4 << 20, 100_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"

_LETTER, _SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[list(b".,;:!?*$")] = True


class WordEncoder:
    """Token ids of words, each tokenized once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.first, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    @property
    def slot(self) -> dict[bytes, int]:
        """The kept words and their places."""
        return {word: k for k, word in enumerate(self.known.to_pylist())}

    def halve(self) -> None:
        """Keep the words that came first, the frequent ones among them; their ids stand at the front of the arrays."""
        keep = CACHE_WORDS // 2
        self.used = int(self.first[keep])
        self.known = self.known[:keep]

    def _learn(self, kinds: pa.Array) -> None:
        """Tokenize new words and keep them behind the others."""
        at = len(self.known)
        for k in range(0, len(kinds), 20_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(kinds[k : k + 20_000].cast(pa.large_string()).to_pylist(), add_special_tokens=False)]
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            n, total = len(ids), int(size.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while at + n > len(self.first):
                self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
            self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=total)
            self.first[at : at + n], self.size[at : at + n] = self.used + np.cumsum(size) - size, size
            self.used += total
            at += n
        self.known = pa.concat_arrays([self.known, kinds])

    def _slots(self, words: pa.Array) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.halve()
        found = pc.index_in(words, value_set=self.known)
        new = pc.is_null(found)
        out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            coded, base = words.filter(new).dictionary_encode(), len(self.known)
            self._learn(coded.dictionary)
            out[out < 0] = base + coded.indices.to_numpy(zero_copy_only=False)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end token after each text, and the texts' offsets in them."""
        words = Words(texts, cut=(_LETTER, _SIGN))
        slot = self._slots(words.strings())
        size = self.size[slot]
        total = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        body = total[words.first]
        at = body + np.arange(words.n_docs + 1)
        out = np.full(int(at[-1]), END, dtype=np.uint32)
        source = np.repeat(self.first[slot] - total[:-1], size) + np.arange(int(total[-1]))
        target = np.arange(int(total[-1])) + np.repeat(np.arange(words.n_docs), np.diff(body))
        out[target] = self.flat[source]
        return out, at


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """The open windows of one partition."""

    def __init__(self, base: int, window: int = WINDOW, open_windows: int = OPEN, min_cut: int = MIN_CUT) -> None:
        self.base, self.window, self.most, self.min_cut = base, window, open_windows, min_cut
        self.room: list[tuple[int, int]] = []  # (free tokens, sequence), ascending
        self.made = 0

    def _new(self) -> int:
        self.made += 1
        return self.base + self.made - 1

    def place(self, n: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start, length, sequence, offset) of a document of n tokens."""
        out, start = [], 0
        while n - start >= self.window:
            out.append((start, self.window, self._new(), 0))
            start += self.window
        if start < n:
            at = bisect.bisect_left(self.room, (n - start, -1))
            if at == len(self.room) and len(self.room) >= self.most:
                free, sequence = self.room.pop(0)  # the fullest is emitted
                if free >= self.min_cut:
                    out.append((start, free, sequence, self.window - free))
                    start += free
            at = bisect.bisect_left(self.room, (n - start, -1))
            free, sequence = self.room.pop(at) if at < len(self.room) else (self.window, self._new())
            out.append((start, n - start, sequence, self.window - free))
            if free > n - start:
                bisect.insort(self.room, (free - n + start, sequence))
        return out


def pack_partitions(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Pieces after the online phase; ``open`` marks those in a partition's leftover windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        packer = Packer(TaskContext.get().partitionId() << 32)
        waiting: dict[int, list[tuple]] = {}

        def batch_of(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array([is_open] * len(rows), pa.bool_())]
            names = [x.split()[0] for x in PIECE.split(", ")]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in chunks(batches, limit=CHUNK):
            ids, at = encode(batch.column("text"))
            done: list[tuple] = []
            for doc, i, j in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for start, length, sequence, offset in packer.place(j - i):
                    piece = ids[i + start : i + start + length]
                    row = (doc, start, length, zlib.crc32(piece.astype("<u4").tobytes()), j - i, sequence, offset, piece.astype(np.int32) if with_ids else None)
                    waiting.setdefault(sequence, []).append(row)
            still = {sequence for _, sequence in packer.room}
            for sequence in [s for s in waiting if s not in still]:
                done += waiting.pop(sequence)
            yield batch_of(done, False)
        for rows in waiting.values():
            yield batch_of(rows, True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best-fit-decreasing over leftover windows: (sequence_id, merged_id, shift)."""
    rows = sorted(((n, s) for b in batches for s, n in zip(b.column("sequence_id").to_pylist(), b.column("used").to_pylist(), strict=True)), key=lambda x: (-x[0], x[1]))
    room: list[tuple[int, int]] = []
    out = []
    for n, sequence in rows:
        at = bisect.bisect_left(room, (n, -1))
        free, into = room.pop(at) if at < len(room) else (WINDOW, sequence)
        out.append((sequence, into, WINDOW - free))
        if free > n:
            bisect.insort(room, (free - n, into))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["sequence_id", "merged_id", "shift"])


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids)."""
    pieces = stored(pack_partitions(docs, path, with_ids))
    left = pieces.filter("open").groupBy("sequence_id").agg(F.sum("length").alias("used"))
    groups = 1 + left.count() // MERGE_ROWS
    merged = left.repartition(groups, "sequence_id").mapInArrow(_merge, "sequence_id long, merged_id long, shift long")
    moved = pieces.filter("open").join(merged, "sequence_id").withColumn("sequence_id", F.col("merged_id")).withColumn("offset", F.col("offset") + F.col("shift")).select(*pieces.columns)
    everything = pieces.filter("not open").unionByName(moved)
    return everything.drop("open")


def padded_lengths(pieces: DataFrame) -> DataFrame:
    """Per sequence its tokens and the length it is padded to: WINDOW, or its own length at a power of two."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return used.withColumn("padded_length", F.when(F.bit_count("used") == 1, F.col("used")).otherwise(F.lit(WINDOW).cast("long")))
