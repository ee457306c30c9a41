"""Vectorised word splitting, hashing and window arithmetic over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. These bytes are ASCII, so the
split works on UTF-8 bytes and agrees with the character pattern ``[^\\x20\\x09-\\x0D]+``.
Everything here is a pure function of one batch; memory follows the batch, which
``chunks`` keeps at about half a megabyte of text (or one document, if that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 512 * 1024

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL_OF_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
#: The low n bytes of eight.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of per-byte (or per-word) values between neighbouring offsets."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class Poly:
    """Polynomial hashes of spans modulo 2**64, from one prefix sum.

    For spans of values that are themselves strong 64-bit hashes, of fewer than a thousand each: longer ones, of two values in
    Thue-Morse order, could collide.
    """

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 1 << 16)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, factor, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def span(self, prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of values[first:last], wherever it stands."""
        return mix(((prefix[last] - prefix[first]) * self.down[first]) ^ (np.asarray(last - first).astype(np.uint64) << np.uint64(40)))


BYTES, WORDS = Poly(0x9E3779B97F4A7C15), Poly(0xD1342543DE82EF95)


class Words:
    """Words of a batch of texts: ``data[starts[i]:ends[i]]``; document d has words first[d]:first[d+1]. With ``cut``, words
    also end between a byte of its first table and a byte of its second."""

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE, cut: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.n_docs = len(texts)
        _, offsets, data = texts.buffers()
        self.offsets = np.frombuffer(offsets, dtype=np.int64, count=self.n_docs + 1, offset=8 * texts.offset) if self.n_docs else np.zeros(1, dtype=np.int64)
        lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, dtype=np.uint8)
        self.offsets = self.offsets - lo
        self.data = _LOWER[raw] if lower else raw
        space = separators[raw]
        before, after = np.ones(len(raw), dtype=bool), np.ones(len(raw), dtype=bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = self.offsets[1:-1]
        before[inner[inner < len(raw)]] = True
        after[inner[inner > 0] - 1] = True
        if cut is not None:
            here = np.flatnonzero(cut[0][raw[:-1]] & cut[1][raw[1:]]) + 1
            before[here] = True
            after[here - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Hashes of the words (of their first ``most`` bytes), eight bytes a step, each step mixed into the last by a bijection:
        nothing cancels out, and words of one length up to eight bytes never collide."""
        size = self.ends - self.starts if most is None else np.minimum(self.ends - self.starts, most)
        padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        out = mix((eight[self.starts] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, rest = 8, np.flatnonzero(size > 8)
        while len(rest):
            piece = eight[self.starts[rest] + at] & _LOW_BYTES[np.minimum(size[rest] - at, 8)]
            out[rest] = mix(out[rest] * np.uint64(0xD6E8FEB86659FD93) ^ piece)
            at += 8
            rest = rest[size[rest] > at]
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def strings(self) -> pa.Array:
        """All words as one Arrow array of binaries."""
        lengths = self.ends - self.starts
        offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=offsets[1:])
        at = np.arange(offsets[-1]) + np.repeat(self.starts - offsets[:-1], lengths)
        return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])])


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Mask over word positions: a window of that size starts here and stays in its document."""
    ok = np.zeros(int(first[-1]), dtype=bool)
    if len(ok):
        edge = np.zeros(len(ok) + 1, dtype=np.int64)
        long = np.diff(first) >= size
        np.add.at(edge, first[:-1][long], 1)
        np.add.at(edge, first[1:][long] - size + 1, -1)
        ok = np.cumsum(edge[:-1]) > 0
    return ok


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` neighbours, by doubling: log2(size) passes."""
    out, span = values, 1
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (size - span)], out[size - span :]) if span < size else out


def release_memory() -> None:
    """Give freed memory back to the system: a worker is used again and again, and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in ``column``; at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column_data = batch.column(column)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column_data), 0).to_numpy(zero_copy_only=False))
        row = 0
        while row < batch.num_rows:
            done = sizes[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(row, end - row)
            row = end
        del batch, column_data
        release_memory()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Slots:
    """An open-addressed table from keys to values, built and probed by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = np.uint64(64 - max(10, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.mask = size - 1
        self.key, self.value = np.full(size, 2**64 - 1, dtype=np.uint64), np.zeros(size, dtype=np.asarray(values).dtype)
        at, rest = (mix(keys) >> self.bits).astype(np.int64), np.arange(len(keys))
        while len(rest):
            free = self.key[at] == np.uint64(2**64 - 1)
            self.key[at[free]] = keys[rest[free]]  # of several for one slot, the last stays
            self.value[at[free]] = values[rest[free]]
            lost = self.key[at] != keys[rest]
            rest, at = rest[lost], (at[lost] + 1) & self.mask

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        at = (mix(keys) >> self.bits).astype(np.int64)
        out = self.value[at]
        rest = np.flatnonzero(self.key[at] != keys)
        at = at[rest]
        while len(rest):
            none = self.key[at] == np.uint64(2**64 - 1)
            out[rest[none]] = missing
            rest, at = rest[~none], (at[~none] + 1) & self.mask
            hit = self.key[at] == keys[rest]
            out[rest[hit]] = self.value[at[hit]]
            rest, at = rest[~hit], at[~hit]
        return out
