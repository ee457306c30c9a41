"""SentencePiece sampling: forward filtering and backward sampling over the piece lattice.

A text (with the dummy space in front) is cut before each run of spaces and around control characters; in the lattice no piece
crosses such a cut, so the lattice of a text is the chain of its chunks' lattices and each distinct chunk is filtered once.
A piece of rank r in the vocabulary weighs (r + 2) ** -SHARPNESS. The forward pass sums the weights of all segmentations up
to each character; the backward pass draws, from a chunk's end, the last piece with its share of that sum, and so on.

Every draw is a hash of (seed, row key, place of the chunk in the row, step): the same row is segmented alike wherever and however
often it is processed. Characters without a piece, and the character U+2581 that pieces use for a space, are spelled in
byte pieces, so decoding gives back the exact text.

Defined cases: null and empty text have no pieces; a null row key draws like key -1; rows that repeat a key draw alike; an empty
table has no rows; further columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import _SYMBOL_OF_BYTE, BYTES, Slots, chunks, mix

SHARPNESS, SEED, CHUNK = 1.0, 20240229, 4 << 20
_SPACE_MARK = "▁"


class Vocabulary:
    """Pieces by the hash of their bytes, all their prefixes, and byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, dtype=np.int64)
        known: dict[bytes, int] = {}
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.bytes_of[k] = piece.replace(_SPACE_MARK, " ").encode()
                crosses = " " in piece.lstrip(_SPACE_MARK).replace(_SPACE_MARK, " ") or (len(piece) > 1 and any(ord(c) < 32 for c in piece))
                if not crosses:
                    known[self.bytes_of[k]] = k
        rank = {k: r for r, k in enumerate(sorted(known.values(), key=lambda k: (-model.get_score(k), k)))}
        self.weight = np.zeros(size)
        for k, r in rank.items():
            self.weight[k] = -SHARPNESS * np.log(r + 2)
        self.byte_weight = -SHARPNESS * np.log(len(rank) + 2)
        # every prefix of a piece, with the piece it is, or -1
        table: dict[bytes, int] = {}
        for piece, k in known.items():
            text = piece.decode()
            for j in range(1, len(text)):
                table.setdefault(text[:j].encode(), -1)
        table |= known
        keys = [np.frombuffer(x, np.uint8) for x in table]
        flat = np.concatenate(keys)
        ends = np.cumsum([len(x) for x in keys])
        hashes = BYTES.span(BYTES.prefix(_SYMBOL_OF_BYTE[flat]), ends - [len(x) for x in keys], ends)
        self.prefixes = Slots(hashes, np.array(list(table.values()), dtype=np.float64))
        self.decode_size = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.decode_first = np.cumsum(self.decode_size) - self.decode_size
        self.decode_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)


class Lattices:
    """Forward-filtered lattices of distinct chunks: sampling tables over all their edges."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> None:
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.append(chars, len(data))  # byte position of each character
        chunk_of = np.searchsorted(offsets, chars, side="right") - 1
        first = np.searchsorted(chars, offsets)  # first character of each chunk
        prefix = BYTES.prefix(_SYMBOL_OF_BYTE[data])
        begin, end, piece = [], [], []
        active = np.arange(len(chars))
        limit = first[1:][chunk_of] if len(chars) else active
        length = 1
        while len(active):
            active = active[active + length <= limit[active]]
            found = vocabulary.prefixes.get(BYTES.span(prefix, at[active], at[active + length]), -2.0) if len(active) else np.zeros(0)
            hit = found >= 0
            begin.append(active[hit]), end.append(active[hit] + length), piece.append(found[hit].astype(np.int64))
            if length == 1:  # characters without a piece of their own are spelled in bytes
                spelled = active[~hit]
                begin.append(spelled), end.append(spelled + 1), piece.append(np.full(len(spelled), -1))
            active = active[found > -2]
            length += 1
        begin, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begin, end, piece))
        size = at[end] - at[begin]
        weight = np.where(piece >= 0, vocabulary.weight[np.maximum(piece, 0)], vocabulary.byte_weight * size)
        # a node is a chunk's start, or the end of a character: character c ends in node c + 1 + its chunk
        node = end + chunk_of[begin] if len(begin) else end
        source = begin + chunk_of[begin] if len(begin) else begin
        order = np.argsort(node, kind="stable")
        self.source, self.node, self.piece = source[order], node[order], piece[order]
        self.byte_first, self.size = at[begin][order], size[order]
        weight = weight[order]
        n_nodes = len(chars) + len(offsets) - 1
        self.start = first[:-1] + np.arange(len(offsets) - 1)
        self.end = first[1:] + np.arange(len(offsets) - 1)
        alpha = np.zeros(n_nodes)
        depth = (end - first[chunk_of[begin]])[order] if len(begin) else end
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(1, (depth.max() if len(depth) else 0) + 2))
        score = np.zeros(len(weight))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # all nodes so many characters into their chunk
            e = by_depth[lo:hi]
            score[e] = alpha[self.source[e]] + weight[e]
            own = self.node[e]
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.maximum.reduceat(score[e], head)
            spread = np.repeat(best, np.diff(np.append(head, len(e))))
            alpha[own[head]] = best + np.log(np.add.reduceat(np.exp(score[e] - spread), head))
        share = np.exp(score - alpha[self.node]) if len(score) else score
        total = np.cumsum(share)
        head = np.searchsorted(self.node, self.node)
        share = total - np.where(head > 0, total[head - 1], 0.0) if len(score) else score
        last = np.append(self.node[1:] != self.node[:-1], True) if len(score) else np.zeros(0, bool)
        self.ladder = self.node + np.where(last, 1.0, np.minimum(share, 1.0))

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each node, one of the edges into it."""
        return np.searchsorted(self.ladder, node + u, side="right")


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with the dummy space before each text that isn't empty, the chunks' starts, and the texts' offsets in chunks."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    some = (size > 0).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size + some)])
    data = np.full(int(offsets[-1]), 0x20, dtype=np.uint8)
    raw = np.frombuffer(b"".join(texts.to_pylist()), dtype=np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.cumsum(some), size)] = raw
    control, space = data < 0x20, data == 0x20
    new = control | space
    new[1:] &= control[1:] | ~space[:-1]
    new[1:] |= control[:-1]
    if len(new):
        new[offsets[:-1][size > 0]] = True
    starts = np.flatnonzero(new)
    return data, starts, np.searchsorted(starts, offsets)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def sample(texts: pa.Array, keys: np.ndarray, path: str, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts, and the texts' offsets in them."""
    v = vocabulary(path)
    data, starts, first = _cut(texts)
    ends = np.append(starts[1:], len(data))
    offsets = np.append(starts, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    kinds = coded.dictionary
    kind_offsets = np.frombuffer(kinds.buffers()[1], np.int64, count=len(kinds) + 1) if len(kinds) else np.zeros(1, np.int64)
    kind_data = np.frombuffer(kinds.buffers()[2], np.uint8)[: kind_offsets[-1]] if len(kinds) and kinds.buffers()[2] is not None else np.zeros(0, np.uint8)
    lattice = Lattices(v, kind_data, kind_offsets)
    kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_chunks = np.diff(first)
    row = np.repeat(np.arange(len(n_chunks)), n_chunks)
    place = np.arange(len(kind)) - first[row]
    state = mix(mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed))[row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    node, goal = lattice.end[kind], lattice.start[kind]
    at = np.arange(len(kind))
    steps = []
    while len(at):
        u = (mix(state[at] + np.uint64((len(steps) + 1) * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = lattice.draw(node, u)
        steps.append((at, edge))
        node = lattice.source[edge]
        going = node != goal
        at, node, goal = at[going], node[going], goal[going]
    count = np.zeros(len(kind), dtype=np.int64)
    for where, edge in steps:
        count[where] += np.where(lattice.piece[edge] < 0, lattice.size[edge], 1)
    after = np.cumsum(count)
    out = np.zeros(int(after[-1]) if len(after) else 0, dtype=np.int64)
    hand = after.copy()  # pieces come from the last to the first
    for where, edge in steps:
        whole = lattice.piece[edge] >= 0
        w, e = where[whole], edge[whole]
        hand[w] -= 1
        out[hand[w]] = lattice.piece[e]
        w, e = where[~whole], edge[~whole]
        hand[w] -= lattice.size[e]
        for k in range(int(lattice.size[e].max()) if len(e) else 0):
            more = lattice.size[e] > k
            out[hand[w[more]] + k] = v.byte_id[kind_data[lattice.byte_first[e[more]] + k]]
    total = np.concatenate([[0], after])
    return out, total[first]


def decode(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[bytes]:
    """The texts of id sequences."""
    v = vocabulary(path)
    size = v.decode_size[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    flat = v.decode_flat[np.repeat(v.decode_first[ids] - total[:-1], size) + np.arange(int(total[-1]))].tobytes()
    edge = total[offsets].tolist()
    return [flat[i + (j > i) : j] for i, j in zip(edge[:-1], edge[1:], strict=True)]


def encode(docs: DataFrame, path: str, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (unsigned 32-bit little-endian ids), lossless, and the ids if asked for."""
    names = ["doc_id", "n_pieces", "ids_crc32", "lossless", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            keys = pc.fill_null(batch.column("doc_id"), -1).to_numpy(zero_copy_only=False)
            ids, at = sample(batch.column("text"), keys, path, seed)
            back = decode(ids, at, path)
            same = [x == (y or b"") for x, y in zip(back, batch.column("text").cast(pa.binary()).to_pylist(), strict=True)]
            packed, edge = ids.astype("<u4").tobytes(), (4 * at).tolist()
            crc = [zlib.crc32(packed[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            columns = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids)
