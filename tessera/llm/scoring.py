"""LM scoring by context-tree weighting over bytes, beside an add-one unigram model of words.

The model reads a text as its lower-cased words joined by one space, and an end symbol (byte 0xFF, which UTF-8 never
has); DEPTH further 0xFF stand before it, so every byte has a full context. A byte is decomposed into its eight bits, each
predicted in the context of the preceding bytes and of the byte's earlier bits. Every node, a context of 0 to DEPTH bytes
with a bit prefix, has a Krichevsky-Trofimov estimate; a node's weighted probability is half its own and half the product of
its children's, which gives every depth its posterior weight. The probability of a bit is the mixture along its context path.
A path ends at the deepest context that training has seen.

All this is a function of (context, byte), so texts are scored by a table of these grams. Documents are dealt into
blocks of BLOCK_BYTES. A block sends its distinct words, and for each part of the tree its distinct grams as one compressed row
(sorted keys as differences). A part is what shares the two nearest context bytes, by their hash; it is weighted on its own, and
every block gets back the values of the grams it sent, in their order. So the block, which finds its grams again, scores its
texts in one pass, and nothing that grows with the corpus is broadcast. Only nodes of depth 0 and 1, at most 257 * 255, go through
the driver.

Defined cases: null and empty text have the end symbol alone; without training documents every bit costs one bit and counts
are zero; rows that repeat a doc_id are scored each on its own text; a null doc_id is held out of training; an
empty table has no rows; further columns, whatever their names, are only read where the training condition names them.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import releasing_shuffles, stored
from .text import Words, chunks, mix, release_memory

DEPTH, BLOCK_BYTES = 6, 24 << 20
#: Text at once when words are looked up, and when grams are made (these take some 60 bytes for each byte of text); grams held before they are merged.
CHUNK, GRAM_CHUNK, HELD = 2 << 20, 1 << 19, 1_500_000
_END = 0xFF


def _stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in the model's form with DEPTH end symbols before each, and where each text's own bytes begin and end."""
    size = words.ends - words.starts + 1
    doc = words.doc_of_word()
    body = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=body[1:])
    empty = (words.counts == 0).astype(np.int64)
    before = (np.cumsum(empty) - empty) + DEPTH * (np.arange(words.n_docs) + 1)
    first = body[words.first[:-1]] + before
    last = first + np.diff(body[words.first]) + empty
    out = np.full(int(last[-1]) if len(last) else 0, _END, dtype=np.uint8)
    at = body[:-1] + before[doc] if len(doc) else np.zeros(0, dtype=np.int64)
    length = size - 1
    offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + offset] = words.data[np.repeat(words.starts, length) + offset]
    gap = at + length
    closing = np.zeros(len(gap), dtype=bool)
    closing[words.first[1:][words.counts > 0] - 1] = True
    out[gap[~closing]] = 0x20
    return out, np.stack([first, last])


def _grams(stream: np.ndarray) -> np.ndarray:
    """For each position from DEPTH on: the context, nearest byte first, and the byte."""
    x = stream.astype(np.uint64)
    n = len(x) - DEPTH
    key = x[DEPTH : DEPTH + n].copy()
    for d in range(1, DEPTH + 1):
        key |= x[DEPTH - d : DEPTH - d + n] << np.uint64(8 * (DEPTH + 1 - d))
    return key


def _own(spans: np.ndarray, size: int) -> np.ndarray:
    """Mask of positions that belong to a text, not to the symbols before it."""
    edge = np.zeros(size + 1, dtype=np.int64)
    edge[spans[0]] += 1
    np.add.at(edge, spans[1], -1)
    return np.cumsum(edge[:-1]) > 0


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of sorted parts with the sums of their numbers, range by range: no copy of the whole is ever sorted."""
    size = sum(len(k) for k, _ in parts)
    keys, counts = np.empty(size, dtype=np.uint64), np.empty(size, dtype=kind)
    lowest, highest = min((int(k[0]) for k, _ in parts if len(k)), default=0), max((int(k[-1]) for k, _ in parts if len(k)), default=0)
    ranges = max(1, min(256, size >> 12))
    edges = np.array([lowest + (highest + 1 - lowest) * r // ranges for r in range(ranges + 1)], dtype=np.uint64)
    cuts = [np.searchsorted(k, edges) for k, _ in parts]
    done = 0
    for r in range(ranges):
        held = [(k[c[r] : c[r + 1]], n[c[r] : c[r + 1]]) for (k, n), c in zip(parts, cuts, strict=True) if c[r + 1] > c[r]]
        if not held:
            continue
        key, n = held[0] if len(held) == 1 else (np.concatenate(x) for x in zip(*held, strict=True))
        if len(held) > 1:
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[head], np.add.reduceat(n, head, dtype=kind)
        keys[done : done + len(key)], counts[done : done + len(key)] = key, n
        done += len(key)
    return keys[:done].copy(), counts[:done].copy()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as bytes: differences, byte planes, zlib."""
    step = np.diff(keys, prepend=np.uint64(0))
    return zlib.compress(step.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def _runs(keys: np.ndarray, parts: int) -> dict[int, list[slice]]:
    """Where the sorted keys of each part of the tree stand: a part holds contexts whose two nearest bytes have its hash, and keys
    of one such context are neighbours."""
    nearest = keys >> np.uint64(8 * (DEPTH - 1))
    head = np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    found: dict[int, list[slice]] = {}
    for part, a, b in zip((mix(nearest[head]) % np.uint64(parts)).tolist(), head.tolist(), np.append(head[1:], len(keys)).tolist(), strict=True):
        found.setdefault(part, []).append(slice(a, b))
    return found


def _gram_table(texts: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of some texts, sorted, and their numbers in training texts."""
    found = []
    for flag in (True, False):
        chosen = texts.filter(pa.array(train == flag))
        if len(chosen):
            stream, spans = _stream(Words(chosen, lower=True))
            key, n = np.unique(_grams(stream)[_own(spans, len(stream))[DEPTH:]], return_counts=True)
            found.append((key, (n * int(flag)).astype(np.uint32)))
    return _merge(found)


def _block_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in chunks(iter(table.to_batches()), limit=GRAM_CHUNK):
        held.append(_gram_table(batch.column("text"), batch.column("train").to_numpy(zero_copy_only=False)))
        size += len(held[-1][0])
        if size > HELD + len(held[0][0]):
            held = [_merge(held)]
            size = len(held[0][0])
    return _merge(held)


def _count_block(parts: int):  # noqa: ANN202
    """Distinct words of a block with their numbers in training texts, and its grams for each part of the tree."""

    def run(table: pa.Table) -> pa.Table:
        words_seen = []
        for batch in chunks(iter(table.to_batches()), limit=CHUNK):
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for flag in (True, False):
                chosen = batch.column("text").filter(pa.array(train == flag))
                if len(chosen):
                    counted = Words(chosen, lower=True).strings().value_counts()
                    words_seen.append(pa.table({"word": counted.field("values").cast(pa.binary()), "n": counted.field("counts").to_numpy(zero_copy_only=False) * int(flag)}))
            if len(words_seen) > 16:
                words_seen = [pa.concat_tables(words_seen).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
        seen = pa.concat_tables(words_seen).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        key, n = _block_grams(table)
        runs = _runs(key, parts)
        mine = sorted(runs)
        keys = [_pack(np.concatenate([key[r] for r in runs[p]])) for p in mine]
        counts = [zlib.compress(np.concatenate([n[r] for r in runs[p]]).astype("<u4").tobytes(), 1) for p in mine]
        del key, n
        block = table.column("block")[0].as_py()
        size, more = seen.num_rows, len(mine)
        release_memory()
        return pa.table(
            {
                "block": pa.array(np.full(size + more, block, dtype=np.int32)),
                "word": pa.chunked_array([*seen.column("word").chunks, pa.nulls(more, pa.binary())], pa.binary()),
                "n": pa.array(np.concatenate([seen.column("n").to_numpy(), np.zeros(more, np.int64)]).astype(np.int64)),
                "part": pa.array(np.concatenate([np.full(size, -1), mine]).astype(np.int32)),
                "keys": pa.chunked_array([pa.nulls(size, pa.binary()), pa.array(keys, pa.binary())], pa.binary()),
                "counts": pa.chunked_array([pa.nulls(size, pa.binary()), pa.array(counts, pa.binary())], pa.binary()),
            }
        )

    return run


_TABLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(4096) + 0.5))]) + math.lgamma(0.5)
_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""

    def half(n: np.ndarray) -> np.ndarray:
        return np.where(n < 4096, _TABLE[np.minimum(n, 4095)], _stirling(np.maximum(n, 4000) + 0.5))

    total = n0 + n1
    return half(n0) + half(n1) - np.where(total < 4096, _FACTORIAL[np.minimum(total, 4095)], _stirling(np.maximum(total, 4000) + 1.0)) - math.log(math.pi)


def _weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the posterior weight of the node's own estimate."""
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def _fold(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, where each row went, and sums."""
    kinds, inverse = np.unique(key, return_inverse=True)
    return kinds, inverse, [np.bincount(inverse, v, minlength=len(kinds)) for v in values]


def _tree(gram: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """Nodes of one bit from depth DEPTH up to 2: (grams to deepest nodes, levels, keys at depth 2).

    A level is (way from the level below, ones, total, weight of the own estimate, log weighted probability)."""
    prefix = np.uint64(1 << bit)
    symbol = gram & np.uint64(0xFF)
    node = ((gram >> np.uint64(8)) << np.uint64(8)) | prefix | (symbol >> np.uint64(8 - bit))
    one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
    key, way, (n1, total) = _fold(node, n * one, n)
    lw = kt((total - n1).astype(np.int64), n1.astype(np.int64))
    levels = [(way, n1, total, np.ones(len(key)), lw)]
    for _ in range(DEPTH - 2):
        key = ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(0xFF))
        key, way, (n1, total, below) = _fold(key, n1, total, lw)
        lw, weight = _weighted(kt((total - n1).astype(np.int64), n1.astype(np.int64)), below)
        levels.append((way, n1, total, weight, lw))
    return one, levels, key


def _whole_part(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All grams of a part with their numbers, and the grams of each row."""
    rows = [_unpack(k) for k in table.column("keys").to_pylist()]
    counts = [np.frombuffer(zlib.decompress(c), "<u4") for c in table.column("counts").to_pylist()]
    key, n = _merge(list(zip(rows, counts, strict=True)), np.int64)  # numbers of the whole corpus
    return key, n, rows


def _shallow(table: pa.Table) -> pa.Table:
    """Sums at depth 1 of what the nodes of depth 2 hold."""
    gram, n, _ = _whole_part(table)
    out = []
    for bit in range(8):
        _, levels, key = _tree(gram, n, bit)
        _, n1, total, _, lw = levels[-1]
        key, _, (n1, total, lw) = _fold(((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(0xFF)), n1, total, lw)
        out.append(pa.table({"node": key.astype(np.int64), "n1": n1.astype(np.int64), "total": total.astype(np.int64), "below": lw}))
    return pa.concat_tables(out)


class Top:
    """Depths 1 and 0: one chance and one weight for each of at most 256 * 256 and 256 nodes."""

    def __init__(self, rows: list) -> None:
        self.n1, self.total, lw = np.zeros((2, 65536)), np.zeros((2, 65536)), np.zeros(65536)
        node = np.array([r["node"] for r in rows], dtype=np.int64)
        self.weight = np.ones((2, 65536))
        if len(node):
            n1, total = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("n1", "total"))
            lw[node], self.weight[1, node] = _weighted(kt(total - n1, n1), np.array([r["below"] for r in rows]))
            self.n1[1, node], self.total[1, node] = n1, total
            u = node & 0xFF
            self.n1[0, :256], self.total[0, :256] = np.bincount(u, n1, 256), np.bincount(u, total, 256)
            n1, total = self.n1[0, :256].astype(np.int64), self.total[0, :256].astype(np.int64)
            _, self.weight[0, :256] = _weighted(kt(total - n1, n1), np.bincount(u, lw[node], 256))

    def mix_in(self, context_byte: np.ndarray, u: np.ndarray, p: np.ndarray, seen: np.ndarray) -> np.ndarray:
        for depth, node in ((1, (context_byte << 8) | u), (0, u)):
            own = (self.n1[depth, node] + 0.5) / (self.total[depth, node] + 1)
            w = np.where(seen, self.weight[depth, node], 1.0)
            p = w * own + (1 - w) * p
            seen = self.total[depth, node] > 0
        return p


def _log_probabilities(gram: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context."""
    out = np.zeros(len(gram))
    nearest = (gram >> np.uint64(8 * DEPTH)).astype(np.int64)
    symbol = (gram & np.uint64(0xFF)).astype(np.int64)
    for bit in range(8):
        one, levels, _ = _tree(gram, n, bit)
        at = levels[0][0]
        n1, total = levels[0][1], levels[0][2]
        p, seen = ((n1 + 0.5) / (total + 1))[at], (total > 0)[at]
        for way, n1, total, weight, _ in levels[1:]:
            at = way[at]
            w = np.where(seen, weight[at], 1.0)
            p = w * ((n1 + 0.5) / (total + 1))[at] + (1 - w) * p
            seen = (total > 0)[at]
        p = top.mix_in(nearest, (1 << bit) | (symbol >> (8 - bit)), p, seen)
        out += np.log10(np.where(one == 1, p, 1 - p))
    return out


def price(texts: pa.Array, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probability and bytes of each text, from sorted grams and their values."""
    stream, spans = _stream(Words(texts, lower=True))
    mine = _own(spans, len(stream))[DEPTH:]
    each = np.zeros(len(mine))
    kinds, inverse = np.unique(_grams(stream)[mine], return_inverse=True)
    each[mine] = value[np.searchsorted(key, kinds)][inverse]
    total = np.concatenate([[0.0], np.cumsum(each)])
    return total[spans[1] - DEPTH] - total[spans[0] - DEPTH], spans[1] - spans[0]


RESULT = "n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double"


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if("train").alias("t")).first()
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-(size["b"] or 0) // BLOCK_BYTES))
    parts = max(64, 4 * blocks)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    found = stored(dealt.groupBy("block").applyInArrow(_count_block(parts), "block int, word binary, n long, part int, keys binary, counts binary"))

    words = found.filter("part < 0").select("block", "word", "n")
    counts = words.groupBy("word").agg(F.sum("n").alias("c"))
    grams = found.filter("part >= 0").select("block", "part", "keys", "counts")
    with releasing_shuffles(spark):
        top = Top(grams.groupBy("part").applyInArrow(_shallow, "node long, n1 long, total long, below double").groupBy("node").agg(F.sum("n1").alias("n1"), F.sum("total").alias("total"), F.sum("below").alias("below")).collect())
        sums = counts.agg(F.count_if(F.col("c") > 0).alias("v"), F.sum("c").alias("n")).first()

    def price_part(table: pa.Table) -> pa.Table:
        gram, n, rows_of = _whole_part(table)
        value = _log_probabilities(gram, n, top).astype("<f4")
        sent = [value[np.searchsorted(gram, own)].tobytes() for own in rows_of]
        size = table.num_rows
        return pa.table({"block": table.column("block"), "word": pa.nulls(size, pa.binary()), "c": pa.array(np.zeros(size)), "part": table.column("part"), "price": pa.array(sent, pa.binary())})

    ends = size["t"]
    n_train, kinds = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    known_words = words.drop("n").join(counts, "word").select("block", "word", F.col("c").cast("double").alias("c"), F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("price"))
    known_grams = grams.groupBy("part").applyInArrow(price_part, "block int, word binary, c double, part int, price binary")

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        is_gram = pc.greater_equal(known.column("part"), 0)
        own = known.filter(is_gram)
        key, _ = _block_grams(texts)
        value = np.zeros(len(key), dtype=np.float32)
        runs = _runs(key, parts)
        for p, data in zip(own.column("part").to_pylist(), own.column("price"), strict=True):
            sent, at = np.frombuffer(data.as_buffer(), "<f4"), 0
            for r in runs[p]:
                value[r] = sent[at : at + r.stop - r.start]
                at += r.stop - r.start
        del own, runs
        release_memory()
        own = known.filter(pc.invert(is_gram))
        names, count = own.column("word").combine_chunks().cast(pa.large_binary()), own.column("c").to_numpy()
        floor = n_train + kinds + 1
        out = []
        for batch in chunks(iter(texts.to_batches()), limit=CHUNK):
            words = Words(batch.column("text"), lower=True)
            coded = words.strings().dictionary_encode()
            if len(coded.dictionary):
                c = count[pc.index_in(coded.dictionary, names).to_numpy(zero_copy_only=False).astype(np.int64)][coded.indices.to_numpy(zero_copy_only=False)]
            else:
                c = np.zeros(0)
            doc = words.doc_of_word()
            base = np.bincount(doc, np.log10((c + 1) / floor), words.n_docs) + math.log10((ends + 1) / floor)
            hit = np.bincount(doc, c > 0, words.n_docs).astype(np.int64) + int(ends > 0)
            tokens = words.counts.astype(np.int64) + 1
            del words, coded, doc, c
            total, size = (np.concatenate(x) for x in zip(*(price(part.column("text"), key, value) for part in chunks(iter([batch]), limit=GRAM_CHUNK)), strict=True))
            out.append(
                pa.table(
                    {
                        "doc_id": batch.column("doc_id"), "train": batch.column("train"), "n_tokens": tokens, "n_known": hit, "base_score": base,
                        "score": total, "n_bytes": size.astype(np.int64), "bits_per_byte": -total / math.log10(2) / size,
                    }
                )
            )
        return pa.concat_tables(out)

    scored = dealt.groupBy("block").cogroup(known_words.unionByName(known_grams).groupBy("block")).applyInArrow(run, f"doc_id long, train boolean, {RESULT}")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", "bits_per_byte")
