"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its distinct SHINGLE-word shingles. Two sets link when
100 * |x & y| >= PERCENT * |x | y|.

* Equal sets are one node, named by a hash of the set, with its smallest document. A task sends each node once, so a group of copies
  that holds a third of all rows costs one row for each task.
* Hashes are ordered from rare to frequent by a count sketch of fixed width (any order is correct, a good one is fast).
  Of each set only its prefix enters an index list: two linked sets share an element of their prefixes.
* Index-level skipping: a list is sorted by set size, and its entries carry the position in their set. For an
  entry, sizes that can't link are skipped by a binary search, and positions that leave too little of either
  set behind are skipped as a whole.
* Pairs are counted over the short lists. Two sets share at most what their prefixes share, and what lies behind the longer prefix;
  pairs for which that isn't enough are dropped before any set is fetched. Of the others, a set's best partner is compared
  first; later only pairs of different components are, so a group of near copies doesn't cost all its pairs.
* Answer-level skipping: in a long list (over SHORT entries) every set is first compared with the list's leader only, the set with
  the fewest elements that long lists don't have: what a group of near copies has in common is likest to that.
  Sets that link to it are answered by its component. What is left, sets of different components, derives its candidates
  from the leader's answers: d(x, y) >= |d(x, leader) - d(y, leader)|, so partners whose distance to the leader differs by
  more than the threshold are skipped without looking at them.
* Candidates are verified on the whole sets. Components of the verified links are exact: two sets that link share a list;
  there they are compared, or are in one component already, or a bound excludes the link. Only the texts of candidates are
  fetched: a bit filter of fixed size lets through at least these, whatever their number.

Equality of words and shingles is that of 64-bit hashes; two sets with one name, which would be two different sets, raise an error.

Defined cases: null, empty and blank text have the empty set, link with nothing and are their own component; with fewer words
than SHINGLE the whole sequence is one shingle; rows that repeat a doc_id are in one component, whatever their texts; a null doc_id
has no component and no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import stored
from .text import WORDS, Words, chunks, mix, signed, window_starts

SHINGLE, PERCENT, SHORT = 5, 75, 12
#: Counters of the sketch, bits of the filter, and the slices in which either is added up.
SKETCH, FILTER, SLICES = 1 << 18, 1 << 23, 64


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sets, sorted in each, and the offsets of the documents."""
    words = Words(texts, lower=True)
    prefix = WORDS.prefix(words.hashes())
    starts = np.flatnonzero(window_starts(words.first, size))
    row = np.searchsorted(words.first, starts, side="right") - 1
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    h = np.concatenate([WORDS.span(prefix, starts, starts + size), WORDS.span(prefix, words.first[few], words.first[few + 1])])
    row = np.concatenate([row, few])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(words.n_docs + 1))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5BF03635)) % np.uint64(SKETCH)).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _slices(values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's array, cut into SLICES rows that hold something."""
    cut = values.reshape(SLICES, -1)
    used = [k for k in range(SLICES) if cut[k].any()]
    return pa.array(used, pa.int32()), pa.array([zlib.compress(cut[k].astype("<i8").tobytes(), 1) for k in used], pa.binary())


def _added(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' arrays (rows of slice and part); its size is fixed, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size // SLICES, dtype=np.int64)
        for data in table.column("part"):
            total += np.frombuffer(zlib.decompress(data.as_buffer()), "<i8")
        return pa.table({"slice": table.column("slice").slice(0, 1), "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = np.zeros((SLICES, size // SLICES), dtype=np.int64)
    # two steps: the rows of a slice are as many as tasks
    some = rows.withColumn("salt", F.spark_partition_id() % 16).groupBy("slice", "salt").applyInArrow(add, "slice int, part binary")
    for row in some.groupBy("slice").applyInArrow(add, "slice int, part binary").toArrow().to_pylist():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["part"]), "<i8")
    return out.reshape(-1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, s1, s2) of all documents, and a task's part of the sketch."""
    total = np.zeros(SKETCH, dtype=np.int64)
    for batch in chunks(batches):
        h, at = shingle_sets(batch.column("text"))
        total += np.bincount(_bucket(h), minlength=SKETCH)
        s1, s2 = _names(h, at)
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(s1), pa.array(s2), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=["doc_id", "n", "s1", "s2", "slice", "part"])
    which, part = _slices(total)
    none = pa.nulls(len(which), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, which, part], names=["doc_id", "n", "s1", "s2", "slice", "part"])


def _names(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; the first is its node."""
    return signed(mix(_sums(mix(h), at))), signed(_sums(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), at))


def _least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest intersection with which sets of these sizes link."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _tail(n: np.ndarray) -> np.ndarray:
    """Elements behind a set's prefix."""
    return -(-PERCENT * n // 100) - 1


def _pairs_of_list(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Viable pairs of different components in one long list, whose entries are sorted by size. ``far`` is an entry's distance to
    the list's leader (NaN: not known), ``q`` the number of its elements that are in a list with others."""
    node, label, far, q = (rows[c] for c in ("node", "label", "far", "q"))
    n, pos = rows["meta"] >> 32, rows["meta"] & 0xFFFFFFFF
    left, right = [], []
    values, inverse = np.unique(label, return_inverse=True)
    common = inverse == np.bincount(inverse, minlength=len(values)).argmax()
    for i in np.flatnonzero(~common):
        # index-level skipping: sizes that can't link are not touched
        j = np.arange(np.searchsorted(n, -(-PERCENT * n[i] // 100)), np.searchsorted(n, 100 * n[i] // PERCENT, side="right"))
        least = _least_overlap(n[i], n[j])
        ok = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least) & (np.minimum(q[i], q[j]) + np.maximum(_tail(n[i]), _tail(n[j])) >= least)
        ok &= (label[j] != label[i]) & (common[j] | (j < i))
        ok &= ~(np.abs(far[j] - far[i]) > 1 - PERCENT / 100 + 1e-9)  # answer-level skipping
        j = j[ok]
        left.append(node[j])
        right.append(np.full(len(j), node[i]))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """From rows sorted by token and node: columns, and starts and sizes of whole lists of two entries or more."""

    def cut(now: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        fresh = np.append(True, (now["token"][1:] != now["token"][:-1]) | (now["node"][1:] != now["node"][:-1]))
        now = {c: v[fresh] for c, v in now.items()}
        start = np.flatnonzero(np.append(True, now["token"][1:] != now["token"][:-1]))
        return now, start, np.diff(np.append(start, len(now["token"])))

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        if not len(now["token"]):
            continue
        now, start, size = cut(now)
        several = size[:-1] > 1
        yield now, start[:-1][several], size[:-1][several]
        held = {c: v[start[-1] :] for c, v in now.items()}
    if held is not None and len(held["token"]):
        now, start, size = cut(held)
        yield now, start[size > 1], size[size > 1]


#: Marks pairs with a leader, above any number of lists.
LEADER = 1 << 40
_FOUND = "a long, b long, kind int, meta long, lead long, c long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, kind, meta, lead, c): kind 0 pairs of nodes that c short lists hold, with their sizes (lead: how many of these could
    be the first that they share), 1 entries (token, node) of long lists, 2 nodes that c lists hold with others."""
    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def put(a: np.ndarray, b: np.ndarray, kind: int, meta: np.ndarray, lead: np.ndarray | int, c: np.ndarray) -> None:
        nonlocal waiting
        held.append((a, b, np.full(len(a), kind), meta, np.broadcast_to(lead, len(a)), c))
        waiting += len(a)

    def flush() -> pa.RecordBatch:
        nonlocal waiting
        a, b, kind, meta, lead, c = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64) for _ in range(6))
        held.clear()
        waiting = 0
        order = np.lexsort((b, a, kind))
        a, b, kind, meta, lead, c = (x[order] for x in (a, b, kind, meta, lead, c))
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1]))) if len(a) else np.zeros(0, np.int64)
        if len(head):  # the entries of long lists are single
            c, lead = np.add.reduceat(c, head), np.where(kind[head] == 0, np.add.reduceat(lead * (kind == 0), head), lead[head])
        return pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(kind[head].astype(np.int32)), pa.array(meta[head]), pa.array(lead), pa.array(c)], names=["a", "b", "kind", "meta", "lead", "c"])

    def put_pairs(x: np.ndarray, y: np.ndarray) -> None:
        near = 100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])
        x, y = x[near], y[near]
        swap = node[x] > node[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        first = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= _least_overlap(n[x], n[y])
        put(node[x], node[y], 0, (n[x] << 32) | n[y], first.astype(np.int64), np.ones(len(x), np.int64))

    for rows, start, size in _lists(batches):
        node, n, pos = rows["node"], rows["meta"] >> 32, rows["meta"] & 0xFFFFFFFF
        for k in range(2, SHORT + 1):
            at = start[size == k]
            if len(at):
                i, j = np.triu_indices(k, 1)
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                put_pairs(x, y)
        for at, k in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            put(np.full(k, int(rows["token"][at])), node[at : at + k], 1, rows["meta"][at : at + k], 0, np.zeros(k, np.int64))
        if len(start):
            inside = np.zeros(len(node) + 1, dtype=np.int64)
            inside[start] += 1
            inside[start + size] -= 1
            who, times = np.unique(node[np.cumsum(inside[:-1]) > 0], return_counts=True)
            none = np.zeros(len(who), np.int64)
            put(who, none, 2, none, 0, times)
        if waiting > 500_000:
            yield flush()
    yield flush()


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of long lists with their list's leader, and its size."""
    for rows, start, size in _lists(batches):
        n = rows["meta"] >> 32
        alone = n - _tail(n) - rows["l"]  # elements of the prefix that no long list has
        out = {c: [] for c in ("token", "node", "meta", "lead", "size")}
        for at, k in zip(start.tolist(), size.tolist(), strict=True):
            best = at + int(np.lexsort((rows["node"][at : at + k], alone[at : at + k]))[0])
            for c in ("token", "node", "meta"):
                out[c].append(rows[c][at : at + k])
            out["lead"].append(np.full(k, rows["node"][best]))
            out["size"].append(np.full(k, n[best]))
        if len(start):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))


def _later_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in long lists that no bound excludes."""
    for columns, start, size in _lists(batches):
        for at, k in zip(start.tolist(), size.tolist(), strict=True):
            rows = {c: v[at : at + k] for c, v in columns.items()}
            order = np.lexsort((rows["node"], rows["meta"] >> 32))
            x, y = _pairs_of_list({c: v[order] for c, v in rows.items()})
            tried = (x == rows["lead"][0]) | (y == rows["lead"][0])
            x, y = x[~tried], y[~tried]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _bits_of(ids: np.ndarray) -> np.ndarray:
    x = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([x % np.uint64(FILTER), (x >> np.uint64(32)) % np.uint64(FILTER)]).astype(np.int64)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit filter of the column doc_id: FILTER bits, whatever the input."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, dtype=bool)
        for batch in batches:
            bits[_bits_of(batch.column("doc_id").to_numpy(zero_copy_only=False))] = True
        which, part = _slices(np.packbits(bits).view("<i8").copy())
        yield pa.RecordBatch.from_arrays([which, part], names=["slice", "part"])

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros(FILTER // 64 // SLICES, dtype=np.int64)
        for data in table.column("part"):
            total |= np.frombuffer(zlib.decompress(data.as_buffer()), "<i8")
        return pa.table({"slice": table.column("slice").slice(0, 1), "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = np.zeros((SLICES, FILTER // 64 // SLICES), dtype=np.int64)
    some = ids.mapInArrow(mark, "slice int, part binary").withColumn("salt", F.spark_partition_id() % 16).groupBy("slice", "salt").applyInArrow(join, "slice int, part binary")
    for row in some.groupBy("slice").applyInArrow(join, "slice int, part binary").toArrow().to_pylist():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["part"]), "<i8")
    return np.unpackbits(out.reshape(-1).view(np.uint8)).astype(bool)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, union = [], []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common.append(int((y[at] == x).sum()))
            union.append(len(x) + len(y) - common[-1])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "both"])


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of nodes with the sizes of their intersection and union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node").select(F.col("rep").alias("doc_id"))
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter_of(ids)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = np.unpackbits(wanted.value).astype(bool), set()
        for batch in batches:
            chosen = batch.filter(pa.array(bits[_bits_of(batch.column("doc_id").to_numpy(zero_copy_only=False))].all(axis=0)))
            for some in chunks(iter([chosen])):
                h, at = shingle_sets(some.column("text"))
                node, _ = _names(h, at)
                fresh = [k for k, x in enumerate(node.tolist()) if at[k + 1] > at[k] and x not in sent and not sent.add(x)]
                yield pa.RecordBatch.from_arrays([pa.array(node[fresh]), pa.array([h[at[k] : at[k + 1]].tobytes() for k in fresh], pa.binary())], names=["node", "set"])

    # merge joins throughout: the same plan at every size, and no set of ids or texts is ever broadcast
    found = stored(docs.mapInArrow(sets, "node long, set binary").groupBy("node").agg(F.any_value("set").alias("set")))
    x, y = found.select(F.col("node").alias("a"), F.col("set").alias("x")), found.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").mapInArrow(_verify, "a long, b long, common long, both long")


def _linked(verified: DataFrame) -> DataFrame:
    return verified.filter(100 * F.col("common") >= PERCENT * F.col("both")).select("a", "b")


def _viable(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b, lead, c) that may link: some list may be the first that they share, and what their prefixes share (c in short
    lists, and what long lists hold of either) and what lies behind the longer prefix are enough."""
    at = {side: held.select(F.col("node").alias(side), F.col("l").alias(f"l_{side}")) for side in "ab"}
    both = pairs.join(at["a"], "a", "left").join(at["b"], "b", "left").withColumns({"na": F.expr("shiftright(meta, 32)"), "nb": F.expr("meta & 4294967295")})
    least = F.expr(f"({PERCENT} * (na + nb) + {99 + PERCENT}) div {100 + PERCENT}")
    tail = F.expr(f"({PERCENT} * greatest(na, nb) + 99) div 100 - 1")
    return both.filter(F.col("c") + F.least(F.coalesce("l_a", F.lit(0)), F.coalesce("l_b", F.lit(0))) + tail >= least).select("a", "b", "lead", "c")


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, n, rep) and a set of verified links (a, b) between representatives that spans all components."""
    rows = _text(docs).filter("doc_id is not null")
    first = stored(rows.mapInArrow(_signatures, "doc_id long, n long, s1 long, s2 long, slice int, part binary"))
    own = first.filter("slice is null").select("doc_id", "n", F.col("s1").alias("node"), "s2")
    sets = stored(own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("s2").alias("s"), F.max("s2").alias("t"), F.min("n").alias("m"), F.max("n").alias("n")))
    if not sets.filter("s <> t or m <> n").isEmpty():
        raise RuntimeError("two different sets have the same hash")
    reps = sets.select("node", "rep")
    classes = own.join(reps.withColumnRenamed("node", "_node"), (F.col("n") > 0) & (F.col("node") == F.col("_node")), "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    # fixed width, whatever the input
    order = docs.sparkSession.sparkContext.broadcast(_added(first.filter("slice is not null").select("slice", "part"), SKETCH))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, sent = order.value, set()
        for batch in chunks(batches):
            h, at = shingle_sets(batch.column("text"))
            n = np.diff(at)
            node, _ = _names(h, at)
            fresh = np.array([size > 0 and x not in sent and not sent.add(x) for x, size in zip(node.tolist(), n.tolist(), strict=True)], dtype=bool)
            h, row = h[np.repeat(fresh, n)], np.repeat(np.arange(len(n)), n * fresh)
            by = np.lexsort((h, frequency[_bucket(h)], row))
            position = np.arange(len(h)) - np.repeat((np.cumsum(n * fresh) - n * fresh)[fresh], n[fresh])
            keep = position < (n - _tail(n))[row]
            row = row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[by][keep])), pa.array(node[row]), pa.array((n[row] << 32) | position[keep])], names=["token", "node", "meta"])

    lists = rows.mapInArrow(prefixes, "token long, node long, meta long").repartition("token").sortWithinPartitions("token", "node")
    found = stored(lists.mapInArrow(_candidates, _FOUND))
    entries = found.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), "meta")
    held = stored(entries.groupBy("node").agg(F.count("*").alias("l")))
    led = entries.join(held, "node").repartition("token").sortWithinPartitions("token", "node").mapInArrow(_leaders, "token long, node long, meta long, lead long, size long")
    long = stored(led) if not held.isEmpty() else None
    pairs = found.filter("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("lead").alias("lead"), F.any_value("meta").alias("meta"))
    if long is not None:
        lead, own = F.col("lead") < F.col("node"), F.expr("shiftright(meta, 32)")
        sizes = F.shiftleft(F.when(lead, F.col("size")).otherwise(own), 32) + F.when(lead, own).otherwise(F.col("size"))
        near = 100 * F.least("size", own) >= PERCENT * F.greatest("size", own)
        with_leaders = long.filter((F.col("lead") != F.col("node")) & near).select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(LEADER).alias("lead"), sizes.alias("meta")).distinct()
        pairs = pairs.unionByName(with_leaders).groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("lead").alias("lead"), F.any_value("meta").alias("meta"))
    pairs = pairs.filter("lead > 0")
    viable = stored(_viable(pairs, held))
    sides = viable.select(F.col("a").alias("node"), F.col("b").alias("other"), "c").unionByName(viable.select(F.col("b").alias("node"), F.col("a").alias("other"), "c"))
    best = sides.groupBy("node").agg(F.max(F.struct("c", "other")).alias("m")).select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b"))
    tried = stored(_verified(stored(viable.filter(F.col("lead") >= LEADER).select("a", "b").unionByName(best).distinct()), rows, reps))
    links = _linked(tried)
    label = stored(components(links))
    of = {side: label.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")) for side in "ab"}
    later = viable.join(of["a"], "a", "left").join(of["b"], "b", "left").filter(~F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False))).select("a", "b")
    if long is not None:
        distance = (1 - F.col("common") / F.col("both")).alias("far")
        far = tried.select(F.col("a").alias("lead"), F.col("b").alias("node"), distance).unionByName(tried.select(F.col("b").alias("lead"), F.col("a").alias("node"), distance))
        shared = found.filter("kind = 2").groupBy(F.col("a").alias("node")).agg(F.sum("c").alias("q"))
        known = long.join(label, "node", "left").join(far, ["lead", "node"], "left").join(shared, "node")
        known = known.select("token", "node", "meta", "lead", F.coalesce("component", "node").alias("label"), F.when(F.col("node") == F.col("lead"), 0.0).otherwise(F.coalesce("far", F.lit(float("nan")))).alias("far"), "q")
        later = later.unionByName(known.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_later_pairs, "a long, b long")).distinct()
    later = stored(later.join(tried, ["a", "b"], "left_anti"))
    if not later.isEmpty():
        links = stored(links.unionByName(_linked(_verified(later, rows, reps))))
    names = [reps.select(F.col("node").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab"]
    spanning = links.join(names[0], "a").join(names[1], "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # several texts of one doc_id belong together
    least = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_z")).filter("a < _z").select("doc_id", "a")
    return classes, spanning.unionByName(classes.join(least, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b")))


def join_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with a doc_id: doc_id, n_shingles, class_id (smallest document with the same set), component_id."""
    classes, links = jaccard_links(docs)
    found = components(links).withColumnRenamed("node", "rep")
    return classes.join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
