"""Embedding near-dedup by NN-descent.

Equal vectors are one node with a multiplicity. A node's first neighbours come from TABLES LSH tables: nodes with the same
signs along random directions, sorted along one more, are compared in runs of RUN. Then the neighbour graph is refined: nodes that
share a neighbour are compared with each other, and each keeps its K nearest. Where a list is *saturated* (its K-th neighbour is
still within the threshold) K is doubled for that node, up to MOST, and stays doubled. Rounds end when lists no longer change, or
after ROUNDS. Only neighbours with a cosine of FLOOR or more are followed: two nodes within the threshold of a third are closer
than that.

Lists longer than MOST aren't kept, but no threshold edge is lost with them: every run of compared nodes also leaves its *ties*, one
row per linked node with the smallest node that links of the run reach. Components come from the ties of all runs. They are cut
into blocks, and the nodes of every two blocks of a component are compared in double precision; only counts and the ties that
hold exactly leave a block pair.

Audit: AUDIT nodes, half of them drawn from all nodes and half from all components (so that a large group doesn't hide the small
ones), are compared with all nodes by brute force. Recall is the mean over nodes of the share of their links that are found, the
lower one of the two halves. While it is below RECALL, new LSH tables and refinement follow, RETRIES times at most; a recall below
LEAST after that is an error.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept; vectors of
different lengths don't link; rows without vec_id are left out; rows that repeat a vec_id are one vector (the first by hash); an empty table has no rows;
further columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .session import released, stored

THRESHOLD, FLOOR, K, MOST = 0.95, 0.8, 8, 64
MARGIN = 1e-5  # of cosines in single precision
TABLES, RUN, ROUNDS, BLOCK = 12, 256, 8, 512
AUDIT, RECALL, LEAST, RETRIES, SEED = 512, 0.99, 0.9, 4, 7


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each vector length."""
    size = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        yield batch.filter(pa.array(size == d))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(sim.astype(np.float64))], names=["a", "b", "sim"])


def _near(ids: np.ndarray, x: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Within a run: each node's nearest, ``most`` at most, no nearer ones left out, cosine FLOOR or more; and the ties, without
    a cosine."""
    if len(ids) < 2:
        return
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    s = x @ x.T
    np.fill_diagonal(s, -1)
    keep = min(most, len(ids) - 1)
    part = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    sim = np.take_along_axis(s, part, axis=1)
    ok = sim >= FLOOR
    yield _edges(np.repeat(ids, ok.sum(axis=1)), ids[part[ok]], sim[ok])
    link = s >= THRESHOLD - MARGIN
    if link.any():
        root, _ = _roots(link, True)
        tied = np.flatnonzero(root != np.arange(len(ids)))
        yield _edges(ids[tied], ids[root[tied]], np.full(len(tied), np.nan))


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, m, same: nodes of this length) and the node of each valid vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id is not null")
    good = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    one = rows.groupBy("vec_id").agg(F.min_by("x", F.coalesce(F.xxhash64("x"), F.lit(0))).alias("x")).filter(F.coalesce(good, F.lit(False)))
    one = stored(one.withColumn("x", F.transform("x", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))))
    nodes = one.groupBy("x").agg(F.min("vec_id").alias("node"), F.count("*").alias("m")).withColumn("d", F.size("x"))
    nodes = stored(nodes.join(one.groupBy(F.size("x").alias("d")).agg(F.countDistinct("x").alias("same")), "d").drop("d"))
    return nodes, one.join(nodes.select("x", "node"), "x").select("vec_id", "node")


def _lsh(nodes: DataFrame, tables: int, seed: int) -> DataFrame:
    """Edges and ties between nodes that share an LSH bucket."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_length(whole)):
            x = _matrix(batch.column("x"))
            bits = int(np.clip(np.log2(batch.column("same")[0].as_py() / 64), 2, 30))
            planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((tables, x.shape[1], bits + 1)).astype(np.float32)
            for t in range(tables):
                side = x @ planes[t]
                bucket = ((side[:, :bits] > 0) << np.arange(bits)).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(np.full(len(x), t, np.int32)), pa.array(bucket), pa.array(side[:, bits].astype(np.float64)), batch.column("node"), pa.array(list(x), pa.list_(pa.float32()))],
                    names=["d", "t", "bucket", "along", "node", "x"],
                )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("d", "t", "bucket")):
            ids, x = group.column("node").to_numpy(), _matrix(group.column("x"))
            for i in range(0, max(len(ids) - RUN // 2, 1), RUN // 2):  # neighbouring runs overlap by half
                yield from _near(ids[i : i + RUN], x[i : i + RUN], K)

    rows = nodes.mapInArrow(hashed, "d int, t int, bucket long, along double, node long, x array<float>")
    return rows.repartition("d", "t", "bucket").sortWithinPartitions("d", "t", "bucket", "along").mapInArrow(compared, "a long, b long, sim double")


def _nearest(edges: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Each node's K nearest (its own K, where it has one)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    if sizes is None:
        return ranked.filter(F.col("r") <= K).drop("r")
    return ranked.join(sizes, "a", "left").filter(F.col("r") <= F.coalesce("k", F.lit(K))).drop("r", "k")


def _refine(lists: DataFrame, nodes: DataFrame, turn: int, most: int) -> DataFrame:
    """Edges and ties between nodes that share a neighbour: the members of each neighbourhood, in runs of RUN by a hash of the round."""
    members = lists.select(F.col("b").alias("hub"), F.col("a").alias("node")).unionByName(lists.select(F.col("a").alias("hub"), F.col("b").alias("node"))).unionByName(lists.select(F.col("a").alias("hub"), F.col("a").alias("node"))).distinct()
    placed = members.withColumn("order", F.xxhash64("node", F.lit(turn))).join(nodes.select("node", "x"), "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("hub",)):
            ids, x = group.column("node").to_numpy(), _matrix(group.column("x"))
            for i in range(0, len(ids), RUN):
                yield from _near(ids[i : i + RUN], x[i : i + RUN], most)

    return placed.repartition("hub").sortWithinPartitions("hub", "order").mapInArrow(compared, "a long, b long, sim double")


def _parted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and ties of compared runs. A node with several ties keeps the one to the smallest node; the other nodes are tied
    to that one instead. The ties are stored."""
    tie = F.isnan("sim")
    least = found.filter(tie).select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
    ties = least.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("t")).select("t.*")
    return found.filter(~tie), stored(ties.filter("a <> b").distinct())


def _descend(lists: DataFrame, nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Refined lists, and the ties met on the way."""
    sizes, most, before, ties = None, K, None, []
    for turn in range(ROUNDS):
        full = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("least")).filter(F.col("least") >= THRESHOLD)
        grown = full.filter(F.col("n") >= K).select("a", F.least(F.lit(MOST), 2 * F.col("n")).cast("int").alias("k"))
        if sizes is not None:
            grown = grown.unionByName(sizes).groupBy("a").agg(F.max("k").alias("k"))
        sizes, most = stored(grown), min(MOST, most * 2)
        found = stored(_refine(lists, nodes, turn, most))
        edges, met = _parted(found)
        ties.append(met)
        refined = stored(_nearest(lists.unionByName(edges), sizes))
        released(found)
        released(lists)
        lists = refined
        now = lists.agg(F.count("*").alias("n"), F.round(F.sum("sim"), 6).alias("s")).first()
        if now == before:
            break
        before = now
    return lists, ties


def _truth(nodes: DataFrame, sample: pa.Table) -> DataFrame:
    """All links of a bounded sample of nodes, by brute force."""
    parts = [(b.column("node").to_numpy(), _matrix(b.column("x"), np.float64)) for b in _by_length(sample.combine_chunks().to_batches()[0])]
    known = {x.shape[1]: (ids, x) for ids, x in parts}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_length(whole)):
            own, x = batch.column("node").to_numpy(), _matrix(batch.column("x"), np.float64)
            if x.shape[1] in known:
                ids, y = known[x.shape[1]]
                s = x @ y.T
                i, j = np.nonzero(s >= THRESHOLD)
                ok = own[i] != ids[j]
                yield _edges(ids[j][ok], own[i][ok], s[i, j][ok])

    return nodes.mapInArrow(compared, "a long, b long, sim double")


def recall(nodes: DataFrame, component: DataFrame, audit: int = AUDIT) -> float:
    """Mean share of the links of a node whose two ends came into one component: over a sample of nodes, or over one of
    components (by their first nodes), whichever is lower."""
    lone = nodes.select("node", "x").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    reached = 1.0
    for drawn in (lone, lone.filter("node = component")):
        sample = drawn.orderBy(F.xxhash64("node"), "node").limit(audit // 2).select("node", "x").toArrow()
        if not sample.num_rows:
            continue
        a, b = component.select(F.col("node").alias("a"), F.col("component").alias("ca")), component.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        met = _truth(nodes, sample).join(a, "a", "left").join(b, "b", "left").groupBy("a").agg(F.avg(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int")).alias("share"))
        share = met.agg(F.avg("share")).first()[0]
        reached = min(reached, 1.0 if share is None else share)
    return reached


def _roots(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Components of a block pair: for each row and column the smallest place (rows first, then columns) that links reach."""
    rows, columns = link.shape
    own = np.arange(rows)
    other = own.copy() if same else rows + np.arange(columns)
    none = rows + columns
    while True:
        other_new = np.minimum(other, np.where(link, own[:, None], none).min(axis=0))
        own_new = np.minimum(own, np.where(link, other_new[None, :], none).min(axis=1))
        if same:
            own_new = other_new = np.minimum(own_new, other_new)
        if (own_new == own).all() and (other_new == other).all():
            return own, other
        own, other = own_new, other_new


def _within(nodes: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, links to other nodes weighted by multiplicity) and edges that keep linked nodes together, by exact block pairs."""
    sized = component.join(component.groupBy("component").agg(F.count("*").alias("size")), "component")
    blocks = sized.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = blocks.select("node", "component", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    pairs = pairs.select("node", "component", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") <= F.col("j")).alias("low"), "i")
    rows = pairs.join(nodes, "node").select("component", "lo", "hi", "i", "node", "m", "x")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("component", "lo", "hi")):
            ids, m, i = (group.column(c).to_numpy() for c in ("node", "m", "i"))
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            x = _matrix(group.column("x"), np.float64)
            left, right = np.flatnonzero(i == lo), np.flatnonzero(i == hi)
            if not len(left) or not len(right):
                continue
            link = x[left] @ x[right].T >= THRESHOLD
            if lo == hi:
                np.fill_diagonal(link, False)
            own, other = _roots(link, lo == hi)
            both = np.concatenate([ids[left], ids[right]])
            who = [left] if lo == hi else [left, right]
            count = [link @ m[right]] if lo == hi else [link @ m[right], link.T @ m[left]]
            root = [own] if lo == hi else [own, other]
            a = np.concatenate([ids[w] for w in who])
            b = np.concatenate([both[r] for r in root])
            n = np.concatenate(count).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    found = stored(rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(compared, "a long, b long, n long"))
    return found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")).filter("n > 0"), found.filter("a <> b").select("a", "b")


def near_duplicates(vectors: DataFrame) -> tuple[DataFrame, float]:
    """One row per vec_id (vec_id, n_links, component_id, kept), and the audited recall."""
    nodes, members = _nodes(vectors)
    edges, met = _parted(stored(_lsh(nodes, TABLES, SEED)))
    lists, ties = stored(_nearest(edges, None)), [met]
    for retry in range(RETRIES + 1):
        lists, met = _descend(lists, nodes)
        ties += met
        component = components(reduce(DataFrame.unionByName, ties))
        reached = recall(nodes, component)
        if reached >= RECALL or retry == RETRIES:
            break
        edges, met = _parted(stored(_lsh(nodes, 2 * TABLES, SEED + 1 + retry)))
        lists, ties = stored(_nearest(lists.unionByName(edges), None)), [*ties, met]
    if reached < LEAST:
        raise RuntimeError(f"recall {reached:.3f} of the audited links after {RETRIES} retries, below {LEAST}")
    links, exact_ties = _within(nodes, component)
    exact = components(exact_ties)
    known = members.join(nodes.select("node", "m"), "node").join(links, "node", "left").join(exact, "node", "left")
    per = known.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    everyone = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).filter("vec_id is not null").distinct().join(per, "vec_id", "left")
    done = everyone.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.col("vec_id") == F.col("component_id")), reached
