"""URL filters: a sort-merge range join of urls with prefix rules on reversed-host canonical keys.

A rule is a host, a path and a verdict. It fits its host and all subdomains if the url's path starts with the rule's; the longest
rule (host and path together) decides, then the longer host, then ``block``.

* A key is the host's labels in reverse, each ended by ``\\x01``, then ``\\x00`` and the path. A url has one key for its host and for each
  parent domain that isn't deeper than the deepest rule host, so that every rule, path included, is one interval of keys: from
  its own key to the next string that doesn't start with it. Intervals of prefixes are nested or apart.
* Bounds from a sample cut the key space into ranges; the sample only balances them. A url's key goes to the range that holds
  it (equal keys over several bounds are dealt out by a hash), a rule to all ranges that its interval meets.
* Within a range, urls and rules come sorted by key. A sweep keeps a stack of the nested rules that are open and gives
  a key the innermost one; it holds nothing but the stack and one batch, however many rules there are.
* The longest of a url's matches is a grouped maximum, combined before the shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path and fits no rule; without a rule the verdict is
the ``default`` (allow: a filter forbids what its rules name). An empty path starts with no rule path but the empty one. Empty labels, ports, users and
control characters stay part of a host. Repeated rows are kept, one result each. Rules with a null host or path, or one with an empty host,
fit nothing. Only page_id and url are read; further columns aren't returned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import partitions

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
#: Sampled keys a range, ranges a partition; at most so many keys come to the driver.
SAMPLE, RANGES, MOST_KEYS = 20, 4, 200_000


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_labels(host: Column) -> Column:
    """Labels from the top domain down; the bytes that end a label and a host are written otherwise inside one."""
    plain = F.replace(F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x04")), F.lit("\x01"), F.lit("\x02\x03")), F.lit("\x00"), F.lit("\x02\x02"))
    return F.reverse(F.split(plain, r"\.", -1))


def canonical(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "\x01"), F.lit("\x01\x00"), path)


def keys_of(urls: DataFrame, depth: int) -> DataFrame:
    """urls (page_id, url) as rows (page_id, url, nth, key): nth 1 is there once for every row, with a null key if there is no host."""
    host = host_of(F.col("url"))
    split = urls.select("page_id", "url", F.when(host != "", reversed_labels(host)).alias("_labels"), path_of(F.col("url")).alias("_path"))
    upto = F.transform(F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(depth))), lambda k: F.slice(F.col("_labels"), 1, k))
    every = split.select("page_id", "url", "_path", F.posexplode_outer(F.when(F.col("_labels").isNotNull() & F.lit(depth > 0), upto)).alias("_nth", "_some"))
    return every.select("page_id", "url", F.coalesce(F.col("_nth") + 1, F.lit(1)).alias("nth"), canonical(F.col("_some"), F.col("_path")).cast("binary").alias("key"))


def _after(key: bytes) -> bytes:
    """The smallest string beyond all that start with ``key``; UTF-8 has no byte 255."""
    return key[:-1] + bytes([key[-1] + 1])


def _deal(batches: Iterator[pa.RecordBatch], bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A range number for every key."""
    at = np.array([*bounds, b""], dtype=object)[:-1]
    for batch in batches:
        keys = np.array([k if k is not None else b"" for k in batch.column("key").to_pylist()] + [b""], dtype=object)[:-1]
        low, high = (np.searchsorted(at, keys, side=side).astype(np.int64) for side in ("left", "right"))
        none = batch.column("key").is_null().to_numpy(zero_copy_only=False)
        low[none], high[none] = 0, len(bounds)  # keyless rows go anywhere
        salt = batch.column("salt").to_numpy()
        part = low + salt % (high - low + 1)
        yield batch.drop_columns(["salt"]).append_column("part", pa.array(part.astype(np.int32)))


def _spread(batches: Iterator[pa.RecordBatch], bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A rule for every range that its interval meets."""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        first = np.array([bisect_left(bounds, k) for k in keys], dtype=np.int64)
        count = np.array([bisect_left(bounds, _after(k)) for k in keys], dtype=np.int64) - first + 1
        for row in range(batch.num_rows):
            for lo in range(0, int(count[row]), 4096):
                part = pa.array(np.arange(first[row] + lo, first[row] + min(lo + 4096, count[row]), dtype=np.int32))
                yield batch.take(pa.array(np.full(len(part), row))).append_column("part", part)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, kind), rules (kind 0) before urls of the same key. The stack holds the open rules, outermost first."""
    stack: list[tuple[bytes, tuple[int, str, str, str]]] = []
    here = None
    for batch in batches:
        part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        keys = batch.column("key").to_pylist()
        found = np.zeros(batch.num_rows, dtype=np.int64)  # 0: no rule
        open_ = [None]
        rules = {k: v for k, v in zip(np.flatnonzero(kind == 0).tolist(), batch.filter(pa.array(kind == 0)).select(["rank", "rule", "verdict"]).to_pylist(), strict=True)}
        turns = np.flatnonzero((kind == 0) | np.concatenate(([True], part[1:] != part[:-1])))
        for lo, hi in zip(turns.tolist(), [*turns[1:].tolist(), batch.num_rows], strict=True):
            if part[lo] != here:
                stack, here = [], part[lo]
            if kind[lo] == 0:
                while stack and not keys[lo].startswith(stack[-1][0]):
                    stack.pop()
                stack.append((keys[lo], rules[lo]))
                lo += 1
            while lo < hi and keys[lo] is None:
                lo += 1
            while lo < hi:  # from here on only urls, in the order of their keys: each pop ends a stretch with one innermost rule
                while stack and not keys[lo].startswith(stack[-1][0]):
                    stack.pop()
                end = bisect_left(keys, _after(stack[-1][0]), lo, hi) if stack else hi
                if stack:
                    if open_[-1] is not stack[-1][1]:
                        open_.append(stack[-1][1])
                    found[lo:end] = len(open_) - 1
                lo = end
        urls = batch.filter(pa.array(kind == 1))
        got = found[kind == 1]
        fields = {k: pa.array([x and x[k] for x in open_], t).take(pa.array(got)) for k, t in (("rank", pa.int64()), ("rule", pa.string()), ("verdict", pa.string()))}
        yield pa.RecordBatch.from_arrays([urls.column("page_id"), urls.column("url"), urls.column("nth"), *fields.values()], names=["page_id", "url", "nth", *fields])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Every row of pages with page_id, url, host, path, the rule that decides (host and path as one text, else null) and the verdict."""
    spark = pages.sparkSession
    usable = rules.select(lowered(F.col("host")).alias("host"), "path", "verdict").filter("host <> '' and path is not null")
    # of rules with one host and path, ``block`` decides
    ranked = usable.groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict")).alias("_v")).select("host", "path", F.col("_v.verdict").alias("verdict"))
    labels = reversed_labels(F.col("host"))
    depth = ranked.agg(F.max(F.size(labels))).first()[0] or 0
    size = F.length(F.concat("host", "path")) * F.lit(1 << 20) + F.length("host")
    intervals = ranked.select(canonical(labels, F.col("path")).cast("binary").alias("key"), size.cast("long").alias("rank"), F.concat("host", "path").alias("rule"), "verdict")

    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    keys = keys_of(urls, depth)
    parts = partitions(spark)
    sample = min(MOST_KEYS, SAMPLE * RANGES * parts)
    total = max(1, urls.count())
    some = sorted(bytes(k) for (k,) in keys.select("key").filter("key is not null").sample(min(1.0, sample / (total * max(1, depth))), seed=7).limit(2 * sample).collect())
    ranges = min(RANGES * parts, len(some))
    bounds = [some[len(some) * k // ranges] for k in range(1, ranges)]

    salted = keys.withColumn("salt", F.expr("pmod(xxhash64(page_id, url), 1048573)"))
    kind = salted.schema["page_id"].dataType.simpleString()
    points = salted.mapInArrow(partial(_deal, bounds=bounds), f"page_id {kind}, url string, nth int, key binary, part int")
    spread = intervals.mapInArrow(partial(_spread, bounds=bounds), "key binary, rank long, rule string, verdict string, part int")
    both = points.withColumn("kind", F.lit(1)).unionByName(spread.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    swept = both.repartition(parts, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(_sweep, f"page_id {kind}, url string, nth int, rank long, rule string, verdict string")

    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("rank", "rule", "verdict"))).alias("_best")
    one = swept.groupBy("page_id", "url").agg(best, F.count_if(F.col("nth") == 1).alias("_copies"))
    again = one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return again.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
