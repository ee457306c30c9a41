"""Database files as a Spark source: key ranges are partitions, conditions and the columns of the schema go into the query.

Executors open the file by its path, so it lies in a folder that all of them share. Every partition reads one range of an integer key; rows
without a key belong to the first one.

Conditions are given to ``database_file`` and bound as parameters of the database's own query. Filters on the frame stay with Spark: its hook for
pushing them into a Python source (4.1) keeps the last filters for every later scan of the same frame, whether it has them or not.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: A condition: (column, sign, value); ``in`` has a list of values, the null tests have None. A list of conditions holds if one of them does.
SIGNS = ("=", "<>", "<", "<=", ">", ">=", "like", "in", "is null", "is not null")
_ROWS = 4096


@dataclass
class _Range(InputPartition):
    low: int | None
    high: int | None


@dataclass
class _Clauses:
    """Predicates as SQL text with ? for values, and the values."""

    text: list[str] = field(default_factory=list)
    values: list = field(default_factory=list)

    def add(self, text: str, *values: object) -> None:
        self.text.append(text)
        self.values.extend(values)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_condition(condition: Sequence) -> tuple:
    """The text of a condition with ? for its values, and the values."""
    if condition and not isinstance(condition[0], str):
        parts = [sql_condition(c) for c in condition]
        return "(" + " OR ".join(p[0] for p in parts) + ")", *(v for p in parts for v in p[1:])
    if not condition:  # none of no conditions holds
        return ("0",)
    name, sign, value = _quoted(condition[0]), condition[1].lower(), condition[2]
    if sign not in SIGNS:
        raise ValueError(f"no sign of a condition: {sign}")
    if sign.startswith("is "):
        return (f"{name} {sign.upper()}",)
    if sign == "in":
        return (f"{name} IN ({', '.join('?' * len(value))})", *value) if value else ("0",)
    return f"{name} {sign.upper()} ?", value


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]) -> None:
        self.wanted, self.options = schema, dict(options)
        self.where = _Clauses()
        for condition in json.loads(self.options.get("where", "[]")):
            self.where.add(*sql_condition(condition))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> Sequence[InputPartition]:
        key, n = self.options.get("key"), int(self.options.get("partitions", "8"))
        if not key:
            return [_Range(None, None)]
        with self._open() as db:
            low, high = db.execute(f"SELECT min({_quoted(key)}), max({_quoted(key)}) FROM ({self.options['query']})").fetchone()
        if low is None or low == high:
            return [_Range(None, None)]
        width = -(-(high - low + 1) // n)
        cuts = list(range(low + width, high + 1, width))
        return [_Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string()}
        names = self.wanted.names
        where, key = _Clauses([*self.where.text], [*self.where.values]), _quoted(self.options.get("key", ""))
        if partition.low is not None:
            where.add(f"{key} >= ?", partition.low)
        if partition.high is not None:
            where.add(f"({key} < ?" + (f" OR {key} IS NULL)" if partition.low is None else ")"), partition.high)
        sql = f"SELECT {', '.join(map(_quoted, names))} FROM ({self.options['query']})" + (f" WHERE {' AND '.join(where.text)}" if where.text else "")
        db = self._open()
        try:
            cursor = db.execute(sql, where.values)
            while rows := cursor.fetchmany(_ROWS):
                columns = [pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(zip(*rows, strict=True), self.wanted, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def database_file(spark: SparkSession, path: str, query: str, schema: str, key: str | None = None, partitions: int = 8, where: Sequence = ()) -> DataFrame:
    """The rows of a query on a database file that satisfy all conditions ``where``; ``schema`` names the columns that are read (long,
    int, double, string)."""
    register(spark)
    reader = spark.read.format("sqlite").schema(schema).option("path", path).option("query", query).option("partitions", partitions).option("where", json.dumps(list(where)))
    return (reader.option("key", key) if key else reader).load()


def rule_predicate(equal: Mapping[str, Sequence] | None = None, like_any: Mapping[str, Sequence[str]] | None = None, either: Sequence[Column] = ()) -> Column:
    """A predicate from a rule: each column of ``equal`` has one of its values (text in any case), each of ``like_any`` is like one of
    its patterns, and one of ``either`` holds. An empty list of values or patterns is never satisfied; no list at all is."""
    found = F.lit(True)
    for name, values in (equal or {}).items():
        text = [v for v in values if isinstance(v, str)]
        same = F.lower(F.col(name).cast("string")).isin([v.lower() for v in text]) if text else F.col(name).isin(list(values)) if values else F.lit(False)
        found = found & same
    for name, patterns in (like_any or {}).items():
        one = F.lit(False)
        for p in patterns:
            one = one | F.lower(F.col(name)).like(p.lower())
        found = found & one
    if either:
        one = F.lit(False)
        for c in either:
            one = one | c
        found = found & one
    return F.coalesce(found, F.lit(False))
