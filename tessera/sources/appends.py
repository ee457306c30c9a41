"""Appends that count once, however often a write breaks or is repeated.

A table is a folder with ``data/<batch>`` folders and, for each batch that is whole, a small manifest in ``commits``, written last
and by a rename. Readers take the folders that manifests name and nothing else, so what a broken write left is never seen; a repeat
of the batch clears it first. A batch holds only keys that no other batch has: it is compared with those whose key range meets its
own. One writer appends at a time.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import flat


class AppendTable:
    """Rows in ``path``, in ``columns`` (a schema text), unique by ``key``; as JSON lines, or as CSV with one header file for the whole table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, form: str = "json") -> None:
        self.spark, self.path, self.key, self.form = spark, path.rstrip("/"), key, form
        self.schema = spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):  # noqa: ANN202
        return self._hadoop.Path(f"{self.path}/{name}".rstrip("/"))

    def _list(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def _put(self, name: str, content: str) -> None:
        """A file that is there as a whole or not at all."""
        draft = self._at(f"{name}.draft")
        out = self._files.create(draft, True)
        out.write(bytearray(content.encode()))
        out.close()
        if not self._files.rename(draft, self._at(name)):
            raise OSError(f"no rename to {self.path}/{name}")

    def manifests(self) -> list[dict]:
        """One for each batch that counts."""
        names = [n for n in self._list("commits") if n.endswith(".json")]
        if not names:
            return []
        return [json.loads(r["value"]) for r in self.spark.read.text([f"{self.path}/commits/{n}" for n in names], wholetext=True).collect()]

    def _read(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{b}" for b in batches]
        if self.form == "csv":
            return self.spark.read.schema(self.schema).csv(paths, quote='"', escape='"', emptyValue="", multiLine=True)
        return self.spark.read.schema(self.schema).json(paths)

    def read(self) -> DataFrame:
        """All rows that count."""
        return self._read([m["batch"] for m in self.manifests()])

    def append(self, df: DataFrame, batch: str) -> int:
        """Write the rows of a batch whose keys are new, first rows of a key by an arbitrary choice, and count it; the number of rows written.
        A batch that counts already is left as it is (0)."""
        if not re.fullmatch(r"[A-Za-z0-9_.=-]+", batch):
            raise ValueError(f"no name for a batch: {batch}")
        known = self.manifests()
        if any(m["batch"] == batch for m in known):
            return 0
        folder = f"data/{batch}"
        self._files.delete(self._at(folder), True)
        rows = df.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        key = F.col(self.key).cast("string")
        low, high = rows.agg(F.min(key), F.max(key)).first()
        met = [m["batch"] for m in known if low is not None and m["low"] is not None and m["low"] <= high and low <= m["high"]]
        if met:
            rows = rows.join(self._read(met).select(self.key), self.key, "left_anti").select(*self.schema.names)
        if self.form == "csv":
            flat(rows).write.mode("overwrite").csv(f"{self.path}/{folder}", header=False, quote='"', escape='"', emptyValue="")
            if "header.csv" not in self._list(""):
                self._put("header.csv", ",".join(self.schema.names) + "\n")
        else:
            rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.path}/{folder}")
        # what was written decides, not a second run of the batch's plan
        written = self._read([batch])
        n, low, high = written.agg(F.count("*"), F.min(key), F.max(key)).first()
        files = [f for f in self._list(folder) if not f.startswith(("_", "."))]
        self._put(f"commits/{batch}.json", json.dumps({"batch": batch, "files": files, "rows": n, "low": low, "high": high}))
        return n

    def text_files(self) -> list[str]:
        """Of a CSV table: the files that are the whole table when put one after the other; the header is the first."""
        parts = [f"{self.path}/data/{m['batch']}/{f}" for m in self.manifests() for f in m["files"]]
        return [f"{self.path}/header.csv", *parts]
