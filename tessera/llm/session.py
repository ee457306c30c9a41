"""Reading tables and keeping intermediate results where every executor can read them."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions inside drop their shuffle files when they end: a chain of stored steps never holds the shuffles of all
    of them. (A step that is retried meanwhile runs its map stages again.)"""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    with releasing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Delete the folder of a ``stored`` frame that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def given_back() -> None:
    """Hand the driver's freed memory back to the system: after large arrays came and went, its allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
