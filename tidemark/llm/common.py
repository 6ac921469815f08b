"""What the training-data operators share: shipping the package, shared folders, what a Python worker keeps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of the C library's setting; a fixed value.
_M_MMAP_THRESHOLD = -3
_shipped: dict[str, str] = {}
_state: list = [None, None]


def worker_state(key: tuple, make: Callable):
    """What a Python worker keeps from one task to the next: one operator's tables. Another operator's take their place,
    as Spark's workers serve many stages and their memory would add up."""
    if _state[0] != key:
        release()
        _state[:] = key, make()
    return _state[1]


def release() -> None:
    """Drop what the worker keeps, and give freed memory back to the system: operators that keep nothing begin so."""
    if _state[0] is not None:
        _state[:] = None, None
        gc.collect()
    pa.default_memory_pool().release_unused()
    if (library := _allocator()) is not None:
        library.malloc_trim(0)


@cache
def _allocator() -> ctypes.CDLL | None:
    """The C library, told to return large arrays to the system as soon as they are freed; None where it can't be told so."""
    with contextlib.suppress(OSError, AttributeError):
        library = ctypes.CDLL(None)
        library.mallopt(_M_MMAP_THRESHOLD, 1 << 20)
        library.malloc_trim(0)
        return library
    return None


#: Bytes of an Arrow batch, where the session leaves Spark's default of 64 MB: tasks hold several copies of a batch.
BATCH_BYTES, _DEFAULT = 4 << 20, 64 << 20


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors once a session; bound the bytes of an Arrow batch if the session does not."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting).rstrip("bB") == str(_DEFAULT):
        spark.conf.set(setting, f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "tidemark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder. Only a local session without one gets a temporary
    folder; on a cluster its executors could not read each other's files there, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files when the query ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a row group of a step's table: a task holds one as it writes and as it reads, beside the other steps' pages.
ROW_GROUP = 16 << 20
#: Paths of the tables written within each scratch() that is open.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised within, but for those to be kept, go when the block ends."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, label: str, tidy: bool = False, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors cost no recomputation, and lineage is cut.

    With tidy, the shuffle files of the write go once it has ended, as nobody reads them again; otherwise they stay until
    the driver's garbage is collected, so an operator of many steps holds those of all of them. keep: also beyond the
    scratch() that it is written in."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    if _scratch and not keep:
        _scratch[-1].append(path)
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions_of(df: DataFrame) -> int:
    """Input partitions, which follow the size of the input."""
    return df.rdd.getNumPartitions()


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), whatever other columns the table has."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def fold(key: Column) -> Column:
    """crc32 of the key's decimal text, modulo 3: rows with remainder 1 are held out."""
    return F.crc32(key.cast("string").cast("binary")) % 3


#: Rows of some ids of 8 or 16 bytes that a join may broadcast; it is checked, and more are joined by a shuffle.
MOST_BROADCAST_IDS = 2_000_000


def join_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """df joined with a written table of ids: by broadcast while it is small, so df need not be shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids, key, how)
