"""Tables that cut lineage, written once to the cluster's shared folder and read again, and Python stages of bounded memory."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch that Spark hands to Python, at most (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of one's own only where that is unset and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, *, compression: str = "snappy") -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back, so that later jobs don't depend on lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later query reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for parent in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise, and Spark's Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_caches: dict[str, Callable] = {}


def worker_cache(load: Callable) -> Callable:
    """A function whose last results a Python worker keeps until it works for a stage that doesn't name it."""
    cached = _caches[load.__qualname__ + load.__module__] = lru_cache(maxsize=2)(load)
    return cached


def drop_caches(but: str | None) -> None:
    for name, cached in _caches.items():
        if name != but:
            cached.cache_clear()


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, *, cache: Callable | None = None) -> DataFrame:
    """mapInArrow with batches of bounded size. `cache` is the worker_cache that `run` uses; others are dropped. Freed memory is given back after each partition."""
    keep = cache and cache.__wrapped__.__qualname__ + cache.__wrapped__.__module__
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", str(most))

    def tidy(batches):
        drop_caches(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)
