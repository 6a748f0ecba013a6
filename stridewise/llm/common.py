"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewise.shared import shared_dir
from stridewise.shipping import ship


#: Bytes of an Arrow batch on its way between the JVM and Python. A batch of Spark's usual number of rows would hold
#: a whole partition of long texts, several times over.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; also ships the package to the executors and bounds the session's Arrow batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written.

    Cuts the lineage, so that a lost executor never repeats earlier phases,
    and keeps nothing on executors' own disks. ``release`` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    return found


def release(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames, after the last action that reads them."""
    for df in written:
        delete_tree(df.sparkSession, _WRITTEN.pop(df))
    if written:
        let_go(written[0].sparkSession)


def let_go(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are gone; else they stay until the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def delete_tree(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, wherever it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def trim() -> None:
    """Give back what a worker has freed; workers outlive tasks and stages, and their executor's memory is one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


_WORKER_MEMORY: dict[str, dict] = {}


def worker_memory(owner: str) -> dict:
    """A worker process's memory for one owner; what another owner kept is let go.

    Workers outlive tasks. Operators that follow each other thus never hold
    their remembered words at the same time.
    """
    if owner not in _WORKER_MEMORY:
        if _WORKER_MEMORY:
            _WORKER_MEMORY.clear()
            trim()
        _WORKER_MEMORY[owner] = {}
    return _WORKER_MEMORY[owner]
