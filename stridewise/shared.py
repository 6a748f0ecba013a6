"""The folder that the driver and the executors share, and tables written to it between two phases of a job."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN_SHARED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session in one process (as in tests) takes a folder
    of this machine; a cluster has none that all see, which is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN_SHARED:
            _OWN_SHARED[application] = tempfile.mkdtemp(prefix="stridewise-shared-")
        found = _OWN_SHARED[application]
    return found.rstrip("/")


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


def delete_tree(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, wherever it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
