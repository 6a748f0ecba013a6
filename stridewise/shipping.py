"""Make the package importable on executors.

A cluster started from a checkout has no copy of this package on its workers,
so the driver hands a zip of the sources to Spark's own file server once per
application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors; later calls do nothing."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="stridewise-")
    path = os.path.join(folder, "stridewise_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for here, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle whose rows go to Python.

    Unless told a number, Spark merges partitions by their bytes, however long
    their rows take; so the session's number holds, or one for each core.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
