"""Recorded positions as a stream, and streams run until their input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.model import TrajectoryData
from stridewise.shared import materialize, release, shared_dir

#: Frames between the last position and the row that closes a replay.
CLOSING_FRAMES = 100_000


def replay(traj_data: TrajectoryData, parts: int = 3) -> DataFrame:
    """A stream (id, frame, x, y) of a recorded trajectory, in ``parts`` stretches of frames, about one in each trigger.

    Written to the shared folder as one set of files after the other. A row
    without id or place, far behind the last frame, ends it: it moves the
    watermark past all frames and is no position.
    """
    spark = traj_data.data.sparkSession
    files = spark.sparkContext.defaultParallelism
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    # the ends of the frames and each stretch read the positions
    data = materialize(traj_data.data.select("id", "frame", "x", "y"), "replayed")
    low, high = data.agg(F.min("frame"), F.max("frame")).first()
    if low is None:
        low, high = 0, 0
    edges = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        data.where((F.col("frame") >= a) & (F.col("frame") < b)).repartition(files).write.mode("append").parquet(path)
    none = F.lit(None)
    closing = spark.range(1, numPartitions=1).select(none.cast("long").alias("id"), F.lit(high + CLOSING_FRAMES).cast("long").alias("frame"), none.cast("double").alias("x"), none.cast("double").alias("y"))
    closing.write.mode("append").parquet(path)
    release(data)
    return spark.readStream.schema(data.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream until what is there now is used up, and return what it has appended."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
