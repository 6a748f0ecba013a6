"""Files in the loaders' formats, written from the trajectory view into the shared folder."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewise.model import TrajectoryData
from stridewise.shared import shared_dir
from stridewise.shipping import partitions, ship
from stridewise.sources import files


def folder(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet."""
    ship(spark)
    return f"{shared_dir(spark)}/fixture-{name}-{uuid.uuid4().hex}"


def _time(trajectory: TrajectoryData) -> Column:
    return F.col("frame") / F.lit(float(trajectory.frame_rate))


def _text(rows: DataFrame, head: list[str], name: str) -> str:
    """A folder of files by id, each with the head's lines and then rows."""
    path = folder(rows.sparkSession, name)
    rows.repartition(partitions(rows), "id").select("value").mapInArrow(files.with_header("\n".join(head)), "value string").write.text(path)
    return path


def viswalk(trajectory: TrajectoryData) -> str:
    rows = trajectory.data.select("id", F.concat_ws(";", "id", _time(trajectory), "x", "y").alias("value"))
    return _text(rows, ["$VISION", "* a comment", "$PEDESTRIAN:NO;SIMSEC;COORDCENTX;COORDCENTY"], "viswalk")


def events(trajectory: TrajectoryData) -> str:
    rows = trajectory.data.select("id", F.concat_ws(" ", "id", _time(trajectory), _time(trajectory), "x", "y").alias("value"))
    return _text(rows, ["pedestrianId simTime endTime-PID1 startX-PID1 startY-PID1"], "events")


def csv(trajectory: TrajectoryData, names: tuple[str, ...]) -> str:
    path = folder(trajectory.data.sparkSession, "csv")
    trajectory.data.select(F.col("id").alias(names[0]), _time(trajectory).alias(names[1]), F.col("x").alias(names[2]), F.col("y").alias(names[3])).write.csv(path, header=True)
    return path


def _documents(batches):
    """(agent's name, its object) -> one document for all agents of a task."""
    agents = [f"{name}: {times}" for batch in batches for name, times in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(["{" + ", ".join(agents) + "}"])], names=["value"])


def nested_json(trajectory: TrajectoryData) -> str:
    """A folder of documents {agent: {time: {position: {x, y}}}}, each with the agents of one task."""
    path = folder(trajectory.data.sparkSession, "json")
    state = F.struct(F.struct("x", "y").alias("position"))
    agents = trajectory.data.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(_time(trajectory).cast("string"), state))).alias("times"))
    agents = agents.repartition(partitions(agents), "id").select(F.format_string('"%d"', "id").alias("name"), F.to_json("times").alias("times"))
    agents.mapInArrow(_documents, "value string").write.text(path)
    return path


def document(spark: SparkSession, name: str, text: str) -> str:
    """A small file with a text."""
    path = folder(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _extent(trajectory: TrajectoryData) -> list[int]:
    """Whole metres around all positions: left, lower, right, upper."""
    return list(trajectory.data.agg(F.floor(F.min("x")), F.floor(F.min("y")), F.ceil(F.max("x")), F.ceil(F.max("y"))).first())


def floor(trajectory: TrajectoryData) -> str:
    """A floor with two walls, a metre thick, below and above all positions."""
    left, low, right, high = _extent(trajectory)
    wall = lambda a, b: "<wall>" + "".join(f'<point x="{x}" y="{y}"/>' for x, y in ((left, a), (right, a), (right, b), (left, b))) + "</wall>"
    return document(trajectory.data.sparkSession, "floor", f"<floor><layer>{wall(low - 1, low)}{wall(high, high + 1)}</layer></floor>")


def scenario(trajectory: TrajectoryData) -> str:
    """A scenario with bounds around all positions and one obstacle of a square metre."""
    left, low, right, high = _extent(trajectory)
    bounds = {"x": left, "y": low, "width": right - left, "height": high - low}
    obstacle = {"id": 4, "shape": {"type": "RECTANGLE", "x": left + 2, "y": low + 2, "width": 1.0, "height": 1.0}}
    text = json.dumps({"scenario": {"topography": {"attributes": {"bounds": bounds, "boundingBoxWidth": 0.5}, "obstacles": [obstacle]}}})
    return document(trajectory.data.sparkSession, "scenario", text)
