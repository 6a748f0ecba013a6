"""How far pedestrians move around each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridewise.enums import AccelerationCalculation, SpeedCalculation
from stridewise.errors import ArgumentValueError
from stridewise.geometry.exprs import in_convex
from stridewise.model import MeasurementArea, TrajectoryData


def by_id():
    """A pedestrian's rows in the order of frames."""
    return Window.partitionBy("id").orderBy("frame")


def whole_id():
    return Window.partitionBy("id")


def _at(side: str, x: str, y: str, frame: str) -> list[Column]:
    return [F.col(x).alias(f"{side}_x"), F.col(y).alias(f"{side}_y"), F.col(frame).alias(f"{side}_frame")]


def individual_movement(traj: TrajectoryData, frame_step: int, speed_calculation: SpeedCalculation = SpeedCalculation.BORDER_ADAPTIVE, bidirectional: bool = True) -> DataFrame:
    """id, frame, start_x, start_y, end_x, end_y, window_size (frames between start and end).

    BORDER_EXCLUDE and BORDER_SINGLE_SIDED look ``frame_step`` rows back (and
    ahead if bidirectional); the former leaves out rows without both ends, the
    latter takes the row itself for a missing end. BORDER_ADAPTIVE looks up
    frames, with a step shrunk to what the pedestrian's first and last frames
    allow; rows whose frames are missing, and steps of 0, are left out.
    """
    data = traj.data.select("id", "frame", "x", "y")
    back = lambda c: F.lag(c, frame_step).over(by_id())
    ahead = lambda c: F.lead(c, frame_step).over(by_id()) if bidirectional else F.col(c)
    columns = {"x": "x", "y": "y", "frame": "frame"}
    if speed_calculation is SpeedCalculation.BORDER_EXCLUDE:
        moved = data.withColumns({f"start_{c}": back(c) for c in columns} | {f"end_{c}": ahead(c) for c in columns})
        moved = moved.where("start_frame is not null and end_frame is not null")
    elif speed_calculation is SpeedCalculation.BORDER_SINGLE_SIDED:
        moved = data.withColumns({f"start_{c}": F.coalesce(back(c), F.col(c)) for c in columns} | {f"end_{c}": F.coalesce(ahead(c), F.col(c)) for c in columns})
    elif speed_calculation is SpeedCalculation.BORDER_ADAPTIVE:
        step = F.least(F.lit(frame_step), F.col("frame") - F.min("frame").over(whole_id()), F.max("frame").over(whole_id()) - F.col("frame"))
        sized = data.withColumn("step", step).where("step > 0")
        before = data.select("id", F.col("frame").alias("start_frame"), F.col("x").alias("start_x"), F.col("y").alias("start_y"))
        after = data.select("id", F.col("frame").alias("end_frame"), F.col("x").alias("end_x"), F.col("y").alias("end_y"))
        sized = sized.withColumns({"start_frame": F.col("frame") - F.col("step"), "end_frame": F.col("frame") + (F.col("step") if bidirectional else 0)})
        moved = sized.join(before, ["id", "start_frame"]).join(after, ["id", "end_frame"])
    else:
        raise ArgumentValueError("speed calculation not accepted")
    return moved.select("id", "frame", "start_x", "start_y", "end_x", "end_y", (F.col("end_frame") - F.col("start_frame")).alias("window_size"))


def acceleration_movement(traj: TrajectoryData, frame_step: int, acceleration_calculation: AccelerationCalculation = AccelerationCalculation.BORDER_EXCLUDE) -> DataFrame:
    """id, frame, start, mid and end positions, window_size: 2 x frame_step rows back, frame_step rows back, the row itself."""
    if acceleration_calculation is not AccelerationCalculation.BORDER_EXCLUDE:
        raise ArgumentValueError("acceleration calculation not accepted")
    lag = lambda c, n: F.lag(c, n).over(by_id())
    moved = traj.data.select("id", "frame", "x", "y").withColumns(
        {f"start_{c}": lag(c, 2 * frame_step) for c in "xy"}
        | {f"mid_{c}": lag(c, frame_step) for c in "xy"}
        | {f"end_{c}": F.col(c) for c in "xy"}
        | {"window_size": F.col("frame") - lag("frame", frame_step), "start_frame": lag("frame", 2 * frame_step)}
    )
    return moved.where("start_frame is not null").drop("x", "y", "start_frame")


def stay_intervals(traj: TrajectoryData, measurement_area: MeasurementArea) -> DataFrame:
    """id, entering_frame, leaving_frame (the frame after the last) of each stay strictly inside the area."""
    inside = traj.data.select("id", "frame", "x", "y").where(in_convex(F.col("x"), F.col("y"), measurement_area))
    new = F.when(F.col("frame") - F.lag("frame").over(by_id()) >= 2, 1).otherwise(0)
    islands = inside.select("id", "frame", new.alias("new")).withColumn("stay", F.sum("new").over(by_id()))
    return islands.groupBy("id", "stay").agg(F.min("frame").alias("entering_frame"), (F.max("frame") + 1).alias("leaving_frame")).drop("stay")
