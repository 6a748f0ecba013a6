"""Classic density, histograms and stays of streams of positions.

A frame's positions arrive together or a little late: the event time is the
frame's, and a watermark closes frames. Frames without anyone inside give no
row, as a stream has no last frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridewise.geometry.exprs import in_convex
from stridewise.model import MeasurementArea
from stridewise.operators.profiles import Grid


#: Event time of frame 0, in microseconds; later than the watermark that a stream starts with.
ORIGIN = 946_684_800_000_000


def timed(positions: DataFrame, frame_rate: float, lateness: str) -> DataFrame:
    """Positions with frame_time, the event time of their frame, and a watermark on it."""
    at = F.timestamp_micros(F.lit(ORIGIN) + (F.col("frame") * F.lit(1_000_000.0 / frame_rate)).cast("long"))
    return positions.withColumn("frame_time", at).withWatermark("frame_time", lateness)


def behind_watermark(condition: Column) -> Column:
    """The condition, null as false, that Spark does not move before the watermark: rows that fail it move the watermark, too."""
    return F.coalesce(condition, F.col("frame_time").isNull())


def live_classic_density(positions: DataFrame, measurement_area: MeasurementArea, frame_rate: float, lateness: str = "2 seconds") -> DataFrame:
    """frame_time, frame, density of a stream (id, frame, x, y)."""
    inside = timed(positions, frame_rate, lateness).where(behind_watermark(in_convex(F.col("x"), F.col("y"), measurement_area)))
    return inside.groupBy("frame_time", "frame").agg((F.count("*") / F.lit(float(measurement_area.area))).alias("density"))


def live_density_profile(positions: DataFrame, grid: Grid, frame_rate: float, lateness: str = "2 seconds") -> DataFrame:
    """frame_time, frame, row, col, value of cells with anyone in them."""
    row, col, inside = grid.bin()
    rows = timed(positions, frame_rate, lateness).where(behind_watermark(inside))
    return rows.groupBy("frame_time", "frame", row.alias("row"), col.alias("col")).agg((F.count("*") / F.lit(grid.size**2)).alias("value"))


def live_stay_intervals(positions: DataFrame, measurement_area: MeasurementArea, frame_rate: float, lateness: str = "2 seconds") -> DataFrame:
    """id, entering_frame, leaving_frame (the frame after the last) of stays, once the watermark has passed their end.

    A stay goes on over rows one frame apart and ends where a frame or more is
    missing: the session's gap lies half way between one frame and two, so
    that rounded times of frames decide nothing.
    """
    inside = timed(positions, frame_rate, lateness).where(behind_watermark(in_convex(F.col("x"), F.col("y"), measurement_area)))
    gap = f"{round(1_500_000 / frame_rate)} microseconds"
    stays = inside.groupBy("id", F.session_window("frame_time", gap)).agg(F.min("frame").alias("entering_frame"), (F.max("frame") + 1).alias("leaving_frame"))
    return stays.select("id", "entering_frame", "leaving_frame")
