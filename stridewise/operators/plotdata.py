"""The data behind usual plots, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.model import TrajectoryData
from stridewise.operators.quantiles import quantiles


def with_time(values: DataFrame, frame_rate: float) -> DataFrame:
    """A per-frame table with its time in seconds."""
    return values.withColumn("time", F.col("frame") / F.lit(float(frame_rate)))


def distribution(values: DataFrame, column: str) -> DataFrame:
    """One row: min, mean, median, max. The median takes a few jobs."""
    (median,) = quantiles(values, column, [0.5])
    return values.agg(F.min(column).alias("min"), F.avg(column).alias("mean"), F.lit(median).cast("double").alias("median"), F.max(column).alias("max"))


def neighborhood_at(neighborhood: DataFrame, traj_data: TrajectoryData, frame: int, pedestrian: int) -> DataFrame:
    """id, x, y, role (base, neighbor, other) in a frame."""
    near = neighborhood.where((F.col("frame") == frame) & (F.col("id") == pedestrian)).select(F.col("neighbor_id").alias("id"), F.lit(True).alias("near"))
    rows = traj_data.data.where(F.col("frame") == frame).select("id", "x", "y").join(near, "id", "left")
    return rows.select("id", "x", "y", F.when(F.col("id") == pedestrian, "base").when(F.col("near"), "neighbor").otherwise("other").alias("role"))


def ends(traj_data: TrajectoryData) -> DataFrame:
    """id and its first and last positions."""
    first = lambda c: F.min_by(c, "frame")
    last = lambda c: F.max_by(c, "frame")
    return traj_data.data.groupBy("id").agg(first("x").alias("first_x"), first("y").alias("first_y"), last("x").alias("last_x"), last("y").alias("last_y"))


def mean_profile(profile: DataFrame) -> DataFrame:
    """row, col, value: mean over the frames."""
    return profile.groupBy("row", "col").agg(F.avg(F.nanvl("value", F.lit(None).cast("double"))).alias("value"))


def time_distance_starts(time_distance: DataFrame) -> DataFrame:
    """The row of each pedestrian's first frame."""
    return time_distance.groupBy("id").agg(F.min_by(F.struct(*[c for c in time_distance.columns if c != "id"]), "frame").alias("first")).select("id", "first.*")


def time_distance_with_speed(time_distance: DataFrame, individual_speed: DataFrame) -> DataFrame:
    """Times and distances to a line with the speed of each row; rows without a speed are left out."""
    return time_distance.join(individual_speed.select("id", "frame", "speed"), ["id", "frame"])
