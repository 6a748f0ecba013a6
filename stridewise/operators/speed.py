"""Individual, mean and Voronoi speeds; passing speeds; speeds at a line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridewise.enums import SpeedCalculation
from stridewise.errors import SpeedError
from stridewise.geometry import exprs
from stridewise.model import MeasurementArea, MeasurementLine, TrajectoryData, check_trajectory
from stridewise.operators import line
from stridewise.operators.frames import zero_filled
from stridewise.operators.movement import individual_movement


def projected(x: Column, y: Column, direction: tuple[float, float] | None, normalize: bool) -> tuple[Column, Column, Column]:
    """Components and length of a displacement, or of its part along a direction.

    With a direction d the part is (v.d) d (d.d), and its length ((that).d) / |d|:
    the projection for unit vectors only. normalize makes any direction one.
    """
    if direction is None:
        return x, y, F.sqrt(x * x + y * y)
    dx, dy = (float(v) for v in direction)
    size = math.sqrt(dx * dx + dy * dy)
    if normalize:
        dx, dy, size = dx / size, dy / size, 1.0
    along = (x * F.lit(dx) + y * F.lit(dy)) * F.lit(dx * dx + dy * dy)
    px, py = along * F.lit(dx), along * F.lit(dy)
    return px, py, (px * F.lit(dx) + py * F.lit(dy)) / F.lit(size)


def individual_speed(
    traj_data: TrajectoryData,
    frame_step: int,
    movement_direction: tuple[float, float] | None = None,
    compute_velocity: bool = False,
    speed_calculation: SpeedCalculation = SpeedCalculation.BORDER_EXCLUDE,
    normalize_direction: bool = False,
) -> DataFrame:
    """id, frame, speed [, v_x, v_y]; NaN for a pedestrian of one frame (BORDER_SINGLE_SIDED)."""
    check_trajectory(traj_data)
    moved = individual_movement(traj_data, frame_step, speed_calculation)
    x, y, length = projected(F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y"), movement_direction, normalize_direction)
    seconds = F.col("window_size") / F.lit(float(traj_data.frame_rate))
    per_second = lambda v: F.when(F.col("window_size") == 0, F.lit(float("nan"))).otherwise(v / F.nullif(seconds, F.lit(0.0)))
    columns = [per_second(length).alias("speed")]
    if compute_velocity:
        columns += [per_second(x).alias("v_x"), per_second(y).alias("v_y")]
    return moved.select("id", "frame", *columns)


def _covers(values: DataFrame, rows: DataFrame, error: type[Exception], what: str) -> None:
    if values.count() < rows.count():
        raise error(f"there are fewer {what} than rows they are needed for")


def mean_of_inside(traj_data: TrajectoryData, values: DataFrame, column: str, measurement_area: MeasurementArea, result: str) -> DataFrame:
    inside = traj_data.data.where(exprs.in_convex(F.col("x"), F.col("y"), measurement_area)).select("id", "frame")
    means = inside.join(values.select("id", "frame", column), ["id", "frame"]).groupBy("frame").agg(F.avg(column).alias(result))
    return zero_filled(means, traj_data.data, result)


def mean_speed_per_frame(traj_data: TrajectoryData, individual_speed: DataFrame, measurement_area: MeasurementArea, validate: bool = False) -> DataFrame:
    """frame, speed: mean over those strictly inside; 0 in frames without anyone. validate: runs two counts first."""
    check_trajectory(traj_data)
    if validate:
        _covers(individual_speed, traj_data.data, SpeedError, "speeds")
    return mean_of_inside(traj_data, individual_speed, "speed", measurement_area, "speed")


def weighted_by_cells(traj_data: TrajectoryData, values: DataFrame, column: str, intersections: DataFrame, measurement_area: MeasurementArea) -> DataFrame:
    weights = intersections.select("id", "frame", exprs.area(F.col("intersection")).alias("__area"))
    total = F.sum(F.col("__area") * F.col(column)) / F.lit(float(measurement_area.area))
    sums = weights.join(values.select("id", "frame", column), ["id", "frame"]).groupBy("frame").agg(total.alias(column))
    return zero_filled(sums, traj_data.data, column)


def voronoi_speed(traj_data: TrajectoryData, individual_speed: DataFrame, individual_voronoi_intersection: DataFrame, measurement_area: MeasurementArea, validate: bool = False) -> DataFrame:
    """frame, speed: speeds weighted by the cells' areas inside the measurement area, over its area."""
    check_trajectory(traj_data)
    if validate:
        _covers(individual_speed, individual_voronoi_intersection, SpeedError, "speeds")
    return weighted_by_cells(traj_data, individual_speed, "speed", individual_voronoi_intersection, measurement_area)


def passing_speed(frames_in_area: DataFrame, frame_rate: float, distance: float) -> DataFrame:
    """id, speed: the distance over the time between entering and leaving."""
    return frames_in_area.select("id", (F.lit(float(frame_rate) * float(distance)) / F.abs(F.col("leaving_frame") - F.col("entering_frame"))).alias("speed"))


def species(trajectory_data: TrajectoryData, individual_voronoi_polygons: DataFrame, measurement_line: MeasurementLine, frame_step: int) -> DataFrame:
    """id, species: the sign of the speed along the line's normal when the cell first meets the line."""
    check_trajectory(trajectory_data, "trajectory_data")
    first = individual_voronoi_polygons.where(exprs.meets_line(F.col("polygon"), measurement_line)).groupBy("id").agg(F.min("frame").alias("frame"))
    speeds = individual_speed(trajectory_data, frame_step, measurement_line.normal_vector, speed_calculation=SpeedCalculation.BORDER_SINGLE_SIDED)
    return first.join(speeds, ["id", "frame"]).select("id", F.signum("speed").alias("species"))


def line_speed(individual_voronoi_polygons: DataFrame, measurement_line: MeasurementLine, individual_speed: DataFrame, species: DataFrame, validate: bool = False) -> DataFrame:
    """frame, s_sp+1, s_sp-1, speed, latest frame first."""
    if validate:
        line.validate(species, individual_voronoi_polygons, measurement_line, individual_speed)
    value = line.normal_speed(measurement_line) * line.share(measurement_line)
    return line.by_species(individual_voronoi_polygons, measurement_line, species, value, individual_speed, "s_sp+1", "s_sp-1", "speed", flip=True)
