"""Individual, mean and Voronoi accelerations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.enums import AccelerationCalculation
from stridewise.errors import AccelerationError
from stridewise.model import MeasurementArea, TrajectoryData, check_trajectory
from stridewise.operators import speed
from stridewise.operators.movement import acceleration_movement


def individual_acceleration(
    traj_data: TrajectoryData,
    frame_step: int,
    movement_direction: tuple[float, float] | None = None,
    compute_acceleration_components: bool = False,
    acceleration_calculation: AccelerationCalculation = AccelerationCalculation.BORDER_EXCLUDE,
    normalize_direction: bool = False,
) -> DataFrame:
    """id, frame (of the last of the three positions), acceleration [, a_x, a_y]."""
    check_trajectory(traj_data)
    moved = acceleration_movement(traj_data, frame_step, acceleration_calculation)
    change = lambda c: (F.col(f"end_{c}") - F.col(f"mid_{c}")) - (F.col(f"mid_{c}") - F.col(f"start_{c}"))
    x, y, length = speed.projected(change("x"), change("y"), movement_direction, normalize_direction)
    seconds = F.col("window_size") / F.lit(float(traj_data.frame_rate))
    columns = [(length / (seconds * seconds)).alias("acceleration")]
    if compute_acceleration_components:
        columns += [(x / (seconds * seconds)).alias("a_x"), (y / (seconds * seconds)).alias("a_y")]
    return moved.select("id", "frame", *columns)


def mean_acceleration_per_frame(traj_data: TrajectoryData, individual_acceleration: DataFrame, measurement_area: MeasurementArea, validate: bool = False) -> DataFrame:
    """frame, acceleration: mean over those strictly inside; 0 in frames without anyone."""
    check_trajectory(traj_data)
    if validate:
        speed._covers(individual_acceleration, traj_data.data, AccelerationError, "accelerations")
    return speed.mean_of_inside(traj_data, individual_acceleration, "acceleration", measurement_area, "acceleration")


def voronoi_acceleration(traj_data: TrajectoryData, individual_acceleration: DataFrame, individual_voronoi_intersection: DataFrame, measurement_area: MeasurementArea, validate: bool = False) -> DataFrame:
    """frame, acceleration: weighted by the cells' areas inside the measurement area, over its area."""
    check_trajectory(traj_data)
    if validate:
        speed._covers(individual_acceleration, individual_voronoi_intersection, AccelerationError, "accelerations")
    return speed.weighted_by_cells(traj_data, individual_acceleration, "acceleration", individual_voronoi_intersection, measurement_area)
