"""Positions outside the walkable area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.geometry.exprs import within_walkable
from stridewise.model import TrajectoryData, WalkableArea, check_trajectory


def invalid_trajectory(traj_data: TrajectoryData, walkable_area: WalkableArea) -> DataFrame:
    """Rows that do not lie strictly inside the walkable area."""
    check_trajectory(traj_data)
    return traj_data.data.where(~within_walkable(F.col("x"), F.col("y"), walkable_area))


def is_trajectory_valid(traj_data: TrajectoryData, walkable_area: WalkableArea) -> bool:
    return invalid_trajectory(traj_data, walkable_area).isEmpty()
