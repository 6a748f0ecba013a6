"""Classic, Voronoi, passing and line densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.geometry import exprs
from stridewise.model import MeasurementArea, MeasurementLine, TrajectoryData, check_trajectory
from stridewise.operators import line
from stridewise.operators.frames import frame_spine, zero_filled
from stridewise.operators.intervals import interval_means


def classic_density(traj_data: TrajectoryData, measurement_area: MeasurementArea) -> DataFrame:
    """frame, density: pedestrians strictly inside over the area; 0 in frames of the trajectory without any."""
    check_trajectory(traj_data)
    inside = traj_data.data.where(exprs.in_convex(F.col("x"), F.col("y"), measurement_area))
    counts = inside.groupBy("frame").agg((F.count("*") / F.lit(float(measurement_area.area))).alias("density"))
    return zero_filled(counts, traj_data.data, "density")


def intersecting_polygons(individual_voronoi_data: DataFrame, measurement_area: MeasurementArea) -> DataFrame:
    """id, frame, intersection: each cell's part inside the area, possibly empty."""
    return individual_voronoi_data.select("id", "frame", exprs.clip_pieces(F.col("polygon"), measurement_area).alias("intersection"))


def voronoi_density(individual_voronoi_data: DataFrame, measurement_area: MeasurementArea) -> tuple[DataFrame, DataFrame]:
    """(frame, density) over the cells' frame range, and the cells with their intersections."""
    cells = individual_voronoi_data.withColumn("intersection", exprs.clip_pieces(F.col("polygon"), measurement_area))
    part = exprs.area(F.col("intersection")) / exprs.area(F.col("polygon"))
    # each frame of the cells has a sum; the filter, which a join would add, keeps both readers of the sums alike
    sums = cells.where("frame is not null").groupBy("frame").agg((F.sum(part) / F.lit(float(measurement_area.area))).alias("density"))
    return zero_filled(sums, None, "density"), cells


def passing_density(density_per_frame: DataFrame, frames: DataFrame) -> DataFrame:
    """id, density: mean over the frames from entering to before leaving."""
    stays = frames.where("leaving_frame > entering_frame").select("id", "entering_frame", (F.col("leaving_frame") - 1).alias("last_frame"))
    return interval_means(density_per_frame, stays, "density", "entering_frame", "last_frame", "density").select("id", "density")


def line_density(individual_voronoi_polygons: DataFrame, measurement_line: MeasurementLine, species: DataFrame, validate: bool = False) -> DataFrame:
    """frame, p_sp+1, p_sp-1, density, latest frame first."""
    if validate:
        line.validate(species, individual_voronoi_polygons, measurement_line)
    value = F.col("density") * line.share(measurement_line)
    return line.by_species(individual_voronoi_polygons, measurement_line, species, value, None, "p_sp+1", "p_sp-1", "density", flip=False)


__all__ = ["classic_density", "frame_spine", "intersecting_polygons", "line_density", "passing_density", "voronoi_density"]
