"""What the cells that meet a line add up to, by walking direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridewise.enums import DataValidationStatus
from stridewise.errors import InputError
from stridewise.geometry import exprs
from stridewise.model import MeasurementLine
from stridewise.shared import materialize


def share(measurement_line: MeasurementLine) -> Column:
    """The share of the line inside ``polygon``."""
    return exprs.line_share(F.col("polygon"), measurement_line)


def normal_speed(measurement_line: MeasurementLine) -> Column:
    nx, ny = measurement_line.normal_vector
    return F.col("v_x") * F.lit(nx) + F.col("v_y") * F.lit(ny)


def _meeting(cells: DataFrame, measurement_line: MeasurementLine) -> DataFrame:
    return cells.where(exprs.meets_line(F.col("polygon"), measurement_line))


def at_line(cells: DataFrame, measurement_line: MeasurementLine) -> DataFrame:
    """The cells that meet the line, computed now and kept in the shared folder.

    Species, densities, speeds and flows at the line look at no other cells and
    give the same for these: pass them to all of those instead of ``cells``,
    which then are computed once. ``shared.release`` deletes them.
    """
    return materialize(_meeting(cells, measurement_line), "at-line")


def by_species(cells: DataFrame, measurement_line: MeasurementLine, species: DataFrame, value: Column, speeds: DataFrame | None, up: str, down: str, total: str, flip: bool) -> DataFrame:
    """Per frame, the sum of ``value`` over species 1 and -1 (null if it has none) and both; latest frame first."""
    found = _meeting(cells, measurement_line).join(species, "id", "left")
    if speeds is not None:
        found = found.join(speeds.select("id", "frame", "v_x", "v_y"), ["id", "frame"])
    found = found.where(F.col("species").isin(1.0, -1.0)).select("frame", "species", value.alias("__value"))
    of = lambda s, sign: F.sum(F.when(F.col("species") == s, F.lit(sign) * F.col("__value")))
    sums = found.groupBy("frame").agg(of(1.0, 1.0).alias(up), of(-1.0, -1.0 if flip else 1.0).alias(down))
    sums = sums.withColumn(total, F.coalesce(F.col(f"`{up}`"), F.lit(0.0)) + F.coalesce(F.col(f"`{down}`"), F.lit(0.0)))
    return sums.orderBy(F.desc("frame"))


def is_species_valid(species: DataFrame, individual_voronoi_polygons: DataFrame, measurement_line: MeasurementLine) -> bool:
    """Whether species has every id whose cell ever meets the line."""
    return _meeting(individual_voronoi_polygons, measurement_line).join(species, "id", "left_anti").isEmpty()


def is_individual_speed_valid(individual_speed: DataFrame, individual_voronoi_polygons: DataFrame, measurement_line: MeasurementLine) -> DataValidationStatus:
    """Whether speeds have all columns, and values for every cell that meets the line."""
    if not {"id", "frame", "v_x", "v_y"} <= set(individual_speed.columns):
        return DataValidationStatus.COLUMN_MISSING
    joined = _meeting(individual_voronoi_polygons, measurement_line).select("id", "frame").join(individual_speed, ["id", "frame"], "left")
    missing = F.lit(False)
    for name, kind in joined.dtypes:
        missing = missing | F.col(f"`{name}`").isNull() | (F.isnan(f"`{name}`") if kind in ("double", "float") else F.lit(False))
    return DataValidationStatus.DATA_CORRECT if joined.where(missing).isEmpty() else DataValidationStatus.ENTRY_MISSING


def validate(species: DataFrame, individual_voronoi_polygons: DataFrame, measurement_line: MeasurementLine, individual_speed: DataFrame | None = None) -> None:
    """Raise unless species and speeds cover the cells that meet the line; runs two small jobs."""
    if not is_species_valid(species, individual_voronoi_polygons, measurement_line):
        raise InputError("species lacks pedestrians whose cells meet the line; compute it with the same cells and line")
    if individual_speed is not None:
        status = is_individual_speed_valid(individual_speed, individual_voronoi_polygons, measurement_line)
        if status is DataValidationStatus.COLUMN_MISSING:
            raise InputError("individual speeds need the columns id, frame, v_x and v_y; compute them with compute_velocity=True")
        if status is DataValidationStatus.ENTRY_MISSING:
            raise InputError("individual speeds lack values for cells that meet the line; another speed calculation may give them")
