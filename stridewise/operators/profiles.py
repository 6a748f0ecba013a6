"""Grids over areas: density and speed profiles, and times of last presence.

Profiles are long tables (frame, row, col, value) over every cell and every
frame of the data; row 0 is at the top. ``to_grid`` makes a matrix of one.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridewise.enums import DensityMethod, RsetMethod, SpeedMethod
from stridewise.errors import ArgumentTypeError, ArgumentValueError
from stridewise.geometry import exprs, kernel
from stridewise.model import AxisAlignedMeasurementArea, TrajectoryData, WalkableArea, check_trajectory
from stridewise.operators.voronoi import padded
from stridewise.shared import materialize, shared_dir
from stridewise.shipping import partitions, ship

#: Rounded constants of the Gaussian density: 2 sqrt(2 ln 2) and sqrt(2 pi). Fixed values.
FWHM_PER_SIGMA, ROOT_TWO_PI = 2.35482, 2.50662
#: Sums of bells under this are made of products that are too small to hold their digits; cells that are looked at together then.
LEAST_WEIGHT, FEW_CELLS = 1e-280, 256
#: Overlaps of Voronoi and grid cells that are clipped together.
OVERLAPS = 16384
#: Intersections under this do not count in the arithmetic speed profile.
LEAST_AREA = 1e-16


@dataclass(frozen=True)
class Grid:
    """Square cells from the top left corner of a rectangle; the last row and column may hang over."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float
    size: float

    @property
    def x_edges(self) -> np.ndarray:
        return np.arange(self.min_x, self.max_x + self.size, self.size)

    @property
    def y_edges(self) -> np.ndarray:
        """From the top down."""
        return np.arange(self.max_y, self.min_y - self.size, -self.size)

    @property
    def rows(self) -> int:
        return len(self.y_edges) - 1

    @property
    def cols(self) -> int:
        return len(self.x_edges) - 1

    def cells(self, frames: DataFrame) -> DataFrame:
        """Each row of ``frames`` with each (row, col)."""
        each = frames.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(self.rows - 1))))
        return each.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(self.cols - 1))))

    def bin(self) -> tuple[Column, Column, Column]:
        """(row, col, inside) of x, y in cells that start at the lower left corner; the last edges belong to the last cells."""
        nx, ny = self.cols, len(np.arange(self.min_y, self.max_y + self.size, self.size)) - 1
        right, top = self.min_x + nx * self.size, self.min_y + ny * self.size
        ix = F.when(F.col("x") == right, nx - 1).otherwise(F.floor((F.col("x") - F.lit(self.min_x)) / F.lit(self.size)).cast("int"))
        iy = F.when(F.col("y") == top, ny - 1).otherwise(F.floor((F.col("y") - F.lit(self.min_y)) / F.lit(self.size)).cast("int"))
        return F.lit(ny - 1) - iy, ix, (ix >= 0) & (ix < nx) & (iy >= 0) & (iy < ny)


def grid_cells(walkable_area: WalkableArea | None = None, axis_aligned_measurement_area: AxisAlignedMeasurementArea | None = None, grid_size: float = 1.0) -> Grid:
    """The grid over an area; the measurement area goes first."""
    if walkable_area is None and axis_aligned_measurement_area is None:
        raise ArgumentValueError("a grid needs a walkable area or an axis-aligned measurement area")
    if axis_aligned_measurement_area is not None and not isinstance(axis_aligned_measurement_area, AxisAlignedMeasurementArea):
        raise ArgumentTypeError("the measurement area must be an AxisAlignedMeasurementArea; from_measurement_area() makes one")
    bounds = (axis_aligned_measurement_area or walkable_area).bounds
    return Grid(*(float(b) for b in bounds), float(grid_size))


def _overlaps(data: DataFrame, grid: Grid, marks: bool = False) -> DataFrame:
    """``data`` with row, col, area and share (of the cell) of each grid cell that its Voronoi cells overlap, instead of ``polygon``.

    marks: also a row for each Voronoi cell at row and col -1. Only grid cells
    under a piece's bounding box are clipped, so the work grows with the
    overlaps; they are clipped many at a time, whatever rows they belong to.
    """
    ship(data.sparkSession)

    def cut(c: np.ndarray, r: np.ndarray, px: np.ndarray, py: np.ndarray, count: np.ndarray) -> np.ndarray:
        x0, y1 = grid.min_x + c * grid.size, grid.max_y - r * grid.size
        for a, b, edge in ((-1, 0, -x0), (1, 0, x0 + grid.size), (0, 1, y1), (0, -1, grid.size - y1)):
            px, py, count = kernel.clip_many(px, py, count, a, b, edge)
        return np.where(count > 2, kernel.areas(px, py, count), 0.0)

    @F.arrow_udf("array<struct<row:int,col:int,area:double,share:double>>")
    def overlaps(column: pa.Array) -> pa.Array:
        n = len(column)
        px, py, count, owner = padded(column)
        whole = np.bincount(owner, kernel.areas(px, py, count), n)
        corner = np.arange(px.shape[1]) < count[:, None]
        least = lambda v: np.where(corner, v, np.inf).min(axis=1)
        at = lambda v: np.floor(np.clip(v / grid.size, -1e9, 1e9)).astype(np.int64)
        c0, c1 = at(least(px) - grid.min_x), at(-least(-px) - grid.min_x)
        r0, r1 = at(grid.max_y + least(-py)), at(grid.max_y - least(py))
        over = (count > 2) & (c1 >= 0) & (c0 < grid.cols) & (r1 >= 0) & (r0 < grid.rows)
        c0, c1 = np.clip(c0, 0, grid.cols - 1), np.clip(c1, 0, grid.cols - 1)
        r0, r1 = np.clip(r0, 0, grid.rows - 1), np.clip(r1, 0, grid.rows - 1)
        ends = np.concatenate([[0], np.cumsum(np.where(over, (c1 - c0 + 1) * (r1 - r0 + 1), 0))])
        own, key, size = [np.arange(n)] * marks, [np.full(n, -1)] * marks, [np.zeros(n)] * marks
        for lo in range(0, int(ends[-1]), OVERLAPS):
            pair = np.arange(lo, min(lo + OVERLAPS, int(ends[-1])))
            place = np.searchsorted(ends, pair, side="right") - 1
            within, wide = pair - ends[place], (c1 - c0 + 1)[place]
            c, r = c0[place] + within % wide, r0[place] + within // wide
            area = cut(c, r, px[place], py[place], count[place])
            own.append(owner[place][area > 0])
            key.append((r * grid.cols + c)[area > 0])
            size.append(area[area > 0])
        own, key, size = (np.concatenate([np.zeros(0, t), *v]) for t, v in ((np.int64, own), (np.int64, key), (float, size)))
        # pieces of one cell count as one
        both, same = np.unique(own * (grid.rows * grid.cols + 1) + key + 1, return_inverse=True)
        own, key = both // (grid.rows * grid.cols + 1), both % (grid.rows * grid.cols + 1) - 1
        size = np.bincount(same, size, len(both))
        row, col = np.where(key < 0, -1, key // grid.cols), np.where(key < 0, -1, key % grid.cols)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = pa.array(size / whole[own], mask=whole[own] == 0)
        fields = [pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(size), share]
        found = pa.StructArray.from_arrays(fields, names=["row", "col", "area", "share"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), found)

    others = [c for c in data.columns if c != "polygon"]
    return data.where("polygon is not null").select(*others, F.inline(overlaps("polygon")))


def grid_cell_polygon_intersection_area(data: DataFrame, grid: Grid) -> DataFrame:
    """(id, frame, row, col, area) of the grid cells that each Voronoi cell overlaps."""
    return _overlaps(data.select("id", "frame", "polygon"), grid).drop("share")


def keep_intersections(data: DataFrame, grid: Grid, buckets: int | None = None) -> DataFrame:
    """The intersections of ``data``, computed now and kept as a table in buckets by (id, frame), sorted by both.

    Pass it as ``grid_intersections_area`` to any number of density and speed
    profiles: they join it as it lies, so only their own rows are shuffled.
    The table is in the shared folder under a name of its own, which
    ``DataFrame.inputFiles`` and the session's catalog show.
    """
    spark = data.sparkSession
    name = f"intersections_{uuid.uuid4().hex}"
    cut = grid_cell_polygon_intersection_area(data, grid)
    n = buckets or partitions(data)
    cut.repartition(n, "id", "frame").write.bucketBy(n, "id", "frame").sortBy("id", "frame").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _voronoi_values(data: DataFrame, grid: Grid, density: bool, speed: SpeedMethod | None) -> DataFrame:
    """(frame, row, col, density, speed), as asked for, of every grid cell and frame of the cells in ``data``.

    The cells are read once: a mark of each pedestrian, at row and col -1,
    keeps frames without any overlap, and empty grid cells are filled in
    between the others of their frame.
    """
    carried = ["frame"] + ["speed"] * (speed is not None)
    cut = _overlaps(data.select(*carried, "polygon"), grid, marks=True)
    area, square, values = F.col("area"), F.lit(grid.size * grid.size), {}
    if density:
        values["density"] = F.sum(F.when(F.col("row") >= 0, F.col("share"))) / square
    if speed is SpeedMethod.VORONOI:
        values["speed"] = F.sum(F.when(F.col("row") >= 0, area * F.col("speed"))) / square
    if speed is SpeedMethod.ARITHMETIC:
        values["speed"] = F.avg(F.when((F.col("row") >= 0) & (area > LEAST_AREA), F.col("speed")))
    sums = cut.groupBy("frame", "row", "col").agg(*[v.alias(n) for n, v in values.items()])
    cell = F.when(F.col("row") < 0, F.lit(-1)).otherwise(F.col("row") * grid.cols + F.col("col")).alias("cell")
    frames = sums.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct(cell, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in values]))).alias("cells"))
    empty = F.struct(F.lit(-1).alias("cell"), *[F.lit(0.0).alias(n) for n in values])

    def with_gap(own: Column, k: Column) -> Column:
        following = F.coalesce(F.get("cells", k + 1)["cell"], F.lit(grid.rows * grid.cols))
        return F.concat(F.array(own), F.array_repeat(empty, following - own["cell"] - 1))

    each = frames.select("frame", F.posexplode(F.flatten(F.transform("cells", with_gap))).alias("place", "own")).where("place > 0")
    place = F.col("place") - 1
    return each.select("frame", F.call_function("div", place, F.lit(grid.cols)).cast("int").alias("row"), (place % grid.cols).alias("col"), *[F.col(f"own.{n}").alias(n) for n in values])


def _dense(data: DataFrame, grid: Grid, values: DataFrame, fill: float | None) -> DataFrame:
    spine = grid.cells(data.select("frame").distinct())
    joined = spine.join(values, ["frame", "row", "col"], "left")
    filled = F.col("value") if fill is None else F.coalesce("value", F.lit(float(fill)))
    return joined.select("frame", "row", "col", filled.alias("value"))


def _bell_values(data: DataFrame, grid: Grid, sigma: float, scale: float) -> DataFrame:
    """(frame, row, col, value): sums of bell curves around (x, y), or means of ``speed`` weighted by them, at the cells' centres.

    A bell over x and y is a product of one over x and one over y: of a frame's
    pedestrians, a matrix by columns and one by rows are multiplied, so no row
    for each pedestrian and cell is ever made. A task holds one grid, whatever
    the size of a frame.
    """
    ship(data.sparkSession)
    cx = grid.min_x + (np.arange(grid.cols) + 0.5) * grid.size
    cy = grid.max_y - (np.arange(grid.rows) + 0.5) * grid.size
    weighted = "speed" in data.columns

    def bells(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
        d = v[:, None] - centres[None, :]
        # without a place no bell
        return np.nan_to_num(scale * np.exp(-(d * d) / (2 * sigma * sigma)), nan=0.0)

    def finished(frame: int, weights: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        value = weights
        if weighted:
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where(weights > 0, sums / weights, np.nan)
        row, col = np.divmod(np.arange(weights.size), grid.cols)
        return pa.RecordBatch.from_arrays([pa.array(np.full(weights.size, frame)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(value.ravel())], names=["frame", "row", "col", "value"])

    def run(batches):
        now, weights, sums = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            frames = batch.column(0).to_numpy()
            x, y, *speed = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(frames)) + 1, [len(frames)]])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if frames[a] != now:
                    if now is not None:
                        yield finished(now, weights, sums)
                    now, weights, sums = int(frames[a]), np.zeros((grid.rows, grid.cols)), np.zeros((grid.rows, grid.cols))
                across, down = bells(x[a:b], cx), bells(y[a:b], cy)
                own = down.T @ across
                if not weighted:
                    weights += own
                    continue
                total = down.T @ (across * speed[0][a:b, None])
                # where products lose digits, or all of them, a mean needs each bell by itself
                row, col = np.nonzero(own < LEAST_WEIGHT)
                for lo in range(0, len(row), FEW_CELLS):
                    r, c = row[lo : lo + FEW_CELLS], col[lo : lo + FEW_CELLS]
                    square = (x[a:b, None] - cx[c]) ** 2 + (y[a:b, None] - cy[r]) ** 2
                    bell = np.nan_to_num(np.exp(-square / (2 * sigma * sigma)), nan=0.0)
                    own[r, c], total[r, c] = bell.sum(axis=0), (bell * speed[0][a:b, None]).sum(axis=0)
                weights, sums = weights + own, sums + total
        if now is not None:
            yield finished(now, weights, sums)

    rows = data.where("frame is not null")
    if weighted:
        rows = rows.withColumn("speed", F.coalesce("speed", F.lit(0.0)))
    rows = rows.repartition(partitions(rows), "frame").sortWithinPartitions("frame")
    return rows.mapInArrow(run, "frame long, row int, col int, value double")


def density_profile(
    data: DataFrame,
    density_method: DensityMethod,
    grid_size: float,
    walkable_area: WalkableArea | None = None,
    axis_aligned_measurement_area: AxisAlignedMeasurementArea | None = None,
    grid_intersections_area: DataFrame | None = None,
    gaussian_width: float | None = None,
) -> DataFrame:
    """(frame, row, col, value). VORONOI needs polygon, the others x and y; GAUSSIAN a width (full, at half maximum)."""
    grid = grid_cells(walkable_area, axis_aligned_measurement_area, grid_size)
    if density_method is DensityMethod.VORONOI and grid_intersections_area is None:
        return _voronoi_values(data, grid, True, None).withColumnRenamed("density", "value")
    if density_method is DensityMethod.VORONOI:
        cut = grid_intersections_area.join(data.select("id", "frame", exprs.area(F.col("polygon")).alias("whole")), ["id", "frame"])
        sums = cut.groupBy("frame", "row", "col").agg((F.sum(F.col("area") / F.col("whole")) / F.lit(grid.size * grid.size)).alias("value"))
        return _dense(data, grid, sums, 0.0)
    if density_method is DensityMethod.CLASSIC:
        row, col, inside = grid.bin()
        counts = data.where(inside).groupBy("frame", row.alias("row"), col.alias("col")).agg((F.count("*") / F.lit(grid.size**2)).alias("value"))
        return _dense(data, grid, counts, 0.0)
    if density_method is DensityMethod.GAUSSIAN:
        if gaussian_width is None:
            raise ArgumentValueError("a Gaussian density profile needs gaussian_width")
        sigma = gaussian_width / FWHM_PER_SIGMA
        return _bell_values(data.select("frame", "x", "y"), grid, sigma, 1 / (ROOT_TWO_PI * sigma))
    raise ArgumentValueError("density method not accepted")


def speed_profile(
    data: DataFrame,
    speed_method: SpeedMethod,
    grid_size: float,
    walkable_area: WalkableArea | None = None,
    axis_aligned_measurement_area: AxisAlignedMeasurementArea | None = None,
    grid_intersections_area: DataFrame | None = None,
    fill_value: float = float("nan"),
    gaussian_width: float = 0.5,
) -> DataFrame:
    """(frame, row, col, value). Needs speed; VORONOI and ARITHMETIC polygon, the others x and y. fill_value: MEAN's value of empty cells."""
    grid = grid_cells(walkable_area, axis_aligned_measurement_area, grid_size)
    speeds = data.select("id", "frame", "speed")
    if speed_method in (SpeedMethod.VORONOI, SpeedMethod.ARITHMETIC) and grid_intersections_area is None:
        return _voronoi_values(data, grid, False, speed_method).withColumnRenamed("speed", "value")
    if speed_method is SpeedMethod.VORONOI:
        cut = grid_intersections_area.join(speeds, ["id", "frame"])
        sums = cut.groupBy("frame", "row", "col").agg((F.sum(F.col("area") * F.col("speed")) / F.lit(grid.size * grid.size)).alias("value"))
        return _dense(data, grid, sums, 0.0)
    if speed_method is SpeedMethod.ARITHMETIC:
        cut = grid_intersections_area.where(F.col("area") > LEAST_AREA).join(speeds, ["id", "frame"])
        return _dense(data, grid, cut.groupBy("frame", "row", "col").agg(F.avg("speed").alias("value")), 0.0)
    if speed_method is SpeedMethod.MEAN:
        row, col, inside = grid.bin()
        means = data.where(inside).groupBy("frame", row.alias("row"), col.alias("col")).agg(F.avg("speed").alias("value"))
        return _dense(data, grid, means, fill_value)
    if speed_method is SpeedMethod.GAUSSIAN:
        sigma = gaussian_width / (2 * math.sqrt(2 * math.log(2)))
        return _bell_values(data.select("frame", "x", "y", "speed"), grid, sigma, 1.0)
    raise ArgumentValueError("speed method not accepted")


def profiles(
    data: DataFrame,
    grid_size: float,
    speed_method: SpeedMethod,
    density_method: DensityMethod = DensityMethod.VORONOI,
    walkable_area: WalkableArea | None = None,
    axis_aligned_measurement_area: AxisAlignedMeasurementArea | None = None,
    gaussian_width: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Density and speed profiles; empty cells of a mean speed are NaN.

    If both are made of Voronoi cells, those are cut once, right away, and both
    profiles read what was written of it: a row for each frame and grid cell.
    """
    grid = grid_cells(walkable_area, axis_aligned_measurement_area, grid_size)
    if density_method is DensityMethod.VORONOI and speed_method in (SpeedMethod.VORONOI, SpeedMethod.ARITHMETIC):
        both = materialize(_voronoi_values(data, grid, True, speed_method), "profiles")
        return tuple(both.select("frame", "row", "col", F.col(n).alias("value")) for n in ("density", "speed"))
    area = {"walkable_area": walkable_area, "axis_aligned_measurement_area": axis_aligned_measurement_area}
    width = {} if gaussian_width is None else {"gaussian_width": gaussian_width}
    return density_profile(data, density_method, grid_size, **area, **width), speed_profile(data, speed_method, grid_size, **area, **width)


def voronoi_profiles(
    data: DataFrame,
    grid_size: float,
    walkable_area: WalkableArea | None = None,
    axis_aligned_measurement_area: AxisAlignedMeasurementArea | None = None,
) -> DataFrame:
    """(frame, row, col, density, speed): both Voronoi profiles of cells with speeds, which are computed and cut once."""
    return _voronoi_values(data, grid_cells(walkable_area, axis_aligned_measurement_area, grid_size), True, SpeedMethod.VORONOI)


def rset_map(traj_data: TrajectoryData, grid_size: float, walkable_area: WalkableArea | None = None, axis_aligned_measurement_area: AxisAlignedMeasurementArea | None = None, method: RsetMethod = RsetMethod.MAX) -> DataFrame:
    """(row, col, value): latest, earliest or mean time in each cell, null where nobody was."""
    check_trajectory(traj_data)
    if not isinstance(method, RsetMethod):
        raise ArgumentTypeError("method must be a RsetMethod")
    grid = grid_cells(walkable_area, axis_aligned_measurement_area, grid_size)
    row, col, inside = grid.bin()
    time = F.col("frame") / F.lit(float(traj_data.frame_rate))
    fold = {RsetMethod.MAX: F.max, RsetMethod.MIN: F.min, RsetMethod.MEAN: F.avg}[method]
    found = traj_data.data.where(inside).groupBy(row.alias("row"), col.alias("col")).agg(fold(time).alias("value"))
    one = traj_data.data.sparkSession.range(1)
    return grid.cells(one).select("row", "col").join(found, ["row", "col"], "left")


def to_grid(profile: DataFrame, frame: int | None = None) -> np.ndarray:
    """A matrix of one frame of a profile, or of a map without frames; missing values are NaN."""
    rows = (profile if frame is None else profile.where(F.col("frame") == frame)).select("row", "col", "value").collect()
    out = np.full((1 + max(r.row for r in rows), 1 + max(r.col for r in rows)), np.nan)
    for r in rows:
        if r.value is not None:
            out[r.row, r.col] = r.value
    return out
