"""Crossings of lines, N-t curves, flows, stays between two lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridewise.geometry import exprs
from stridewise.model import MeasurementArea, MeasurementLine, TrajectoryData, check_trajectory
from stridewise.operators import line
from stridewise.operators.frames import frame_spine
from stridewise.operators.intervals import interval_means
from stridewise.operators.movement import by_id, stay_intervals, whole_id

#: An end nearer to the line than this counts as on it.
ON_LINE = 1e-5


def crossing_frames(traj_data: TrajectoryData, measurement_line: MeasurementLine, count_on_line: bool = False) -> DataFrame:
    """id, frame: frames in which the step from the frame before meets the line.

    The step must end off the line unless count_on_line is set. A pedestrian's
    first and last frames never count, nor do frames next to a gap.
    """
    check_trajectory(traj_data)
    before = lambda c: F.lag(c).over(by_id())
    steps = traj_data.data.select("id", "frame", "x", "y").withColumns(
        {"x0": before("x"), "y0": before("y"), "gap": F.col("frame") - before("frame"), "ahead": F.lead("frame").over(by_id()) - F.col("frame"), "last": F.max("frame").over(whole_id())}
    )
    steps = steps.where("gap = 1 and frame < last and ahead = 1")
    x, y = F.col("x"), F.col("y")
    met = exprs.segments_meet(F.col("x0"), F.col("y0"), x, y, measurement_line)
    if not count_on_line:
        met = met & (exprs.point_segment_distance(x, y, measurement_line) >= ON_LINE)
    return steps.where(met).select("id", "frame")


def n_t(traj_data: TrajectoryData, measurement_line: MeasurementLine) -> tuple[DataFrame, DataFrame]:
    """(frame, cumulative_pedestrians, time) over all frames, and (id, frame) of first crossings."""
    first = crossing_frames(traj_data, measurement_line).groupBy("id").agg(F.min("frame").alias("frame"))
    counts = first.groupBy("frame").agg(F.count("*").alias("n"))
    every = frame_spine(traj_data.data).join(counts, "frame", "left")
    # one row per frame: the running sum is over aggregated rows
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    curve = every.select("frame", total.cast("long").alias("cumulative_pedestrians"), (F.col("frame") / F.lit(float(traj_data.frame_rate))).alias("time"))
    return curve, first


def flow(nt: DataFrame, crossing_frames: DataFrame, individual_speed: DataFrame, delta_frame: int, frame_rate: float) -> DataFrame:
    """flow, mean_speed (and window_start, window_end): N sampled every delta_frame frames from its first crossing on.

    A window ends where the sampled N has changed, one frame after it was
    first reached; the mean speed is over first crossings in the window,
    both ends included. Nobody crossing gives no row.
    """
    bounds = nt.agg(F.min(F.when(F.col("cumulative_pedestrians") > 0, F.col("frame"))).alias("f0"), F.max("frame").alias("last"))
    grid = bounds.where("f0 is not null and f0 + {0} < last".format(int(delta_frame))).select("f0", F.explode(F.sequence(F.col("f0") + delta_frame, F.col("last") - 1, F.lit(delta_frame).cast("long"))).alias("frame"))
    sampled = grid.join(nt.select("frame", "cumulative_pedestrians"), "frame").groupBy("f0", "cumulative_pedestrians").agg(F.min("frame").alias("sampled"))
    reached = nt.groupBy("cumulative_pedestrians").agg((F.min("frame") + 1).alias("passed"))
    order = Window.orderBy("cumulative_pedestrians")
    windows = sampled.join(reached, "cumulative_pedestrians").withColumns({"n0": F.lag("cumulative_pedestrians", 1, 0).over(order), "window_start": F.lag("passed").over(order)})
    windows = windows.withColumn("window_start", F.coalesce("window_start", "f0")).where("cumulative_pedestrians > n0")
    value = (F.col("cumulative_pedestrians") - F.col("n0")) / (F.col("passed") - F.col("window_start")) * F.lit(float(frame_rate))
    windows = windows.select(value.alias("flow"), "window_start", F.col("passed").alias("window_end"))
    speeds = crossing_frames.join(individual_speed.select("id", "frame", "speed"), ["id", "frame"])
    means = interval_means(speeds, windows, "speed", "window_start", "window_end", "mean_speed")
    return means.select("flow", "mean_speed", "window_start", "window_end")


def line_flow(individual_voronoi_polygons: DataFrame, measurement_line: MeasurementLine, individual_speed: DataFrame, species: DataFrame, validate: bool = False) -> DataFrame:
    """frame, j_sp+1, j_sp-1, flow, latest frame first."""
    if validate:
        line.validate(species, individual_voronoi_polygons, measurement_line, individual_speed)
    value = line.normal_speed(measurement_line) * F.col("density") * line.share(measurement_line)
    return line.by_species(individual_voronoi_polygons, measurement_line, species, value, individual_speed, "j_sp+1", "j_sp-1", "flow", flip=True)


def frame_range_in_area(traj_data: TrajectoryData, measurement_line: MeasurementLine, width: float) -> tuple[DataFrame, MeasurementArea]:
    """(id, entering_frame, leaving_frame) of stays that enter over one line and leave over the other, and the area between.

    The second line lies ``width`` to the left of the first.
    """
    other = measurement_line.offset(width)
    area = MeasurementArea([*measurement_line.coords, *other.coords[::-1]])
    stays = stay_intervals(traj_data, area)
    crossed = [crossing_frames(traj_data, at, count_on_line=True) for at in (measurement_line, other)]
    flag = lambda rows, at, name: rows.distinct().select("id", F.col("frame").alias(at), F.lit(True).alias(name))
    for k, rows in enumerate(crossed):
        stays = stays.join(flag(rows, "entering_frame", f"in{k}"), ["id", "entering_frame"], "left").join(flag(rows, "leaving_frame", f"out{k}"), ["id", "leaving_frame"], "left")
    through = stays.where("(in0 and out1) or (in1 and out0)").select("id", "entering_frame", "leaving_frame")
    return through, area


def time_distance_line(traj_data: TrajectoryData, measurement_line: MeasurementLine) -> DataFrame:
    """id, frame, time, distance: frames until each crossing of the pedestrian, and the way to the line."""
    crossings = crossing_frames(traj_data, measurement_line).select("id", F.col("frame").alias("crossing_frame"))
    rows = traj_data.data.select("id", "frame", exprs.point_segment_distance(F.col("x"), F.col("y"), measurement_line).alias("distance"))
    time = (F.col("crossing_frame") - F.col("frame")) / F.lit(float(traj_data.frame_rate))
    return rows.join(crossings, "id").select("id", "frame", time.alias("time"), "distance").where("time >= 0")
