"""Queries over the driver's tables, one for each operator, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewise import streaming
from stridewise.enums import DensityMethod, RsetMethod, SpeedCalculation, SpeedMethod
from stridewise.errors import StridewiseError
from stridewise.functions import register_functions
from stridewise.geometry import exprs
from stridewise.model import Cutoff, TrajectoryData, WalkableArea
from stridewise.operators import acceleration, density, flow, hull, line, movement, plotdata, profiles, quantiles, spatial, speed, validity, voronoi
from stridewise.plans import fixtures, oracle
from stridewise.plans import view as v
from stridewise.preprocessing import outliers, projection
from stridewise.shared import materialize
from stridewise.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{n}`"), 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(function(spark, sf_dir))

    _QUERIES[function.__name__] = run
    return function


@_query
def traj_view(spark, sf_dir):
    return v.trajectory(spark, sf_dir).data


@_query
def frame_slice(spark, sf_dir):
    return v.trajectory(spark, sf_dir)[10:60].data


@_query
def summary(spark, sf_dir):
    return v.trajectory(spark, sf_dir).summary()


@_query
def invalid_trajectory(spark, sf_dir):
    area = WalkableArea([(-9, 0.5), (11, 0.5), (11, 4.5), (-9, 4.5)], [[(2, 2), (3, 2), (3, 3), (2, 3)]])
    return validity.invalid_trajectory(v.trajectory(spark, sf_dir), area)


@_query
def classic_density(spark, sf_dir):
    return density.classic_density(v.trajectory(spark, sf_dir), v.AREA)


def _speeds(spark, sf_dir, **options):
    return speed.individual_speed(v.trajectory(spark, sf_dir), v.FRAME_STEP, **options)


@_query
def individual_speed(spark, sf_dir):
    return _speeds(spark, sf_dir, compute_velocity=True)


@_query
def individual_speed_single_sided(spark, sf_dir):
    return _speeds(spark, sf_dir, speed_calculation=SpeedCalculation.BORDER_SINGLE_SIDED)


@_query
def individual_speed_adaptive(spark, sf_dir):
    return _speeds(spark, sf_dir, speed_calculation=SpeedCalculation.BORDER_ADAPTIVE)


@_query
def individual_speed_direction(spark, sf_dir):
    return _speeds(spark, sf_dir, movement_direction=(0.6, 0.8))


@_query
def mean_speed(spark, sf_dir):
    return speed.mean_speed_per_frame(v.trajectory(spark, sf_dir), _speeds(spark, sf_dir), v.AREA)


def _accelerations(spark, sf_dir):
    return acceleration.individual_acceleration(v.trajectory(spark, sf_dir), v.FRAME_STEP, compute_acceleration_components=True)


@_query
def individual_acceleration(spark, sf_dir):
    return _accelerations(spark, sf_dir)


@_query
def mean_acceleration(spark, sf_dir):
    return acceleration.mean_acceleration_per_frame(v.trajectory(spark, sf_dir), _accelerations(spark, sf_dir), v.AREA)


@_query
def stay_intervals(spark, sf_dir):
    return movement.stay_intervals(v.trajectory(spark, sf_dir), v.AREA)


@_query
def crossing_frames(spark, sf_dir):
    return flow.crossing_frames(v.trajectory(spark, sf_dir), v.LINE)


@_query
def n_t(spark, sf_dir):
    return flow.n_t(v.trajectory(spark, sf_dir), v.LINE)[0]


@_query
def flow_(spark, sf_dir):
    curve, crossings = flow.n_t(v.trajectory(spark, sf_dir), v.LINE)
    return flow.flow(curve, crossings, _speeds(spark, sf_dir), 20, v.FRAME_RATE)


_QUERIES["flow"] = _QUERIES.pop("flow_")


def _through(spark, sf_dir):
    return flow.frame_range_in_area(v.trajectory(spark, sf_dir), v.LINE, 1.0)[0]


@_query
def frame_range_in_area(spark, sf_dir):
    return _through(spark, sf_dir)


@_query
def passing_speed(spark, sf_dir):
    return speed.passing_speed(_through(spark, sf_dir), v.FRAME_RATE, 1.0)


@_query
def passing_density(spark, sf_dir):
    return density.passing_density(density.classic_density(v.trajectory(spark, sf_dir), v.AREA), _through(spark, sf_dir))


@_query
def time_distance_line(spark, sf_dir):
    return flow.time_distance_line(v.trajectory(spark, sf_dir), v.LINE)


@_query
def voronoi_cells(spark, sf_dir):
    return v.cells(spark, sf_dir).select("id", "frame", exprs.area(F.col("polygon")).alias("area"), "density")


@_query
def voronoi_cells_cutoff(spark, sf_dir):
    cells = voronoi.individual_voronoi_polygons(v.trajectory(spark, sf_dir), v.WALKABLE, Cutoff(radius=v.CUTOFF))
    return cells.select("id", "frame", exprs.area(F.col("polygon")).alias("area"), "density")


@_query
def intersecting_polygons(spark, sf_dir):
    return density.intersecting_polygons(v.cells(spark, sf_dir), v.AREA).select("id", "frame", exprs.area(F.col("intersection")).alias("area"))


@_query
def voronoi_density(spark, sf_dir):
    return density.voronoi_density(v.cells(spark, sf_dir), v.AREA)[0]


@_query
def voronoi_speed(spark, sf_dir):
    parts = density.intersecting_polygons(v.cells(spark, sf_dir), v.AREA)
    return speed.voronoi_speed(v.trajectory(spark, sf_dir), _speeds(spark, sf_dir), parts, v.AREA)


@_query
def voronoi_acceleration(spark, sf_dir):
    parts = density.intersecting_polygons(v.cells(spark, sf_dir), v.AREA)
    return acceleration.voronoi_acceleration(v.trajectory(spark, sf_dir), _accelerations(spark, sf_dir), parts, v.AREA)


def _cells_and_species(spark, sf_dir):
    # both the species and the measure at the line read the cells there
    cells = line.at_line(v.cells(spark, sf_dir), v.LINE)
    return cells, speed.species(v.trajectory(spark, sf_dir), cells, v.LINE, v.FRAME_STEP)


@_query
def species(spark, sf_dir):
    return speed.species(v.trajectory(spark, sf_dir), v.cells(spark, sf_dir), v.LINE, v.FRAME_STEP)


def _velocities(spark, sf_dir):
    return _speeds(spark, sf_dir, compute_velocity=True, speed_calculation=SpeedCalculation.BORDER_SINGLE_SIDED)


@_query
def line_speed(spark, sf_dir):
    cells, kinds = _cells_and_species(spark, sf_dir)
    return speed.line_speed(cells, v.LINE, _velocities(spark, sf_dir), kinds)


@_query
def line_density(spark, sf_dir):
    cells, kinds = _cells_and_species(spark, sf_dir)
    return density.line_density(cells, v.LINE, kinds)


@_query
def line_flow(spark, sf_dir):
    cells, kinds = _cells_and_species(spark, sf_dir)
    return flow.line_flow(cells, v.LINE, _velocities(spark, sf_dir), kinds)


@_query
def neighbors(spark, sf_dir):
    return voronoi.neighbors(v.cells(spark, sf_dir, with_neighbors=True), as_list=False)


@_query
def neighbor_distance(spark, sf_dir):
    return voronoi.neighbor_distance(v.trajectory(spark, sf_dir), voronoi.neighbors(v.cells(spark, sf_dir, with_distances=True), as_list=False))


@_query
def pair_histogram(spark, sf_dir):
    return spatial.pair_histogram(v.trajectory(spark, sf_dir), 0.5).select("bin", "n")


@_query
def pair_distribution_function(spark, sf_dir):
    return spatial.pair_distribution_function(v.trajectory(spark, sf_dir), 0.5)


@_query
def pair_histogram_cutoff(spark, sf_dir):
    """Pairs up to 2 m, formed in bins of that width."""
    return spatial.pair_histogram(v.trajectory(spark, sf_dir), 0.5, cutoff=v.PAIR_CUTOFF).select("bin", "n")


@_query
def pair_distribution_cutoff(spark, sf_dir):
    return spatial.pair_distribution_function(v.trajectory(spark, sf_dir), 0.5, cutoff=v.PAIR_CUTOFF)


@_query
def step_quantiles(spark, sf_dir):
    """Exact quantiles of the lengths of steps."""
    dx, dy = (F.col(c) - F.lag(c).over(movement.by_id()) for c in "xy")
    steps = v.trajectory(spark, sf_dir).data.select(F.sqrt(dx * dx + dy * dy).alias("step"))
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    return spark.createDataFrame(list(zip(shares, quantiles.quantiles(steps, "step", shares), strict=True)), "share double, step double")


def _live(spark, sf_dir):
    return streaming.replay(v.trajectory(spark, sf_dir))


@_query
def live_stay_intervals(spark, sf_dir):
    return streaming.drained(streaming.live_stay_intervals(_live(spark, sf_dir), v.AREA, v.FRAME_RATE))


@_query
def live_crossings(spark, sf_dir):
    return streaming.drained(streaming.live_crossings(_live(spark, sf_dir), v.LINE, v.FRAME_RATE))


@_query
def live_first_crossings(spark, sf_dir):
    return streaming.drained(streaming.live_first_crossings(_live(spark, sf_dir), v.LINE, v.FRAME_RATE))


@_query
def live_n_t(spark, sf_dir):
    return streaming.drained(streaming.live_n_t(_live(spark, sf_dir), v.LINE, v.FRAME_RATE))


def _grid():
    return {"axis_aligned_measurement_area": v.GRID_AREA, "grid_size": 1.0}


@_query
def grid_cells(spark, sf_dir):
    """The grid over the area, with the number of positions in each cell."""
    grid = profiles.grid_cells(v.WALKABLE, v.GRID_AREA, 1.0)
    row, col, inside = grid.bin()
    counts = v.trajectory(spark, sf_dir).data.where(inside).groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("positions"))
    cells = grid.cells(spark.range(1)).select("row", "col").join(counts, ["row", "col"], "left")
    return cells.select("row", "col", F.coalesce("positions", F.lit(0)).alias("positions"))


@_query
def grid_intersection_area(spark, sf_dir):
    return profiles.grid_cell_polygon_intersection_area(v.cells(spark, sf_dir), profiles.grid_cells(v.WALKABLE, v.GRID_AREA, 1.0))


@_query
def outlier_repair(spark, sf_dir):
    return outliers.detect_anomalies(v.trajectory(spark, sf_dir))[0].data


@_query
def wall_projection(spark, sf_dir):
    area = WalkableArea([(-9, 0.5), (11, 0.5), (11, 4.5), (-9, 4.5)], [[(2, 2), (3, 2), (3, 3), (2, 3)]])
    return projection.correct_invalid_trajectories(v.trajectory(spark, sf_dir), area)[0].data


def _with_speed(spark, sf_dir):
    return v.trajectory(spark, sf_dir).data.join(_speeds(spark, sf_dir), ["id", "frame"])


def _with_cells(spark, sf_dir):
    # cells of all positions, and of those the ones with a speed; it is joined to positions, which are narrow, not to cells
    positions = v.trajectory(spark, sf_dir).data.join(_speeds(spark, sf_dir).withColumn("known", F.lit(True)), ["id", "frame"], "left")
    cells = voronoi.individual_voronoi_polygons(TrajectoryData(positions, v.FRAME_RATE), v.WALKABLE, carried=("speed", "known"))
    return cells.where("known").drop("known")


@_query
def density_profile_classic(spark, sf_dir):
    return profiles.density_profile(v.trajectory(spark, sf_dir).data, DensityMethod.CLASSIC, **_grid())


@_query
def density_profile_gaussian(spark, sf_dir):
    return profiles.density_profile(v.trajectory(spark, sf_dir).data, DensityMethod.GAUSSIAN, gaussian_width=1.0, **_grid())


@_query
def density_profile_voronoi(spark, sf_dir):
    return profiles.density_profile(_with_cells(spark, sf_dir), DensityMethod.VORONOI, **_grid())


@_query
def speed_profile_voronoi(spark, sf_dir):
    return profiles.speed_profile(_with_cells(spark, sf_dir), SpeedMethod.VORONOI, **_grid())


@_query
def speed_profile_arithmetic(spark, sf_dir):
    return profiles.speed_profile(_with_cells(spark, sf_dir), SpeedMethod.ARITHMETIC, **_grid())


@_query
def speed_profile_mean(spark, sf_dir):
    return profiles.speed_profile(_with_speed(spark, sf_dir), SpeedMethod.MEAN, fill_value=-1.0, **_grid())


@_query
def speed_profile_gaussian(spark, sf_dir):
    found = profiles.speed_profile(_with_speed(spark, sf_dir), SpeedMethod.GAUSSIAN, **_grid())
    return found.withColumn("value", F.when(F.isnan("value"), F.lit(-1.0)).otherwise(F.col("value")))


def _rset(method):
    return lambda spark, sf_dir: _rounded(profiles.rset_map(v.trajectory(spark, sf_dir), method=method, **_grid()))


for _name, _method in (("max", RsetMethod.MAX), ("min", RsetMethod.MIN), ("mean", RsetMethod.MEAN)):
    _QUERIES[f"rset_map_{_name}"] = _rset(_method)


@_query
def individual_speed_long_direction(spark, sf_dir):
    """A direction that is not a unit vector: its length counts four times."""
    return _speeds(spark, sf_dir, movement_direction=(3.0, 4.0))


@_query
def flow_without_crossing(spark, sf_dir):
    trajectory = v.trajectory(spark, sf_dir)
    curve, crossings = flow.n_t(trajectory, v.FAR_LINE)
    return flow.flow(curve, crossings, _speeds(spark, sf_dir), 20, v.FRAME_RATE)


@_query
def voronoi_cells_obstacle(spark, sf_dir):
    """Cells in an area with a hole, which is cut into trapezoids."""
    cells = voronoi.individual_voronoi_polygons(v.trajectory(spark, sf_dir), v.WITH_OBSTACLE)
    return cells.select("id", "frame", exprs.area(F.col("polygon")).alias("area"))


@_query
def voronoi_profiles(spark, sf_dir):
    return profiles.voronoi_profiles(_with_cells(spark, sf_dir), **_grid())


@_query
def compute_profiles(spark, sf_dir):
    density_, speed_ = profiles.profiles(_with_cells(spark, sf_dir), 1.0, SpeedMethod.VORONOI, axis_aligned_measurement_area=v.GRID_AREA)
    named = lambda df, name: df.select(F.lit(name).alias("profile"), "frame", "row", "col", "value")
    return named(density_, "density").unionByName(named(speed_, "speed"))


@_query
def line_validation(spark, sf_dir):
    """What the checks of species and speeds say, for complete and for missing rows."""
    cells, kinds = _cells_and_species(spark, sf_dir)
    # each check reads them; of speeds, those of the cells at the line
    kinds = materialize(kinds, "species")
    speeds = materialize(_velocities(spark, sf_dir).join(cells.select("id", "frame"), ["id", "frame"], "left_semi"), "speeds-at-line")
    found = [
        ("species", str(line.is_species_valid(kinds, cells, v.LINE)).lower()),
        ("half the species", str(line.is_species_valid(kinds.where("id % 2 = 0"), cells, v.LINE)).lower()),
        ("speeds", line.is_individual_speed_valid(speeds, cells, v.LINE).name),
        ("half the speeds", line.is_individual_speed_valid(speeds.where("id % 2 = 0"), cells, v.LINE).name),
        ("speeds without components", line.is_individual_speed_valid(speeds.drop("v_x"), cells, v.LINE).name),
    ]
    return spark.createDataFrame(found, "what string, verdict string")


def _verdict(action: Callable[[], object]) -> str:
    try:
        action()
    except StridewiseError as error:
        return type(error).__name__
    return "fine"


@_query
def guards(spark, sf_dir):
    """What raising checks say of the view: speeds that are too few or enough, species that are missing, steps that are long for a rate."""
    trajectory = v.trajectory(spark, sf_dir)
    cells, kinds = _cells_and_species(spark, sf_dir)
    kinds = materialize(kinds, "species")
    events = trajectory.data.withColumn("time", F.col("frame") / F.lit(v.FRAME_RATE))
    mean_of = lambda **options: _verdict(lambda: speed.mean_speed_per_frame(trajectory, _speeds(spark, sf_dir, **options), v.AREA, validate=True))
    fastest = files.fastest_step(events, 1.0)
    found = [
        ("speeds without borders", mean_of()),
        ("speeds of all rows", mean_of(speed_calculation=SpeedCalculation.BORDER_SINGLE_SIDED)),
        ("all species", _verdict(lambda: density.line_density(cells, v.LINE, kinds, validate=True))),
        ("half the species", _verdict(lambda: density.line_density(cells, v.LINE, kinds.where("id % 2 = 0"), validate=True))),
        *((f"steps at {rate:g} a second", "long" if fastest / rate > 0.1 else "fine") for rate in (v.FRAME_RATE, 100 * v.FRAME_RATE)),
    ]
    return spark.createDataFrame(found, "what string, verdict string")


@_query
def outlier_repair_planted(spark, sf_dir):
    """Single jumps planted in some trajectories are replaced, ids become 1 to n."""
    return outliers.detect_anomalies(v.jumping(spark, sf_dir))[0].data


@_query
def outlier_changes(spark, sf_dir):
    return outliers.detect_anomalies(v.jumping(spark, sf_dir))[1]


@_query
def wall_projection_one_wall(spark, sf_dir):
    return projection.correct_invalid_trajectories(v.trajectory(spark, sf_dir), v.ABOVE_WALL)[0].data


@_query
def track_ends(spark, sf_dir):
    return plotdata.ends(v.trajectory(spark, sf_dir))


@_query
def speed_distribution(spark, sf_dir):
    return plotdata.distribution(_speeds(spark, sf_dir), "speed")


@_query
def density_over_time(spark, sf_dir):
    return plotdata.with_time(density.classic_density(v.trajectory(spark, sf_dir), v.AREA), v.FRAME_RATE)


@_query
def neighborhood_roles(spark, sf_dir):
    trajectory = v.trajectory(spark, sf_dir)
    # a frame's cells depend on no other frame
    cells = voronoi.individual_voronoi_polygons(TrajectoryData(trajectory.data.where("frame = 40"), v.FRAME_RATE), v.WALKABLE, with_neighbors=True)
    return plotdata.neighborhood_at(voronoi.neighbors(cells, as_list=False), trajectory, 40, 30)


@_query
def mean_density_profile(spark, sf_dir):
    return plotdata.mean_profile(profiles.density_profile(v.trajectory(spark, sf_dir).data, DensityMethod.CLASSIC, **_grid()))


@_query
def time_distance_speed(spark, sf_dir):
    return plotdata.time_distance_with_speed(flow.time_distance_line(v.trajectory(spark, sf_dir), v.LINE), _speeds(spark, sf_dir))


@_query
def time_distance_starts(spark, sf_dir):
    return plotdata.time_distance_starts(flow.time_distance_line(v.trajectory(spark, sf_dir), v.LINE))


@_query
def sql_functions(spark, sf_dir):
    register_functions(spark, {"measured": v.AREA}, {"door": v.LINE})
    v.trajectory(spark, sf_dir).data.createOrReplaceTempView("stridewise_positions")
    return spark.sql("SELECT id, frame, in_measured(x, y) AS inside, distance_to_door(x, y) AS distance FROM stridewise_positions")


@_query
def gap_filling(spark, sf_dir):
    """Tracks with planted gaps of two and of six frames; those of up to four are filled."""
    register_functions(spark)
    v.with_gaps(spark, sf_dir).data.createOrReplaceTempView("stridewise_gaps")
    return spark.sql("SELECT id, frame, x, y, filled FROM fill_gaps(TABLE(stridewise_gaps) PARTITION BY (id) ORDER BY (frame), 4)")


@_query
def crowd_hull(spark, sf_dir):
    """The convex hull of each frame's pedestrians."""
    return hull.convex_hulls(v.trajectory(spark, sf_dir).data).drop("hull")


@_query
def profiles_of_kept_intersections(spark, sf_dir):
    """Density and speed profiles that join one bucketed table of intersections."""
    # the kept table and each profile read the cells, and the frames they are in
    data = materialize(_with_cells(spark, sf_dir), "profiles-cells")
    kept = profiles.keep_intersections(data, profiles.grid_cells(v.WALKABLE, v.GRID_AREA, 1.0))
    density_ = profiles.density_profile(data, DensityMethod.VORONOI, grid_intersections_area=kept, **_grid())
    speed_ = profiles.speed_profile(data, SpeedMethod.ARITHMETIC, grid_intersections_area=kept, **_grid())
    named = lambda df, name: df.select(F.lit(name).alias("profile"), "frame", "row", "col", "value")
    return named(density_, "density").unionByName(named(speed_, "speed"))


@_query
def source_text(spark, sf_dir):
    """Positions written by the text writer and read back."""
    path = fixtures.folder(spark, "text")
    files.write_trajectory_txt(v.trajectory(spark, sf_dir), path)
    return files.load_trajectory(path, spark=spark).data


@_query
def source_areas(spark, sf_dir):
    """Areas of a floor (the box around its walls, half a metre wider, less the walls) and of a scenario, both made around the positions."""
    trajectory = v.trajectory(spark, sf_dir)
    floor = files.load_walkable_area_from_crowdit(fixtures.floor(trajectory), buffer=0.5, spark=spark)
    scenario = files.load_walkable_area_from_vadere(fixtures.scenario(trajectory), spark=spark)
    return spark.createDataFrame([("floor", floor.area), ("scenario", scenario.area)], "source string, area double")


@_query
def trajectory_validity(spark, sf_dir):
    trajectory = v.trajectory(spark, sf_dir)
    found = [(name, validity.is_trajectory_valid(trajectory, area)) for name, area in (("box", v.WALKABLE), ("above the wall", v.ABOVE_WALL))]
    return spark.createDataFrame(found, "area string, valid boolean")


@_query
def source_viswalk(spark, sf_dir):
    return files.load_trajectory_from_viswalk(fixtures.viswalk(v.trajectory(spark, sf_dir)), spark=spark).data


@_query
def source_pathfinder_csv(spark, sf_dir):
    return files.load_trajectory_from_pathfinder_csv(fixtures.csv(v.trajectory(spark, sf_dir), ("id", "t", "x", "y")), spark=spark).data


@_query
def source_crowdit(spark, sf_dir):
    return files.load_trajectory_from_crowdit(fixtures.csv(v.trajectory(spark, sf_dir), ("pedID", "time", "posX", "posY")), spark=spark).data


@_query
def source_pathfinder_json(spark, sf_dir):
    few = v.trajectory(spark, sf_dir)
    return files.load_trajectory_from_pathfinder_json(fixtures.nested_json(few), spark=spark).data


@_query
def source_vadere(spark, sf_dir):
    """Events at the frames' times, resampled to twice the rate."""
    return files.load_trajectory_from_vadere(fixtures.events(v.trajectory(spark, sf_dir)), 2 * v.FRAME_RATE, spark=spark).data


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLES)
