"""Operators held against hand-computed answers and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewise.enums import DataValidationStatus, DensityMethod, RsetMethod, SpeedCalculation, SpeedMethod
from stridewise.errors import ArgumentTypeError, GeometryError, ImmutableError
from stridewise.geometry import exprs
from stridewise.model import AxisAlignedMeasurementArea, Cutoff, MeasurementArea, MeasurementLine, TrajectoryData, WalkableArea
from stridewise.operators import acceleration, density, flow, line, movement, profiles, spatial, speed, validity, voronoi


def traj(spark, rows, fps=1.0):
    return TrajectoryData(spark.createDataFrame(rows, "id long, frame long, x double, y double"), fps)


def walker(spark, xs, y=0.0, fps=1.0, first=0):
    return traj(spark, [(1, first + i, float(x), y) for i, x in enumerate(xs)], fps)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def piece(*points):
    return [[{"x": float(x), "y": float(y)} for x, y in points]]


class TestGeometry:
    def test_contracts(self):
        for bad in ([(0, 0), (1, 1), (1, 0), (0, 1)], [(0, 0), (4, 0), (1, 1), (0, 4)], [(0, 0), (1, 0), (2, 0)]):
            with pytest.raises(GeometryError):
                MeasurementArea(bad)
        with pytest.raises(GeometryError):
            MeasurementLine([(0, 0), (0, 0)])
        with pytest.raises(GeometryError):
            MeasurementArea("POLYGON((0 0, 3 0, 3 3, 0 3), (1 1, 2 1, 2 2, 1 2))")
        with pytest.raises(ImmutableError):
            MeasurementLine([(0, 0), (1, 0)]).length = 3

    def test_walkable_area(self):
        assert WalkableArea("POLYGON((0 0, 4 0, 4 4, 0 4), (1 1, 2 1, 2 2, 1 2))").area == pytest.approx(15)
        assert WalkableArea([(0, 0), (4, 0), (4, 4), (0, 4)], [[(1, 1), (2, 1), (2, 2), (1, 2)]]).area == pytest.approx(15)
        assert WalkableArea([(0, 0), (4, 0), (4, 4), (0, 4)], [[(-1, -1), (1, -1), (1, 1), (-1, 1)]]).area == pytest.approx(15)
        assert WalkableArea("MULTIPOLYGON(((0 0, 2 0, 2 2, 0 2)), ((1 1, 3 1, 3 3, 1 3)))").area == pytest.approx(7)
        assert AxisAlignedMeasurementArea.from_measurement_area(MeasurementArea([(0, 0), (2, 0), (1, 3)])).bounds == (0, 0, 2, 3)

    def test_normal_vector(self):
        assert MeasurementLine("LINESTRING(0 0, 1 1)").normal_vector == pytest.approx((math.sqrt(0.5), -math.sqrt(0.5)))

    def test_line_share(self, spark):
        at = MeasurementLine([(0, 0), (1, 1)])
        df = spark.createDataFrame([(1, piece((0, 0), (1, 0), (1, 0.5), (0, 0.5))), (2, piece((0, 0), (-1, 0), (-1, -0.5), (0, -0.5)))], f"id int, p {exprs.PIECES}")
        found = dict(rows(df.select("id", exprs.line_share(F.col("p"), at).alias("s")), "id", "s"))
        assert found[1] == pytest.approx(0.5) and found[2] == pytest.approx(0)

    def test_share_of_a_border_counts_once(self, spark):
        two = piece((0, 0), (1, 0), (1, 1), (0, 1)) + piece((1, 0), (2, 0), (2, 1), (1, 1))
        df = spark.createDataFrame([(two,)], f"p {exprs.PIECES}")
        assert df.select(exprs.line_share(F.col("p"), MeasurementLine([(1, 0), (1, 1)]))).first()[0] == pytest.approx(1)
        assert df.select(exprs.area(exprs.clip_pieces(F.col("p"), MeasurementArea([(0.5, 0), (3, 0), (3, 0.5), (0.5, 0.5)])))).first()[0] == pytest.approx(0.75)


class TestTrajectory:
    def test_slice_leaves_out_the_last_frame(self, spark):
        t = walker(spark, range(5))
        assert [r[0] for r in rows(t[:].data, "frame")] == [0, 1, 2, 3]
        assert [r[0] for r in rows(t[1:3].data, "frame")] == [1, 2]
        assert [r[0] for r in rows(t[2:99].data, "frame")] == [2, 3]
        with pytest.raises(ArgumentTypeError):
            t[3]

    def test_summary(self, spark):
        t = traj(spark, [(1, 0, 0.0, 1.0), (2, 4, 3.0, -1.0)])
        assert t.bounds == (0, -1, 3, 1) and t.number_pedestrians == 2 and t.frame_range == (0, 4)

    def test_type_guard(self, spark):
        with pytest.raises(ArgumentTypeError, match="Expected 'traj_data' to be a TrajectoryData"):
            density.classic_density(spark.range(1), MeasurementArea([(0, 0), (1, 0), (1, 1)]))

    def test_boundary_is_invalid(self, spark):
        area = WalkableArea([(0, 0), (4, 0), (4, 4), (0, 4)], [[(1, 1), (2, 1), (2, 2), (1, 2)]])
        t = traj(spark, [(1, 0, 0.0, 1.0), (2, 0, 0.5, 0.5), (3, 0, 1.5, 1.5), (4, 0, 2.0, 1.5), (5, 0, 5.0, 5.0), (6, 0, 3.0, 3.0)])
        assert [r[0] for r in rows(validity.invalid_trajectory(t, area), "id")] == [1, 3, 4, 5]


class TestMovement:
    def test_exclude_is_aware_of_gaps(self, spark):
        t = traj(spark, [(1, f, float(f), 0.0) for f in (0, 1, 3, 4)])
        found = rows(movement.individual_movement(t, 1, SpeedCalculation.BORDER_EXCLUDE), "frame", "window_size")
        assert found == [(1, 3), (3, 3)]

    def test_adaptive_drops_gaps_and_borders(self, spark):
        t = traj(spark, [(1, f, float(f), 0.0) for f in (0, 1, 2, 3, 4, 6, 7, 8)])
        found = rows(movement.individual_movement(t, 2, SpeedCalculation.BORDER_ADAPTIVE), "frame", "window_size")
        assert found == [(1, 2), (2, 4), (4, 4), (6, 4), (7, 2)]

    def test_single_frame_gives_nan(self, spark):
        found = speed.individual_speed(walker(spark, [1]), 2, speed_calculation=SpeedCalculation.BORDER_SINGLE_SIDED).first()
        assert math.isnan(found.speed)

    def test_direction_quirk(self, spark):
        t = walker(spark, [0, 1, 2])
        quirk = speed.individual_speed(t, 1, movement_direction=(2.0, 0.0)).first().speed
        true = speed.individual_speed(t, 1, movement_direction=(2.0, 0.0), normalize_direction=True).first().speed
        assert quirk == pytest.approx(16) and true == pytest.approx(1)

    def test_acceleration(self, spark):
        t = walker(spark, [0, 1, 3, 6, 10], fps=2.0)
        assert rows(acceleration.individual_acceleration(t, 1), "frame", "acceleration") == [(2, 4), (3, 4), (4, 4)]

    def test_stays(self, spark):
        t = walker(spark, [-1, 1, 1.5, 5, 1, 1])
        assert rows(movement.stay_intervals(t, MeasurementArea([(0, -1), (2, -1), (2, 1), (0, 1)])), "entering_frame", "leaving_frame") == [(1, 3), (4, 6)]


class TestFlow:
    LINE = MeasurementLine([(0, -0.5), (0, 0.5)])

    def test_crossing_and_last_frame(self, spark):
        assert rows(flow.crossing_frames(walker(spark, [-2, -1, 1, 2]), self.LINE), "frame") == [(2,)]
        assert rows(flow.crossing_frames(walker(spark, [-2, -1, 1]), self.LINE), "frame") == []

    def test_pause_on_the_line(self, spark):
        assert rows(flow.crossing_frames(walker(spark, [-2, -1, 0, 0, 1, 2]), self.LINE), "frame") == [(4,)]
        assert rows(flow.crossing_frames(walker(spark, [-2, -1, 0, 0, 1, 2]), self.LINE, count_on_line=True), "frame") == [(2,), (3,), (4,)]

    def test_n_t(self, spark):
        curve, first = flow.n_t(walker(spark, [-2, -1, 1, 2, 3], fps=2.0), self.LINE)
        assert rows(curve, "frame", "cumulative_pedestrians", "time") == [(0, 0, 0), (1, 0, 0.5), (2, 1, 1), (3, 1, 1.5), (4, 1, 2)]
        assert rows(first, "id", "frame") == [(1, 2)]

    def test_no_crossing_gives_no_flow(self, spark):
        t = walker(spark, [-9, -8, -7, -6])
        curve, first = flow.n_t(t, self.LINE)
        assert flow.flow(curve, first, speed.individual_speed(t, 1), 1, 1.0).count() == 0

    def test_through_an_area(self, spark):
        t = walker(spark, [1, 0.5, -0.5, -1.5, -2.5, -3.5])
        frames, area = flow.frame_range_in_area(t, self.LINE, 2.0)
        assert area.bounds == (-2, -0.5, 0, 0.5)
        assert rows(frames, "id", "entering_frame", "leaving_frame") == [(1, 2, 4)]

    def test_time_distance_keeps_every_crossing(self, spark):
        t = walker(spark, [-1.5, -1, 1, 1.5, 1, -1, -2])
        assert flow.time_distance_line(t, self.LINE).where("frame = 0").count() == 2


class TestDensity:
    def test_zero_fill(self, spark):
        t = walker(spark, [-5, 1, 5, 1])
        found = rows(density.classic_density(t, MeasurementArea([(0, -1), (2, -1), (2, 1), (0, 1)])), "frame", "density")
        assert found == [(0, 0), (1, 0.25), (2, 0), (3, 0.25)]

    def test_passing_density(self, spark):
        per_frame = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "frame long, density double")
        frames = spark.createDataFrame([(7, 0, 2)], "id long, entering_frame long, leaving_frame long")
        assert rows(density.passing_density(per_frame, frames), "id", "density") == [(7, 1.5)]


class TestVoronoi:
    L_SHAPE = WalkableArea([(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)], [[(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)]])

    def test_cells_fill_the_area(self, spark):
        rng = np.random.default_rng(3)
        pts = [(i, f, *p) for f in range(3) for i, p in enumerate(zip(rng.uniform(1.1, 5.9, 12), rng.uniform(0.1, 1.9, 12), strict=True))]
        cells = voronoi.individual_voronoi_polygons(traj(spark, [(i, f, float(x), float(y)) for i, f, x, y in pts]), WalkableArea([(0, 0), (6, 0), (6, 2), (0, 2)]))
        for r in cells.groupBy("frame").agg(F.sum(exprs.area(F.col("polygon"))).alias("a")).collect():
            assert r.a == pytest.approx(12)

    def test_one_pedestrian_has_it_all(self, spark):
        cells = voronoi.individual_voronoi_polygons(traj(spark, [(1, 0, 1.5, 1.5)]), self.L_SHAPE)
        assert cells.select(exprs.area(F.col("polygon"))).first()[0] == pytest.approx(self.L_SHAPE.area)

    def test_parts_that_hang_apart_are_left_out(self, spark):
        area = WalkableArea([(0, 0), (5, 0), (5, 3), (0, 3)], [[(2, 0.5), (3, 0.5), (3, 3.5), (2, 3.5)]])
        cells = voronoi.individual_voronoi_polygons(traj(spark, [(1, 0, 1.0, 2.5), (2, 0, 2.5, 0.25)]), area)
        sizes = {r.id: r.a for r in cells.select("id", exprs.area(F.col("polygon")).alias("a")).collect()}
        assert sizes[1] < 6 and sum(sizes.values()) < area.area

    def test_cutoff(self, spark):
        cells = voronoi.individual_voronoi_polygons(traj(spark, [(1, 0, 5.0, 5.0)]), WalkableArea([(0, 0), (10, 0), (10, 10), (0, 10)]), Cutoff(radius=1.0))
        assert cells.select(exprs.area(F.col("polygon"))).first()[0] == pytest.approx(3.0)

    def test_four_in_a_square(self, spark):
        t = traj(spark, [(1, 0, 2.5, 2.5), (2, 0, 7.5, 2.5), (3, 0, 2.5, 7.5), (4, 0, 7.5, 7.5)])
        cells = voronoi.individual_voronoi_polygons(t, WalkableArea([(0, 0), (10, 0), (10, 10), (0, 10)]))
        assert [round(r.density, 9) for r in cells.collect()] == [0.04] * 4
        near = voronoi.neighbors(cells, as_list=False)
        assert near.count() == 12  # the corner in the middle counts as contact
        with pytest.warns(DeprecationWarning):
            assert {len(r.neighbors) for r in voronoi.neighbors(cells).collect()} == {3}
        far = rows(voronoi.neighbor_distance(t, near).where("id = 1"), "neighbor_id", "distance")
        assert far[0] == (2, 5.0) and far[2][1] == pytest.approx(math.sqrt(50))

    def test_isolated_cells_have_no_neighbours(self, spark):
        cells = spark.createDataFrame([(1, 0, piece((0, 0), (1, 0), (0, 1))), (2, 0, piece((1, 0), (2, 0), (2, 1))), (3, 0, piece((5, 5), (6, 5), (5, 6)))], f"id long, frame long, polygon {exprs.PIECES}")
        with pytest.warns(DeprecationWarning):
            assert {r.id: r.neighbors for r in voronoi.neighbors(cells).collect()} == {1: [2], 2: [1], 3: []}


class TestLine:
    LINE = MeasurementLine([(2, 0), (0, 2)])

    def tables(self, spark):
        half_a, half_b = piece((0, 0), (1, 0), (1, 1), (0, 2)), piece((1, 0), (2, 0), (1, 1))
        cells = spark.createDataFrame([(1, 3, half_a, 3.0), (2, 3, half_b, 3.0), (3, 3, [], 3.0), (4, 3, [], 3.0)], f"id long, frame long, polygon {exprs.PIECES}, density double")
        species = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, None), (4, 1.0)], "id long, species double")
        speeds = spark.createDataFrame([(1, 3, 1.0, 1.0), (2, 3, -1.0, -1.0), (3, 3, 5.0, 5.0), (4, 3, -5.0, -5.0)], "id long, frame long, v_x double, v_y double")
        return cells, species, speeds

    def test_speed_flow_density(self, spark):
        cells, species, speeds = self.tables(spark)
        n = self.LINE.normal_vector
        share = n[0] + n[1]
        found = speed.line_speed(cells, self.LINE, speeds, species, validate=True).first()
        assert found["s_sp+1"] == pytest.approx(share * 0.5) and found["s_sp-1"] == pytest.approx(share * 0.5) and found["speed"] == pytest.approx(share)
        assert flow.line_flow(cells, self.LINE, speeds, species).first()["flow"] == pytest.approx(3 * share)
        assert density.line_density(cells, self.LINE, species).first()["density"] == pytest.approx(3)

    def test_validation(self, spark):
        cells, species, speeds = self.tables(spark)
        assert line.is_species_valid(species, cells, self.LINE)
        assert not line.is_species_valid(species.where("id > 1"), cells, self.LINE)
        valid = lambda s: line.is_individual_speed_valid(s, cells, self.LINE)
        assert valid(speeds) is DataValidationStatus.DATA_CORRECT
        assert valid(speeds.drop("v_x")) is DataValidationStatus.COLUMN_MISSING
        assert valid(speeds.where("id = 1")) is DataValidationStatus.ENTRY_MISSING


class TestProfiles:
    def test_rset(self, spark):
        t = traj(spark, [(1, f, 0.5, 0.5) for f in range(5)])
        grid = profiles.to_grid(profiles.rset_map(t, 1.0, WalkableArea([(0, 0), (2, 0), (2, 2), (0, 2)]), method=RsetMethod.MAX))
        assert grid[1, 0] == 4.0 and np.isnan(grid).sum() == 3

    def test_overhang(self):
        grid = profiles.grid_cells(WalkableArea([(0, 0), (2.5, 0), (2.5, 1.2), (0, 1.2)]), grid_size=1.0)
        assert (grid.rows, grid.cols) == (2, 3)

    def test_single_cell(self, spark):
        box = AxisAlignedMeasurementArea(0, 0, 1, 1)
        unit = piece((0, 0), (1, 0), (1, 1), (0, 1))
        data = spark.createDataFrame([(1, 0, 0.5, 0.5, 2.5, unit)], f"id long, frame long, x double, y double, speed double, polygon {exprs.PIECES}")
        d, s = profiles.profiles(data, 1.0, SpeedMethod.VORONOI, axis_aligned_measurement_area=box)
        assert d.first().value == pytest.approx(1) and s.first().value == pytest.approx(2.5)
        two = data.unionByName(data.withColumns({"id": F.lit(2).cast("long"), "speed": F.lit(4.0)})).withColumn("speed", F.when(F.col("id") == 1, 2.0).otherwise(4.0))
        for method in (SpeedMethod.ARITHMETIC, SpeedMethod.MEAN):
            assert profiles.speed_profile(two, method, 1.0, axis_aligned_measurement_area=box).first().value == pytest.approx(3)

    def test_gaussian_symmetry(self, spark):
        data = spark.createDataFrame([(1, 0, 1.0, 1.0)], "id long, frame long, x double, y double")
        values = [r.value for r in profiles.density_profile(data, DensityMethod.GAUSSIAN, 1.0, axis_aligned_measurement_area=AxisAlignedMeasurementArea(0, 0, 2, 2), gaussian_width=0.5).collect()]
        assert len(values) == 4 and max(values) == pytest.approx(min(values))


class TestPairs:
    def test_histogram_is_closed_on_the_right(self, spark):
        t = traj(spark, [(1, 0, 0.0, 0.0), (2, 0, 1.0, 0.0), (3, 0, 0.0, 0.0), (1, 1, 0.0, 0.0)])
        assert rows(spatial.pair_histogram(t, 1.0), "bin", "n") == [(0, 1), (1, 2)]

    def test_function_is_reproducible(self, spark):
        rng = np.random.default_rng(1)
        t = traj(spark, [(i, f, float(rng.uniform(0, 5)), float(rng.uniform(0, 5))) for f in range(20) for i in range(6)])
        a, b = (rows(spatial.pair_distribution_function(t, 0.5, seed=4), "r", "g") for _ in range(2))
        assert a == b and len(a) > 5 and np.nanmean([g for _, g in a if np.isfinite(g)]) == pytest.approx(1, abs=0.5)
