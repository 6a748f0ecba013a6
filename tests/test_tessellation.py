"""Cells and neighbours from a grid of bins, and plans that compute cells once."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stridewise.enums import DensityMethod, SpeedMethod
from stridewise.geometry import exprs, kernel
from stridewise.model import AxisAlignedMeasurementArea, Cutoff, MeasurementArea, MeasurementLine, TrajectoryData, WalkableArea
from stridewise.operators import density, flow, line, profiles, speed, voronoi

OCTAGON = [(0.8 * np.cos(a), 0.8 * np.sin(a)) for a in np.arange(8) * np.pi / 4]


def points(kind, n=250):
    rng = np.random.default_rng(len(kind))
    x, y = rng.uniform(0, 20, n), rng.uniform(0, 5, n)
    if kind == "lattice":  # four cells meet in each corner, several points at one place
        x, y = np.round(x * 2) / 2, np.round(y * 2) / 2
    if kind == "line":
        y = np.full(n, 2.0)
    if kind == "one place":
        x[20:60], y[20:60] = x[0], y[0]
    if kind == "outlier":
        x[0] = 1e5
    return x, y


class TestKernel:
    @pytest.mark.parametrize("corners", [None, OCTAGON])
    @pytest.mark.parametrize("kind", ["even", "lattice", "line", "one place", "outlier"])
    def test_cells_and_contacts(self, kind, corners):
        x, y = points(kind)
        box = (0.0, 0.0, max(20.0, x.max()), 5.0)
        pairs: list = []
        px, py, count = kernel.voronoi(x, y, box, corners, pairs)
        cells = [[np.stack([px[i, : count[i]], py[i, : count[i]]], axis=1)] for i in range(len(x))]
        assert set(kernel.touching(cells, 1e-9, pairs[0])) == set(kernel.touching(cells, 1e-9))
        if corners is None:
            # every place of the box is in the cell of a nearest point
            rng = np.random.default_rng(0)
            probe = np.stack([rng.uniform(0, 20, 300), rng.uniform(0, 5, 300)], axis=1)
            for u, v in probe:
                square = (x - u) ** 2 + (y - v) ** 2
                i = int(square.argmin())
                assert kernel.in_piece(np.array([u]), np.array([v]), cells[i][0])[0]
            first = np.unique(np.stack([x, y], axis=1), axis=0, return_index=True)[1]
            assert kernel.areas(px, py, count)[first].sum() == pytest.approx((box[2]) * 5)

    def test_a_crowded_frame(self):
        rng = np.random.default_rng(1)
        x, y = rng.uniform(0, 100, 20000), rng.uniform(0, 50, 20000)
        began, pairs = time.perf_counter(), []
        px, py, count = kernel.voronoi(x, y, (0.0, 0.0, 100.0, 50.0), None, pairs)
        assert time.perf_counter() - began < 30  # a matrix of distances would hold 400 million numbers
        assert kernel.areas(px, py, count).sum() == pytest.approx(5000)
        assert 55000 < len(pairs[0][0]) < 62000

    def test_frames_over_batches(self):
        frames = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5]
        batches = [pa.RecordBatch.from_arrays([pa.array(frames[a:b])], names=["frame"]) for a, b in ((0, 1), (1, 1), (1, 4), (4, 5), (5, 8), (8, 10))]
        got = [t.column(0).to_pylist() for t in voronoi.by_frame(batches, 0)]
        assert sum(got, []) == frames and all(set(a).isdisjoint(b) for a, b in zip(got, got[1:], strict=False))


AREA = WalkableArea([(0, 0), (20, 0), (20, 5), (0, 5)])
LINE = MeasurementLine([(10, 0), (10, 5)])
GRID = {"axis_aligned_measurement_area": AxisAlignedMeasurementArea(2, 0, 8, 5), "grid_size": 1.0}


@pytest.fixture
def walk(spark):
    rows = [(i, f, float(x), float(y)) for f in (*range(6), 8) for i, (x, y) in enumerate(zip(*points("even", 30), strict=True)) if f != 5 or x > 9]
    return TrajectoryData(spark.createDataFrame([(i, f, x + 0.01 * f, y) for i, f, x, y in rows], "id long, frame long, x double, y double"), 1.0)


def tessellations(df):
    """MapInArrow nodes that a run of the plan computes."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("MapInArrow")


class TestOnce:
    def cells(self, walk, **options):
        return voronoi.individual_voronoi_polygons(walk, AREA, **options)

    def test_neighbors_come_with_the_cells(self, spark, walk):
        for cut in (None, Cutoff(radius=0.8)):
            both = self.cells(walk, cut_off=cut, with_neighbors=True)
            apart = voronoi.neighbors(self.cells(walk, cut_off=cut), as_list=False)
            near = voronoi.neighbors(both, as_list=False)
            assert sorted(map(tuple, near.collect())) == sorted(map(tuple, apart.collect()))
            assert tessellations(near) == 1 and near._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hash") == 1
        with pytest.warns(DeprecationWarning):
            lists = voronoi.neighbors(both, as_list=True)
        assert lists.count() == both.count()

    def test_density_and_profiles(self, walk):
        cells = self.cells(walk)
        with_speed = cells.withColumn("speed", F.lit(1.5))
        per_frame, _ = density.voronoi_density(cells, MeasurementArea([(4, 0), (8, 0), (8, 5), (4, 5)]))
        for df in (
            per_frame, profiles.density_profile(cells, DensityMethod.VORONOI, **GRID), profiles.speed_profile(with_speed, SpeedMethod.VORONOI, **GRID),
            profiles.speed_profile(with_speed, SpeedMethod.ARITHMETIC, **GRID), profiles.voronoi_profiles(with_speed, **GRID),
        ):
            assert tessellations(df) == 1
        for df in profiles.profiles(with_speed, 1.0, SpeedMethod.VORONOI, axis_aligned_measurement_area=GRID["axis_aligned_measurement_area"]):
            assert tessellations(df) == 0

    def test_folded_profiles_equal_those_of_given_intersections(self, walk):
        data = self.cells(walk).withColumn("speed", F.col("id") + 0.5)
        cut = profiles.grid_cell_polygon_intersection_area(data, profiles.grid_cells(**GRID))
        rounded = lambda df: sorted((r.frame, r.row, r.col, round(r.value, 9)) for r in df.collect())
        own = rounded(profiles.density_profile(data, DensityMethod.VORONOI, **GRID))
        assert own == rounded(profiles.density_profile(data, DensityMethod.VORONOI, grid_intersections_area=cut, **GRID))
        assert len(own) == 7 * 30 and {r[0] for r in own} == {0, 1, 2, 3, 4, 5, 8}
        for method in (SpeedMethod.VORONOI, SpeedMethod.ARITHMETIC):
            assert rounded(profiles.speed_profile(data, method, **GRID)) == rounded(profiles.speed_profile(data, method, grid_intersections_area=cut, **GRID))

    def test_line_quantities_read_the_cells_at_the_line(self, spark, walk):
        cells = self.cells(walk)
        met = line.at_line(cells, LINE)
        assert 0 < met.count() < cells.count()
        speeds = walk.data.select("id", "frame", F.lit(1.0).alias("v_x"), F.lit(0.5).alias("v_y"))
        results = []
        for given in (cells, met):
            kinds = speed.species(walk, given, LINE, 1)
            short = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
            results.append([sorted(map(short, df.collect())) for df in (kinds, density.line_density(given, LINE, kinds), speed.line_speed(given, LINE, speeds, kinds), flow.line_flow(given, LINE, speeds, kinds))])
        assert results[0] == results[1] and tessellations(flow.line_flow(met, LINE, speeds, kinds)) == 0

    def test_empty(self, spark, walk):
        none = TrajectoryData(walk.data.limit(0), 1.0)
        cells = self.cells(none, with_neighbors=True)
        assert cells.count() == 0 and profiles.voronoi_profiles(cells.withColumn("speed", F.lit(1.0)), **GRID).count() == 0
        assert density.voronoi_density(cells, MeasurementArea([(4, 0), (8, 0), (8, 5)]))[0].count() == 0
        assert exprs.PIECES in cells.schema["polygon"].dataType.simpleString()
