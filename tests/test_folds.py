"""Convex hulls, gaps of tracks, separable bell curves and kept intersections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewise.enums import DensityMethod, SpeedMethod
from stridewise.functions import register_functions
from stridewise.model import AxisAlignedMeasurementArea
from stridewise.operators import hull, profiles

POSITIONS = "id long, frame long, x double, y double"


class TestHulls:
    def brute(self, points):
        """Directed edges that have all other points on their left, or between their ends."""
        points = sorted(set(points))
        if len(points) < 3:
            return set(points)
        found = set()
        for a in points:
            for b in points:
                sides = [((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]), (c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1])) for c in points if c not in (a, b)]
                if a != b and all(s > 0 or (s == 0 and t <= 0) for s, t in sides):
                    found |= {a, b}
        return found

    def test_against_all_edges(self, spark, monkeypatch):
        monkeypatch.setattr(hull, "MOST_HELD", 20)  # tasks pass corners on in parts
        rng = np.random.default_rng(2)
        rows = [(i, int(f), float(x), float(y)) for i, (f, x, y) in enumerate(zip(rng.integers(0, 6, 300), rng.integers(-4, 5, 300), rng.integers(-3, 4, 300), strict=True))]
        rows += [(900, 7, 1.0, 1.0), (901, 7, 1.0, 1.0), (902, 8, 0.0, 0.0), (903, 8, 3.0, 4.0), (904, 8, 1.5, 2.0), (905, 9, None, 1.0), (906, 9, float("nan"), 1.0), (907, None, 0.0, 0.0)]
        found = {r.frame: r for r in hull.convex_hulls(spark.createDataFrame(rows, POSITIONS).repartition(5)).collect()}
        assert set(found) == {0, 1, 2, 3, 4, 5, 7, 8}
        for f, r in found.items():
            corners = [(p.x, p.y) for p in r.hull]
            assert set(corners) == self.brute([(x, y) for _, g, x, y in rows if g == f]) and len(corners) == r.corners
            turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(corners, corners[1:] + corners[:1], corners[2:] + corners[:2], strict=True)]
            assert len(corners) < 3 or min(turns) > 0
        assert (found[7].area, found[7].perimeter, found[8].area, found[8].perimeter) == (0, 0, 0, 10.0)

    def test_corners_alone_are_shuffled(self, spark):
        rng = np.random.default_rng(0)
        rows = [(i, 1, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (4000, 2)))]
        df = spark.createDataFrame(rows, POSITIONS).coalesce(1)
        part = df.select(F.col("frame").alias("key"), "x", "y").mapInArrow(hull._folded, "key long, x double, y double")
        assert part.count() < 60
        assert hull.convex_hulls(df.withColumnRenamed("frame", "area_no"), by="area_no").first().area > 0.9

    def test_empty(self, spark):
        assert hull.convex_hulls(spark.createDataFrame([], POSITIONS)).count() == 0


class TestGaps:
    def filled(self, spark, rows, longest, columns=POSITIONS):
        register_functions(spark)
        spark.createDataFrame(rows, columns).repartition(3).createOrReplaceTempView("tracks_with_gaps")
        return sorted(map(tuple, spark.sql(f"SELECT * FROM fill_gaps(TABLE(tracks_with_gaps) PARTITION BY (id) ORDER BY (frame), {longest})").collect()))

    def test_filling(self, spark):
        rows = [(1, 0, 0.0, 0.0), (1, 3, 3.0, 6.0), (1, 9, 0.0, 0.0), (2, 5, 1.0, 1.0), (2, 7, None, 1.0), (2, 9, 2.0, 2.0)]
        assert self.filled(spark, rows, 2) == [
            (1, 0, 0.0, 0.0, False), (1, 1, 1.0, 2.0, True), (1, 2, 2.0, 4.0, True), (1, 3, 3.0, 6.0, False), (1, 9, 0.0, 0.0, False),
            (2, 5, 1.0, 1.0, False), (2, 7, None, 1.0, False), (2, 9, 2.0, 2.0, False),
        ]
        assert len(self.filled(spark, rows, 5)) == 8 + 5
        assert self.filled(spark, [(1, 1, 0.0, 0.0, "z"), (1, None, 0.0, 0.0, "z")], 5, POSITIONS + ", extra string") == [(1, 1, 0.0, 0.0, False)]
        assert self.filled(spark, [], 5) == []

    def test_wrong_arguments(self, spark):
        for rows, columns, longest in (([(1, 2)], "id long, frame long", 3), ([(1, 0, 0.0, 0.0)], POSITIONS, -1)):
            with pytest.raises(Exception, match="fill_gaps"):
                self.filled(spark, rows, longest, columns)


AREA = AxisAlignedMeasurementArea(0, 0, 6, 4)
GRID = {"axis_aligned_measurement_area": AREA, "grid_size": 1.0}


class TestBells:
    def rows(self):
        rng = np.random.default_rng(4)
        return [(i, f, float(x), float(y), float(v)) for f in range(4) for i, (x, y, v) in enumerate(rng.uniform(0, 6, (25, 3)))] + [(99, 1, 300.0, 2.0, 1.0), (98, 5, 300.0, 2.0, 1.0)]

    @pytest.mark.parametrize("width", [0.3, 2.0])
    def test_against_all_pairs(self, spark, width):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # frames over several batches
        df = spark.createDataFrame(self.rows(), POSITIONS + ", speed double")
        density = {(r.frame, r.row, r.col): r.value for r in profiles.density_profile(df, DensityMethod.GAUSSIAN, gaussian_width=width, **GRID).collect()}
        speed = {(r.frame, r.row, r.col): r.value for r in profiles.speed_profile(df, SpeedMethod.GAUSSIAN, gaussian_width=width, **GRID).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(density) == len(speed) == 5 * 24
        s, t = width / profiles.FWHM_PER_SIGMA, width / (2 * np.sqrt(2 * np.log(2)))
        for frame, row, col in density:
            own = np.array([r[2:] for r in self.rows() if r[1] == frame])
            square = (own[:, 0] - col - 0.5) ** 2 + (own[:, 1] - 3.5 + row) ** 2
            assert density[frame, row, col] == pytest.approx((np.exp(-square / (2 * s * s)) / (profiles.ROOT_TWO_PI * s) ** 2).sum(), rel=1e-9, abs=1e-290)
            weights = np.exp(-square / (2 * t * t))
            if weights.sum() > 0:
                assert speed[frame, row, col] == pytest.approx((weights * own[:, 2]).sum() / weights.sum(), rel=1e-9)
            else:
                assert np.isnan(speed[frame, row, col])

    def test_no_row_for_each_pair(self, spark):
        df = spark.createDataFrame(self.rows(), POSITIONS + ", speed double")
        plan = profiles.density_profile(df, DensityMethod.GAUSSIAN, gaussian_width=1.0, **GRID)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan


class TestKeptIntersections:
    def test_joined_as_it_lies(self, spark):
        square = lambda x, y: [[{"x": x + a, "y": y + b} for a, b in ((0.0, 0.0), (0.9, 0.0), (0.9, 0.9), (0.0, 0.9))]]
        rows = [(i, f, 1.0 + i, square(0.5 * i, 0.3 * i)) for f in range(5) for i in range(8)]
        data = spark.createDataFrame(rows, "id long, frame long, speed double, polygon array<array<struct<x:double,y:double>>>")
        kept = profiles.keep_intersections(data, profiles.grid_cells(**GRID), buckets=4)
        rounded = lambda df: sorted((r.frame, r.row, r.col, round(r.value, 9)) for r in df.collect())
        assert rounded(profiles.density_profile(data, DensityMethod.VORONOI, grid_intersections_area=kept, **GRID)) == rounded(profiles.density_profile(data, DensityMethod.VORONOI, **GRID))
        assert rounded(profiles.speed_profile(data, SpeedMethod.VORONOI, grid_intersections_area=kept, **GRID)) == rounded(profiles.speed_profile(data, SpeedMethod.VORONOI, **GRID))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        joined = kept.join(data.select("id", "frame", "speed"), ["id", "frame"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
