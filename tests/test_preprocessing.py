"""Repair and projection on small inputs."""

import numpy as np
import pytest

from stridewise.errors import ArgumentValueError
from stridewise.geometry.shapes import Polygon
from stridewise.model import MeasurementArea, MeasurementLine, TrajectoryData, WalkableArea
from stridewise.preprocessing import outliers, projection


def traj(spark, rows):
    return TrajectoryData(spark.createDataFrame(rows, "id long, frame long, x double, y double"), 1.0)


def straight(i, n=100, jumps=None):
    return [(i, f, 0.1 * f + (jumps or {}).get(f, 0.0), 0.0) for f in range(n)]


def test_parameters():
    for bad in ({"tolerance": 0.5}, {"quantile": 1.0}, {"percentage_invalid": 101}, {"max_length": 1}, {"critical_length_traj": 1}):
        with pytest.raises(ArgumentValueError):
            outliers.check_parameters(**({"tolerance": 3, "quantile": 0.9, "percentage_invalid": 20, "max_length": 8, "critical_length_traj": None} | bad))


def test_a_jump_is_interpolated(spark):
    t = traj(spark, straight(3) + straight(7, jumps={50: 5.0}))
    fixed, changes = outliers.detect_anomalies(t, quantile=0.9)
    assert [(r.original_id, r.new_id) for r in changes.collect()] == [(7, 2)]
    assert fixed.data.where("id = 2 and frame = 50").first().x == pytest.approx(5.1)
    assert fixed.number_pedestrians == 2 and fixed.data.count() == 200


def mended(spark, xs, spans, back_to_front=True):
    """x of a track after its spans are replaced; the step is 1."""
    track = [(f, float(x), 0.0) for f, x in enumerate(xs)]
    kind = "id long, track array<struct<frame:long,x:double,y:double>>, mended array<struct<lo:int,hi:int>>, n int, high int"
    one = spark.createDataFrame([(1, track, spans, len(xs), len(xs))], kind)
    return [p.x for p in outliers.mend(one, 1.0, back_to_front).first().track]


def test_inner_gaps_and_their_order(spark):
    xs = [0, 1, 9, 9, 9, 5, 6]
    assert mended(spark, xs, [(2, 5)])[2:5] == [5, 3, 1]
    assert mended(spark, xs, [(2, 5)], back_to_front=False)[2:5] == [1, 3, 5]


def test_ends_are_extrapolated(spark):
    # the mean direction of these steps points to smaller x
    assert mended(spark, [9, 9, 2, 3, 4, 5], [(0, 2)])[:2] == [0, 0]
    assert mended(spark, [0, 1, 2, 3, 90, 91, 92], [(4, 7)])[4:] == [3, 6, 6]


def brute(xs, typical, tolerance=3.0, max_length=8, critical=10):
    """Spans of wrong positions of one track, place by place, as documented."""
    jumps = [i for i in range(1, len(xs)) if abs(xs[i] - xs[i - 1]) > tolerance * typical]
    spans = []
    for j in jumps:
        if spans and spans[-1][1] >= j:
            continue
        if j == 1 and (len(jumps) % 2 == 1) != (jumps[-1] == len(xs) - 1):
            spans.append((0, 1))
            continue
        end = j + 1
        while end < len(xs) and abs(xs[end] - xs[j - 1]) > typical * 1.5 * (end - j + 1):
            end += 1
        if end - j > max_length and j > critical:
            return [*spans, (j, end)], True
        if end - j > max_length and j < critical:
            spans = [(1 if spans and spans[0] == (0, 1) else 0, j)]
        else:
            spans.append((j, end))
    return spans, False


def test_spans_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, tracks = [], {}
    for i in range(120):
        xs = np.cumsum(rng.uniform(0.05, 0.1, int(rng.integers(1, 60))))
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(xs)))
            xs[at : at + int(rng.choice([1, 2, 5, 9, 30]))] += rng.choice([-4.0, 3.0])
        tracks[i] = xs.tolist()
        rows.append((i, [(f, float(x), 0.0) for f, x in enumerate(xs)]))
    frame = spark.createDataFrame(rows, "id long, track array<struct<frame:long,x:double,y:double>>")
    found = outliers.with_spans(outliers.with_jumps(frame, 0.3), 0.1, 8, 10).collect()
    for r in found:
        assert ([(s.lo, s.hi) for s in r.spans], r.broken) == brute(tracks[r.id], 0.1), r.id
    assert any(r.broken for r in found) and any(len(r.spans) > 1 for r in found) and any(r.spans and r.spans[0].lo == 0 for r in found)


def test_displacements_only_crop(spark):
    late = traj(spark, straight(1, 400) + straight(2, 100, {f: 50.0 for f in range(88, 100)}))
    cropped, changes = outliers.detect_anomalies(late, quantile=0.9, displacements_only=True, critical_length_traj=20)
    assert cropped.data.where("id = 2").count() == 88 and [r.original_id for r in changes.collect()] == [2]
    single = traj(spark, straight(1, 400) + straight(2, 100, {50: 5.0}))
    same, changes = outliers.detect_anomalies(single, quantile=0.9, displacements_only=True)
    assert changes.count() == 0 and same.data.where("id = 2 and frame = 50").first().x == pytest.approx(10.0)


def test_beyond_repair(spark):
    jumps = {f: 40.0 * (f % 2) for f in range(20, 80)}
    t = traj(spark, straight(1, 400) + straight(2, 100, jumps))
    kept, changes = outliers.detect_anomalies(t, quantile=0.8)
    assert [(r.original_id, r.new_id) for r in changes.collect()] == [(2, 2)] and kept.data.count() == 500
    gone, changes = outliers.detect_anomalies(t, quantile=0.8, deleting=True)
    assert gone.number_pedestrians == 1


def test_displacement_is_cut(spark):
    t = traj(spark, straight(1, 400) + straight(2, 100, {f: 50.0 for f in range(88, 100)}))
    cut, _ = outliers.detect_anomalies(t, quantile=0.9)
    assert cut.data.where("id = 2").count() == 88


class TestProjection:
    WALL, OBSTACLE = projection.Band(-1, 0.01, 0.05), projection.Band(-1, 0.01, 0.05)

    def test_checks(self):
        for bad in (projection.Band(0, 0.01, 0.05), projection.Band(-1, 0, 0.05), projection.Band(-1, 0.06, 0.05)):
            with pytest.raises(ArgumentValueError):
                projection.check_distances(bad, self.OBSTACLE)

    def test_points_come_inside(self):
        room = Polygon.of([(0, 0), (4, 0), (4, 4), (0, 4)]).normalized()
        p = np.array([[-0.2, 2.0], [2.0, 4.1], [2.0, 2.0], [0.02, 2.0]])
        moved = projection.project(p, room, self.WALL, self.OBSTACLE)
        assert (moved > 0).all() and (moved < 4).all()
        assert moved[2].tolist() == [2, 2]
        push = lambda d: (d + 1) * 0.04 / 1.05 + 0.01
        assert moved[0, 0] == pytest.approx(push(push(-0.2)))  # once by the wall, once by the looser rules

    def test_valid_input_comes_back(self, spark):
        t = traj(spark, [(1, 0, 1.0, 1.0)])
        same, ids = projection.correct_invalid_trajectories(t, WalkableArea([(0, 0), (4, 0), (4, 4), (0, 4)]))
        assert same is t and ids.count() == 0

    def test_ids_need_two_rows(self, spark):
        t = traj(spark, [(1, 0, -0.1, 1.0), (2, 0, -0.1, 2.0), (2, 1, -0.2, 2.0), (3, 0, 2.0, 2.0)])
        fixed, ids = projection.correct_invalid_trajectories(t, WalkableArea([(0, 0), (4, 0), (4, 4), (0, 4)]))
        assert [r.id for r in ids.collect()] == [2] and fixed.data.where("x <= 0").count() == 0

    def test_obstacle(self, spark):
        area = WalkableArea([(-5, -5), (5, -5), (5, 5), (-5, 5)], [[(1, 1), (2, 1), (2, 2), (1, 2)]])
        t = traj(spark, [(1, 0, 1.05, 1.5), (1, 1, 0.97, 1.5)])
        fixed, _ = projection.correct_invalid_trajectories(t, area)
        assert fixed.data.where("x > 1 and x < 2 and y > 1 and y < 2").count() == 0


def test_sql_functions_and_streams(spark, tmp_path):
    from stridewise.functions import register_functions
    from stridewise.streaming import live_classic_density

    area = MeasurementArea([(0, 0), (2, 0), (2, 2), (0, 2)])
    register_functions(spark, {"room": area}, {"door": MeasurementLine([(0, 0), (0, 2)])})
    row = spark.sql("SELECT in_room(1D, 1D) AS a, in_room(2D, 1D) AS b, distance_to_door(3D, 1D) AS d").first()
    assert (row.a, row.b, row.d) == (True, False, 3.0)
    assert spark.sql("SELECT * FROM grid_cells(0D, 0D, 2D, 1.5D, 1D)").count() == 4
    kind = "id long, frame long, x double, y double"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, 0, 1.0, 1.0), (2, 0, 1.5, 1.0), (1, 100, 1.0, 1.0)])
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    query = live_classic_density(stream, area, 1.0).writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    put([(1, 101, 1.0, 1.0)])  # the next batch sees the watermark that frame 100 set
    query.processAllAvailable()
    query.stop()
    assert [(r.frame, r.density) for r in spark.table("live").collect()] == [(0, 0.5)]
