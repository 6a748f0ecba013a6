"""What keeps the cost of cells, their readers and live crossings near that of the positions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridewise import streaming
from stridewise.geometry import exprs, kernel
from stridewise.model import MeasurementArea, TrajectoryData
from stridewise.operators import voronoi
from stridewise.plans import registry
from stridewise.plans import view as v
from stridewise.streaming import crossings

SMALL = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_few_steps_cut_cells_that_reach_far(monkeypatch):
    # a dense crowd at one end of a long box: outer cells reach over all of it, and few bisectors cut them
    rng = np.random.default_rng(5)
    x, y = rng.uniform(0, 4, 400), rng.uniform(0, 4, 400)
    calls, clip = [], kernel.clip_many
    monkeypatch.setattr(kernel, "clip_many", lambda *a: calls.append(1) or clip(*a))
    px, py, count = kernel.voronoi(x, y, (0.0, 0.0, 200.0, 4.0))
    assert len(calls) < 100
    assert kernel.areas(px, py, count).sum() == pytest.approx(800)


def test_corners_tell_most_contacts(monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.uniform(0, 9, 300), rng.uniform(0, 9, 300)
    pairs: list = []
    cells = kernel.voronoi(x, y, (0.0, 0.0, 9.0, 9.0), None, pairs)
    compared, nearest = [], kernel._nearest
    monkeypatch.setattr(kernel, "_nearest", lambda e, f: compared.append(len(e)) or nearest(e, f))
    own, _ = kernel.touching_padded(*cells, 1e-9, pairs[0])
    edges = kernel.padded_edges(*cells)
    every = np.minimum(nearest(edges[pairs[0][0]], edges[pairs[0][1]]), nearest(edges[pairs[0][1]], edges[pairs[0][0]])) <= 1e-18
    assert len(own) == every.sum() > 800 and sum(compared) < 100


@pytest.mark.parametrize("name", ["density_profile_voronoi", "speed_profile_voronoi", "speed_profile_arithmetic"])
def test_profiles_join_no_cells(spark, name):
    found = plan(registry.queries()[name](spark, SMALL))
    assert "Join" in found and "Join" not in found[: found.index("MapInArrow")]


def test_distances_come_with_the_neighbors(spark):
    near = voronoi.neighbors(v.cells(spark, SMALL, with_neighbors=True), as_list=False)
    joined = voronoi.neighbor_distance(v.trajectory(spark, SMALL), near)
    found = registry.queries()["neighbor_distance"](spark, SMALL)
    assert "Join" not in plan(found)
    rounded = joined.withColumn("distance", F.round("distance", 6) + 0.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rounded.collect()))


def test_roles_compute_the_cells_of_one_frame(spark, monkeypatch):
    seen, cells = [], voronoi.individual_voronoi_polygons
    monkeypatch.setattr(voronoi, "individual_voronoi_polygons", lambda track, *a, **k: seen.append(track) or cells(track, *a, **k))
    assert registry.queries()["neighborhood_roles"](spark, SMALL).count() > 0
    assert seen[0].data.select("frame").distinct().count() == 1


def test_cells_beyond_an_edge_are_not_clipped(spark):
    area = MeasurementArea([(0, 0), (1, 0), (1, 1), (0, 1)])
    square = lambda x, y: [[(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]]
    cells = spark.createDataFrame([(0, square(0.5, 0.5)), (1, square(3.0, 0.0)), (2, square(-2.0, 5.0)), (3, square(1.0, 0.0))], f"id long, polygon {exprs.PIECES}")
    found = cells.select("id", exprs.clip_pieces(F.col("polygon"), area).alias("part")).select("id", exprs.area(F.col("part")).alias("area"))
    assert "forall" in plan(found).lower()
    assert sorted(map(tuple, found.collect())) == [(0, 0.25), (1, 0.0), (2, 0.0), (3, 0.0)]


@pytest.mark.parametrize("name", ["guards", "line_validation"])
def test_checks_read_the_species_that_were_written(spark, monkeypatch, name):
    read, valid = [], registry.line.is_species_valid
    monkeypatch.setattr(registry.line, "is_species_valid", lambda kinds, *a: read.append(kinds) or valid(kinds, *a))
    registry.queries()[name](spark, SMALL).collect()
    assert len(read) == 2 and not any("Window" in plan(kinds) for kinds in read)


class Handle:
    """A pedestrian's state and timers; counts the calls."""

    def __init__(self):
        self.state, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.state is not None

    def get(self):
        self.calls += 1
        return self.state

    def update(self, value):
        self.calls += 1
        self.state = value

    def clear(self):
        self.state = None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


class At:
    def __init__(self, at, watermark):
        self.at, self.watermark = at, watermark

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_live_crossings_ask_little_of_the_state():
    handle = Handle()
    processor = crossings._Crossings((0.0, 0.0, 0.0, 4.0), 10.0, False, 50)
    processor.init(handle)
    rows = lambda frames, x: pd.DataFrame({"frame": frames, "x": x, "y": [1.0] * len(frames), "off": [True] * len(frames)})
    assert not list(processor.handleInputRows((7,), iter([rows([2, 1], [-0.6, -0.9])]), At(0, 0)))
    assert not list(processor.handleInputRows((7,), iter([rows([4, 3, 3], [0.3, -0.3, 9.0]), rows([2], [5.0])]), At(0, 0)))
    (found,) = processor.handleInputRows((7,), iter([rows([5], [0.6])]), At(0, 0))
    assert found.values.tolist() == [[7, 4]]
    # a timer, and three times a state read and written
    assert handle.calls == 7
    (at,) = handle.timers
    assert not list(processor.handleExpiredTimer((7,), At(at, at), At(at, at))) and handle.state is not None
    later = crossings._millis(55, 10.0)
    assert later in handle.timers
    assert not list(processor.handleExpiredTimer((7,), At(later, later), At(later, later))) and handle.state is None


def test_a_replay_computes_its_positions_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    track = v.trajectory(spark, SMALL).data
    n = track.count()
    streaming.replay(TrajectoryData(track.mapInArrow(count, track.schema), v.FRAME_RATE))
    assert counted.value == n
