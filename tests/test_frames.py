"""Interval means, exact quantiles, pairs up to a cutoff, and live streams, each against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewise import streaming
from stridewise.errors import ArgumentValueError
from stridewise.model import MeasurementArea, MeasurementLine, TrajectoryData
from stridewise.operators import density, flow, intervals, movement, quantiles, spatial
from stridewise.streaming import crossings


class TestIntervalMeans:
    @pytest.mark.parametrize("block", [7, 4096])
    def test_against_plain_means(self, spark, monkeypatch, block):
        monkeypatch.setattr(intervals, "BLOCK", block)
        rng = random.Random(block)
        values = [(f, rng.uniform(-5, 5)) for f in range(-40, 90) if f % 9] + [(50, None), (51, 1e9), (51, 2.0), (12, None), (70, float("nan")), (80, float("inf")), (85, float("-inf")), (None, 3.0)]
        asked = [(k, rng.randint(-60, 100), rng.randint(-60, 100), "x") for k in range(120)] + [(200, None, 5, "x"), (201, 5, None, "x"), (202, 3, 3, "x"), (203, 3, 2, "x"), (204, 3, 3, "x")]
        rows = intervals.interval_means(spark.createDataFrame(values, "frame long, value double"), spark.createDataFrame(asked, "key int, a long, b long, mean string"), "value", "a", "b", "mean").collect()
        assert len(rows) == len(asked)
        for r in rows:
            own = [v for f, v in values if f is not None and v is not None and r.a is not None and r.b is not None and r.a <= f <= r.b]
            want = (sum(own) / len(own)) if own else None
            if want is None or math.isnan(want) or math.isinf(want):
                assert r.mean == want or (want is not None and math.isnan(want) and math.isnan(r.mean)), (r, want)
            else:
                assert r.mean == pytest.approx(want, rel=1e-9, abs=1e-6)  # beside the value 1e9

    def test_large_sums_keep_digits(self, spark, monkeypatch):
        monkeypatch.setattr(intervals, "BLOCK", 8)
        values = spark.range(200).select(F.col("id").alias("frame"), F.when(F.col("id") < 100, 1e12).otherwise(0.1).alias("value"))
        asked = spark.createDataFrame([(120, 180)], "a long, b long")
        assert intervals.interval_means(values, asked, "value", "a", "b", "m").first().m == pytest.approx(0.1, abs=1e-12)

    def test_work_does_not_grow_with_length(self, spark):
        frames = spark.range(1000).select(F.col("id").alias("frame"), F.lit(1.0).alias("density"))
        stays = spark.createDataFrame([(1, 0, 1000000000000)], "id long, entering_frame long, leaving_frame long")
        found = density.passing_density(frames, stays)
        assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.first().density == 1.0

    def test_empty(self, spark):
        none = spark.createDataFrame([], "frame long, value double")
        asked = spark.createDataFrame([(1, 2)], "a long, b long")
        assert intervals.interval_means(none, asked, "value", "a", "b", "m").first().m is None
        assert intervals.interval_means(none, asked.limit(0), "value", "a", "b", "m").count() == 0


class TestQuantiles:
    @pytest.mark.parametrize("kind", ["uniform", "wide", "ties", "signs", "tiny"])
    def test_against_sorted_values(self, spark, monkeypatch, kind):
        monkeypatch.setattr(quantiles, "FEW", 3)
        monkeypatch.setattr(quantiles, "PARTS", 8)
        rng = np.random.default_rng(len(kind))
        values = {
            "uniform": rng.random(500), "wide": 10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300), "ties": rng.integers(0, 3, 400).astype(float),
            "signs": np.concatenate([rng.standard_normal(300), np.zeros(100), [np.inf, -np.inf, 5e-324, -5e-324, 1.7e308, -1.7e308]]), "tiny": 1 + np.arange(200) * 2.0**-52,
        }[kind]
        shares = [0.0, 0.2, 0.5, 0.77, 0.99, 1.0]
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
        ordered = np.sort(values)
        for share, got in zip(shares, quantiles.quantiles(df, "v", shares), strict=True):
            p = share * (len(ordered) - 1)
            low, high = ordered[math.floor(p)], ordered[math.ceil(p)]
            want = low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high
            assert got == want, (share, got, want)

    def test_odd_columns(self, spark):
        df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
        assert quantiles.quantiles(df, "v", [0.5]) == [2.0]
        assert quantiles.quantiles(df.where("v is null"), "v", [0.5, 1.0]) == [None, None]
        nans = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
        low, high = quantiles.quantiles(nans, "v", [0.0, 1.0])
        assert low == 1.0 and math.isnan(high)


def crowd(spark, n=300, frames=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, int(f), float(np.round(x, 2)), float(np.round(y, 2))) for i in range(n) for f in rng.choice(frames, 2, replace=False) for x, y in [rng.uniform(-6, 6, 2)]]
    return rows + [(n + 1, 99, 0.0, 0.0), (n + 2, 98, 1.0, 1.0), (n + 3, 98, 1.0, 1.0)]


class TestPairs:
    def test_near_pairs_against_all(self, spark):
        rows = crowd(spark)
        data = TrajectoryData(spark.createDataFrame([*rows, (500, 1, None, 1.0)], "id long, frame long, x double, y double"), 1.0)
        for cutoff in (0.5, 1.7):
            got = {r.bin: r.n for r in spatial.pair_histogram(data, 0.5, cutoff).collect()}
            want: dict[int, int] = {}
            for a, b in itertools.combinations(rows, 2):
                d = math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)
                if a[1] == b[1] and a[0] != b[0] and d <= cutoff:
                    want[math.ceil(d / 0.5)] = want.get(math.ceil(d / 0.5), 0) + 1
            assert got == want

    def test_distribution_is_the_same_up_to_the_cutoff(self, spark):
        data = TrajectoryData(spark.createDataFrame(crowd(spark, 60), "id long, frame long, x double, y double"), 1.0)
        whole = {r.r: r.g for r in spatial.pair_distribution_function(data, 0.5).collect()}
        near = {r.r: r.g for r in spatial.pair_distribution_function(data, 0.5, cutoff=2.2).collect()}
        assert near == {r: g for r, g in whole.items() if r <= 2.0} and len(near) == 4
        assert {r.r: r.g for r in spatial.pair_distribution_function(data, 0.5, cutoff=100.0).collect()} == whole

    def test_joins_on_the_bin(self, spark):
        data = TrajectoryData(spark.createDataFrame(crowd(spark, 5), "id long, frame long, x double, y double"), 1.0)
        plan = spatial.pair_histogram(data, 0.5, 1.0)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        assert any("bin_x" in j and "bin_y" in j for j in joins)

    def test_wrong_cutoffs(self, spark):
        data = TrajectoryData(spark.createDataFrame(crowd(spark, 2), "id long, frame long, x double, y double"), 1.0)
        for wrong in (0, -1.0, float("inf")):
            with pytest.raises(ArgumentValueError):
                spatial.pair_histogram(data, 0.5, wrong)


AREA = MeasurementArea([(-1, 0), (1, 0), (1, 4), (-1, 4)])
LINE = MeasurementLine([(0, 0), (0, 4)])


def walkers(spark, rate=30.0):
    """Walkers with gaps, turns, pauses on the line and ends beside it."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(25):
        x = np.cumsum(rng.choice([-0.4, 0.0, 0.4, 0.4], 60)) - 3
        keep = rng.random(60) > (0.05 if i % 3 else 0)
        rows += [(i, int(f) + 3 * i, float(np.round(a, 3)), 1.0 + i % 3) for f, (a, k) in enumerate(zip(x, keep, strict=True)) if k]
    return TrajectoryData(spark.createDataFrame(rows, "id long, frame long, x double, y double"), rate)


class TestLive:
    @pytest.fixture
    def track(self, spark):
        return walkers(spark)

    def shuffled(self, spark, track, tmp_path, window=10):
        """A stream whose rows come up to ``window`` frames out of order, in many small triggers."""
        rows = sorted(track.data.collect(), key=lambda r: r.frame)
        rng = random.Random(4)
        order = sorted(rows, key=lambda r: r.frame + rng.uniform(0, window))
        path = f"{tmp_path}/rows"
        step = len(order) // 5
        for k in range(0, len(order), step):
            part = [tuple(r) for r in order[k : k + step]]
            spark.createDataFrame(part + part[:3], "id long, frame long, x double, y double").coalesce(1).write.mode("append").parquet(path)
        spark.createDataFrame([(None, 10**6, None, None)], "id long, frame long, x double, y double").coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(track.data.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def test_replayed_crossings_equal_the_batch(self, spark, track, tmp_path):
        got = streaming.drained(streaming.live_crossings(self.shuffled(spark, track, tmp_path), LINE, 30.0)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, flow.crossing_frames(track, LINE).collect())) and len(got) > 20

    def test_first_crossings_and_curve(self, spark, track, tmp_path):
        curve, first = flow.n_t(track, LINE)
        got = streaming.drained(streaming.live_first_crossings(self.shuffled(spark, track, tmp_path), LINE, 30.0)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, first.collect()))
        rows = streaming.drained(streaming.live_n_t(streaming.replay(track, 2), LINE, 30.0)).collect()
        frames = [r.frame for r in got]
        want = [tuple(r) for r in curve.where(F.col("frame").between(min(frames), max(frames))).collect()]
        assert sorted(map(tuple, rows)) == sorted(want)

    def test_stays_equal_the_batch(self, spark, track, tmp_path):
        # the closing row has no place in the area: the last stays end only if such rows move the watermark
        got = streaming.drained(streaming.live_stay_intervals(self.shuffled(spark, track, tmp_path), AREA, 30.0)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, movement.stay_intervals(track, AREA).collect())) and len(got) > 20

    def test_a_pedestrian_that_is_away_is_forgotten(self):
        class Handle:
            def __init__(self):
                self.state, self.timers = None, set()

            def getValueState(self, name, schema):  # noqa: N802
                return self

            exists = lambda self: self.state is not None
            get = lambda self: self.state
            update = lambda self, value: setattr(self, "state", value)
            clear = lambda self: setattr(self, "state", None)
            registerTimer = lambda self, at: self.timers.add(at)
            deleteTimer = lambda self, at: self.timers.discard(at)

        class At:
            def __init__(self, at):
                self.at = at

            getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: self.at

        import pandas as pd

        handle = Handle()
        processor = crossings._Crossings((0.0, 0.0, 0.0, 4.0), 10.0, True, 50)
        processor.init(handle)
        rows = pd.DataFrame({"frame": [1, 2, 3], "x": [-0.3, 0.3, 0.9], "y": [1.0] * 3, "off": [True] * 3})
        assert not sum(map(len, processor.handleInputRows((7,), iter([rows]), At(0))))
        first, away = sorted(handle.timers)
        assert away == crossings._millis(53, 10.0) and handle.state[4] == 2
        (told,) = processor.handleExpiredTimer((7,), At(first), At(first))
        assert told.values.tolist() == [[7, 2]] and handle.exists()
        assert not list(processor.handleExpiredTimer((7,), At(away), At(away))) and not handle.exists()
