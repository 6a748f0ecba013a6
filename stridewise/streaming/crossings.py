"""Crossings of a line and N-t curves of live streams of positions.

A crossing in a frame is known as soon as the frames before and after it are
there, in whatever order they arrive. Which crossing of a pedestrian is the
first is known when the watermark has passed it. Each pedestrian has one small
state: positions that rows still to come can be next to, and the first
crossing so far; a timer drops it when the pedestrian has been away for long.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from stridewise.geometry import exprs
from stridewise.model import MeasurementLine
from stridewise.operators.flow import ON_LINE
from stridewise.streaming.live import ORIGIN, timed

#: What Spark keeps such states in.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for the id of rows that are no positions.
MISSING = -(1 << 63)
_HELD = "frames array<bigint>, xs array<double>, ys array<double>, offs array<boolean>, first bigint, told boolean, seen bigint"

# Spark also asks a processor for its states in a process beside the driver, which has none of the shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_state_store(spark: SparkSession) -> None:
    """These states need Spark's store on local disks with snapshots in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _side(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def steps_meet(x0, y0, x1, y1, line: tuple[float, float, float, float]) -> np.ndarray:
    """Whether the closed steps (x0, y0)-(x1, y1) meet the line; the same rule as that of the batch operator."""
    cx, cy, dx, dy = line
    s1, s2 = _side(cx, cy, dx, dy, x0, y0), _side(cx, cy, dx, dy, x1, y1)
    s3, s4 = _side(x0, y0, x1, y1, cx, cy), _side(x0, y0, x1, y1, dx, dy)

    def on(side, ax, ay, bx, by, px, py):
        return (side == 0) & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))

    touch = on(s1, cx, cy, dx, dy, x0, y0) | on(s2, cx, cy, dx, dy, x1, y1) | on(s3, x0, y0, x1, y1, cx, cy) | on(s4, x0, y0, x1, y1, dx, dy)
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | touch


def _millis(frame: int, frame_rate: float) -> int:
    """Event time of a frame, rounded up."""
    return -(-(ORIGIN + int(frame * 1_000_000.0 / frame_rate)) // 1000)


class _Crossings(StatefulProcessor):
    """Emits (id, frame): every crossing at once, or each pedestrian's first one when none before it can come any more."""

    def __init__(self, line: tuple[float, float, float, float], frame_rate: float, first_only: bool, away_frames: int):
        self.line, self.frame_rate, self.first_only, self.away_frames = line, frame_rate, first_only, away_frames

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # arrays: a table's own operations cost more than all the rest of a pedestrian's few rows
        parts = [[t[c].to_numpy(k) for c, k in (("frame", np.int64), ("x", float), ("y", float), ("off", bool))] for t in rows]
        if key[0] == MISSING:
            return
        frames, x, y, off = (np.concatenate(c) for c in zip(*parts, strict=True))
        placed = ~(np.isnan(x) | np.isnan(y))
        if not placed.any():
            return
        had = self.held.get()
        old_frames, xs, ys, offs, first, told, seen = had or ([], [], [], [], None, False, -1)
        frames, x, y, off = (np.concatenate([np.array(o, v.dtype), v[placed]]) for o, v in ((old_frames, frames), (xs, x), (ys, y), (offs, off)))
        # of rows of one frame the first counts, and what is held comes before what is new
        order = np.unique(frames, return_index=True)[1]
        frames, x, y, off, fresh = frames[order], x[order], y[order], off[order], order >= len(old_frames)
        # three frames in a row, of which at least one has just come: the middle one is judged now and never again
        whole = (frames[1:-1] - frames[:-2] == 1) & (frames[2:] - frames[1:-1] == 1) & (fresh[:-2] | fresh[1:-1] | fresh[2:])
        met = whole & off[1:-1] & steps_meet(x[:-2], y[:-2], x[1:-1], y[1:-1], self.line)
        found = frames[1:-1][met]
        if self.first_only and len(found) and not told and (first is None or found[0] < first):
            if first is not None:
                self.handle.deleteTimer(_millis(first + 1, self.frame_rate))
            first = int(found[0])
            self.handle.registerTimer(_millis(first + 1, self.frame_rate))
        newest = int(max(seen, frames[-1])) if len(frames) else seen
        # one timer for each state: it puts itself off while the pedestrian is there
        if had is None:
            self.handle.registerTimer(_millis(newest + self.away_frames, self.frame_rate))
        # rows behind the watermark are dropped before they come here: older ones have no neighbour to wait for
        closed = timerValues.getCurrentWatermarkInMs()
        open_ = -(-(ORIGIN + ((frames + 2) * 1_000_000.0 / self.frame_rate).astype(np.int64)) // 1000) >= closed
        self.held.update((frames[open_].tolist(), x[open_].tolist(), y[open_].tolist(), off[open_].tolist(), first, told, newest))
        if not self.first_only and len(found):
            yield pd.DataFrame({"id": [int(key[0])] * len(found), "frame": found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self.held.get()
        if had is None:
            return
        *rest, first, told, seen = had
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.first_only and first is not None and not told and at >= _millis(first + 1, self.frame_rate):
            told = True
            self.held.update((*rest, first, told, seen))
            yield pd.DataFrame({"id": [int(key[0])], "frame": [first]})
        away = _millis(seen + self.away_frames, self.frame_rate)
        if timerValues.getCurrentWatermarkInMs() >= away:
            self.held.clear()
        else:
            self.handle.registerTimer(away)


def _crossings(positions: DataFrame, line: MeasurementLine, frame_rate: float, lateness: str, count_on_line: bool, first_only: bool, away_frames: int) -> DataFrame:
    spark = positions.sparkSession
    use_state_store(spark)
    off = F.lit(True) if count_on_line else F.coalesce(exprs.point_segment_distance(F.col("x"), F.col("y"), line) >= ON_LINE, F.lit(False))
    # rows without id or place move the watermark; a filter here would be moved before it
    rows = timed(positions.select("id", "frame", "x", "y"), frame_rate, lateness)
    # nulls among whole numbers would come to pandas as rounded ones
    rows = rows.withColumn("id", F.when(F.col("frame").isNull(), MISSING).otherwise(F.coalesce("id", F.lit(MISSING)))).withColumn("frame", F.coalesce("frame", F.lit(MISSING)))
    processor = _Crossings(tuple(float(v) for p in line.coords for v in p), float(frame_rate), first_only, int(away_frames))
    return rows.withColumn("off", off).groupBy("id").transformWithStateInPandas(processor, "id long, frame long", "Append", "EventTime")


def live_crossings(positions: DataFrame, measurement_line: MeasurementLine, frame_rate: float, lateness: str = "2 seconds", count_on_line: bool = False, away_frames: int = 6000) -> DataFrame:
    """id, frame of each crossing, as soon as the frame after it is there; what ``crossing_frames`` gives for the whole.

    Rows that come later than ``lateness`` behind the newest frame are lost,
    and with them the crossings next to them. Rows without id, frame or place
    are no positions; a second row of a pedestrian and frame is ignored. A pedestrian that is away for ``away_frames`` is
    forgotten.
    """
    return _crossings(positions, measurement_line, frame_rate, lateness, count_on_line, False, away_frames)


def live_first_crossings(positions: DataFrame, measurement_line: MeasurementLine, frame_rate: float, lateness: str = "2 seconds", away_frames: int = 6000) -> DataFrame:
    """id, frame of each pedestrian's first crossing, once the watermark has passed the frame after it.

    So the newest ``lateness`` of a stream is still open when the stream ends.
    A pedestrian that comes back after ``away_frames`` counts as another one.
    """
    return _crossings(positions, measurement_line, frame_rate, lateness, False, True, away_frames)


class _Running(StatefulProcessor):
    """Emits (frame, cumulative_pedestrians) from first crossings, whose frames rise from batch to batch."""

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", "frame bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = pd.concat(list(rows), ignore_index=True).groupby("frame")["n"].sum().sort_index()
        last, n = self.total.get() if self.total.exists() else (int(counts.index[0]) - 1, 0)
        frames = np.arange(last + 1, int(counts.index[-1]) + 1)
        totals = n + counts.reindex(frames, fill_value=0).cumsum().to_numpy()
        self.total.update((int(frames[-1]), int(totals[-1])))
        yield pd.DataFrame({"frame": frames, "cumulative_pedestrians": totals.astype(np.int64)})


def live_n_t(positions: DataFrame, measurement_line: MeasurementLine, frame_rate: float, lateness: str = "2 seconds", away_frames: int = 6000) -> DataFrame:
    """frame, cumulative_pedestrians, time for every frame from the first crossing to the newest one that is closed.

    First crossings are dealt by pedestrian; only they, a row for each
    pedestrian that has crossed, meet in the one running total.
    """
    first = live_first_crossings(positions, measurement_line, frame_rate, lateness, away_frames)
    steps = first.select("frame", F.lit(1).cast("long").alias("n"), F.lit(0).alias("curve"))
    total = steps.groupBy("curve").transformWithStateInPandas(_Running(), "frame long, cumulative_pedestrians long", "Append", "None")
    return total.select("frame", "cumulative_pedestrians", (F.col("frame") / F.lit(float(frame_rate))).alias("time"))
