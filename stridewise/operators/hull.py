"""Convex hulls of groups of positions, as an aggregate that can be merged.

Each task keeps, for every group it meets, the hull of what it has seen; the
hulls' corners, not the positions, are shuffled, and the hull of hulls is that
of all. A group of any size so sends as many rows from each task as its hull
has corners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.shipping import partitions, ship

#: Corners that a task holds before it passes them on.
MOST_HELD = 1 << 20


def corners(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n, 2), counter-clockwise from the leftmost lowest; none on an edge or twice."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows) -> list:
        kept: list = []
        for p in rows:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(p)
        return kept

    rows = [tuple(p) for p in points.tolist()]
    return np.array(chain(rows)[:-1] + chain(rows[::-1])[:-1])


def _rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    keys = np.repeat(np.array(list(held), np.int64), [len(p) for p in held.values()])
    points = np.concatenate(list(held.values())) if held else np.zeros((0, 2))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(points[:, 0]), pa.array(points[:, 1])], names=["key", "x", "y"])


def _folded(batches):
    """(key, x, y) -> the corners of each key's hull, over all batches of a task unless those are too many."""
    held: dict[int, np.ndarray] = {}
    count = 0
    for batch in batches:
        keys, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(keys, kind="stable")
        points, keys = np.stack([x, y], axis=1)[order], keys[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else [0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = int(keys[a])
            before = held.get(key, np.zeros((0, 2)))
            held[key] = corners(np.concatenate([before, points[a:b]]))
            count += len(held[key]) - len(before)
        if count > MOST_HELD:
            yield _rows(held)
            held, count = {}, 0
    yield _rows(held)


def convex_hulls(data: DataFrame, by: str = "frame") -> DataFrame:
    """``by`` (a whole number), hull (corners, counter-clockwise), corners, area and perimeter of the positions (x, y) of each group.

    Positions without x, y or group are left out; infinite ones count as such.
    Of one or two places, the hull is a point or a line: area 0, and the
    perimeter goes there and back.
    """
    ship(data.sparkSession)
    name = f"`{by}`"
    rows = data.select(F.col(name).cast("long").alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("key is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    kind = "key long, x double, y double"
    part = rows.mapInArrow(_folded, kind)
    whole = part.repartition(partitions(part), "key").mapInArrow(_folded, kind)
    # a key whose corners a task has passed on in parts is folded once more
    lists = whole.groupBy("key").agg(F.collect_list(F.struct("x", "y")).alias("points"))
    made = lists.mapInArrow(_outlines, "key long, hull array<struct<x:double,y:double>>, corners int, area double, perimeter double")
    return made.withColumnRenamed("key", by)


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _outlines(batches):
    """(key, corners of its hull in any order) -> outline and measures."""
    for batch in batches:
        keys, out = batch.column(0), []
        for points in batch.column(1).to_pylist():
            hull = corners(np.array([(p["x"], p["y"]) for p in points]))
            following = np.roll(hull, -1, axis=0)
            area = abs(((hull[:, 0] - hull[0, 0]) * (following[:, 1] - hull[0, 1]) - (following[:, 0] - hull[0, 0]) * (hull[:, 1] - hull[0, 1])).sum()) / 2
            out.append(([{"x": a, "y": b} for a, b in hull.tolist()], len(hull), float(area), float(np.hypot(*(following - hull).T).sum())))
        hulls, counts, areas, around = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([keys, pa.array(hulls, pa.list_(_POINT)), pa.array(counts, pa.int32()), pa.array(areas, pa.float64()), pa.array(around, pa.float64())], names=["key", "hull", "corners", "area", "perimeter"])
