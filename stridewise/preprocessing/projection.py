"""Moving positions back into the walkable area.

Each position is moved by itself: it is held against the edges of obstacles
and walls in a fixed order, with all edges as constants of the task.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.errors import ArgumentValueError
from stridewise.geometry.shapes import Polygon
from stridewise.model import TrajectoryData, WalkableArea, check_trajectory
from stridewise.operators.validity import is_trajectory_valid
from stridewise.shipping import ship

#: A foot point nearer to a corner than the first moves away from it by the second. Fixed values, metres.
CORNER_DISTANCE, CORNER_SHIFT = 0.05, 0.01
#: A position nearer to its foot point counts as on the edge.
ON_EDGE = 1e-5


@dataclass(frozen=True)
class Band:
    """Distances from an edge: where moving starts behind it, the least and the largest distance in front."""

    back: float
    least: float
    most: float

    def push(self, d: np.ndarray) -> np.ndarray:
        """[back, most] onto [least, most]."""
        return (d - self.back) * ((self.most - self.least) / (self.most - self.back)) + self.least

    def ease(self, d: np.ndarray) -> np.ndarray:
        """[back, least] onto [back, most]."""
        return (d - self.back) * ((self.most - self.back) / (self.least - self.back)) + self.back


def check_distances(wall: Band, obstacle: Band) -> None:
    for name, band in (("wall", wall), ("obst", obstacle)):
        if band.back >= 0:
            raise ArgumentValueError(f"back_distance_{name} must be negative")
        if band.least <= 0 or band.most <= 0:
            raise ArgumentValueError(f"min_distance_{name} and max_distance_{name} must be positive")
        if band.least > band.most:
            raise ArgumentValueError(f"min_distance_{name} must not be over max_distance_{name}")


def _foot(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = b - a
    t = np.clip((p - a) @ v / max(v @ v, 1e-300), 0, 1)
    return a + t[:, None] * v


def _within(p: np.ndarray, polygon: Polygon) -> np.ndarray:
    """Strictly inside, holes included in the outline's inside if the polygon has none."""
    inside, on = np.zeros(len(p), bool), np.zeros(len(p), bool)
    x, y = p.T
    for (ax, ay), (bx, by) in polygon.edges:
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        on |= (np.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1e-12) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
    return inside & ~on


def _signed(p: np.ndarray, edge, body: Polygon, solid: bool) -> np.ndarray:
    """Distance from an edge, negative where nobody can be: inside a solid body, outside an enclosing one."""
    d = np.linalg.norm(p - _foot(p, *edge), axis=1)
    return np.where(_within(p, body) == solid, -d, d)


def _beside(p: np.ndarray, a: np.ndarray, b: np.ndarray, slack: float = 0.0) -> np.ndarray:
    """Within the circle over the edge, widened by a slack of squared lengths."""
    return ((a - b) ** 2).sum() + slack > ((p - a) ** 2).sum(axis=1) + ((p - b) ** 2).sum(axis=1)


def _near_ends(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.abs(b - a).sum()
    return (size >= np.abs(p - a).sum(axis=1)) & (size >= np.abs(p - b).sum(axis=1))


def _moved(p: np.ndarray, a: np.ndarray, b: np.ndarray, target: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Points put at a target distance from their foot on the edge."""
    base = _foot(p, a, b)
    for corner, other in ((a, b), (b, a)):
        close = np.linalg.norm(base - corner, axis=1) < CORNER_DISTANCE
        away = other - base
        size = np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        base = np.where(close[:, None], base + away / size * CORNER_SHIFT, base)
    v = base - p
    flat = np.linalg.norm(v, axis=1) < ON_EDGE
    along = a - b
    v = np.where(flat[:, None], np.array([-along[1], along[0]]), v)
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * target[:, None]
    sign = np.where(now != 0, -np.sign(now), 1.0)
    return base + v * sign[:, None]


def _fold(p: np.ndarray, edges, body: Polygon, solid: bool, chosen, target) -> np.ndarray:
    """Edge after edge: points that ``chosen`` picks go to ``target`` of their distance."""
    for a, b in edges:
        d = _signed(p, (a, b), body, solid)
        hit = chosen(p, a, b, d)
        if hit.any():
            p[hit] = _moved(p[hit], a, b, target(d[hit]), d[hit])
    return p


def _faces_origin(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the origin lies to the right of the edge, or on its line."""
    v = b - a
    return v[0] * -a[1] - v[1] * -a[0] <= 0


def project(p: np.ndarray, polygon: Polygon, wall: Band, obstacle: Band) -> np.ndarray:
    """Positions moved out of obstacles and back inside the outline."""
    p = p.copy()
    pairs = lambda ring: [(np.array(s), np.array(e)) for s, e in zip(ring, [*ring[1:], ring[0]], strict=True)]
    in_band = lambda band: lambda q, a, b, d: (d > band.back) & (d <= band.most) & _beside(q, a, b)
    for hole in polygon.holes:
        body, facing = Polygon(hole), [e for e in pairs(hole) if _faces_origin(*e)]
        p = _fold(p, facing, body, True, lambda q, a, b, d: (d >= obstacle.back) & (d <= obstacle.least) & _beside(q, a, b, 4.0 * obstacle.most), obstacle.ease)
        p = _fold(p, facing, body, True, in_band(obstacle), obstacle.push)
    outline, edges = Polygon(polygon.outline), pairs(polygon.outline)
    p = _fold(p, edges, outline, False, in_band(wall), wall.push)
    # what is still inside an obstacle or outside the outline goes by looser rules
    for hole in polygon.holes:
        body = Polygon(hole)
        stuck = _within(p, body)
        if stuck.any():
            p[stuck] = _fold(p[stuck], pairs(hole), body, True, lambda q, a, b, d: (d > obstacle.back) & (d <= obstacle.most) & _near_ends(q, a, b), obstacle.push)
    return _fold(p, edges, outline, False, lambda q, a, b, d: (d > wall.back) & (d <= wall.most), wall.push)


def correct_invalid_trajectories(
    trajectory_data: TrajectoryData,
    walkable_area: WalkableArea,
    back_distance_wall: float = -1,
    min_distance_wall: float = 0.01,
    max_distance_wall: float = 0.05,
    back_distance_obst: float = -1,
    min_distance_obst: float = 0.01,
    max_distance_obst: float = 0.05,
) -> tuple[TrajectoryData, DataFrame]:
    """The trajectory with positions moved into the area, and (id) of pedestrians with two or more candidate rows.

    A valid trajectory comes back as it is, without ids. Candidates are rows
    that lie no further inside than the larger maximal distance.
    """
    check_trajectory(trajectory_data, "trajectory_data")
    wall, obstacle = Band(back_distance_wall, min_distance_wall, max_distance_wall), Band(back_distance_obst, min_distance_obst, max_distance_obst)
    check_distances(wall, obstacle)
    data = trajectory_data.data
    ship(data.sparkSession)
    if is_trajectory_valid(trajectory_data, walkable_area):
        return trajectory_data, data.select("id").limit(0)
    polygon, reach = walkable_area.polygon, max(wall.most, obstacle.most)
    schema = ", ".join(f"`{n}` {t}" for n, t in data.dtypes) + ", __candidate boolean"

    def run(batches):
        for rows in batches:
            p = rows[["x", "y"]].to_numpy(float)
            gap = np.full(len(p), np.inf)
            for a, b in polygon.edges:
                gap = np.minimum(gap, np.linalg.norm(p - _foot(p, np.array(a), np.array(b)), axis=1))
            candidate = ~(_within(p, polygon) & (gap > reach))
            if candidate.any():
                p = p.copy()
                p[candidate] = project(p[candidate], polygon, wall, obstacle)
            yield rows.assign(x=p[:, 0], y=p[:, 1], __candidate=candidate)

    moved = data.mapInPandas(run, schema)
    ids = moved.where("__candidate").groupBy("id").agg(F.count("*").alias("n")).where("n >= 2").select("id")
    corrected = TrajectoryData(moved.drop("__candidate"), trajectory_data.frame_rate)
    if not is_trajectory_valid(corrected, walkable_area):
        warnings.warn("the trajectory is still not valid; the distances may be too large", stacklevel=2)
    return corrected, ids


__all__ = ["Band", "check_distances", "correct_invalid_trajectories", "project"]
