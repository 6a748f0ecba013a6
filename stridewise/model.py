"""Trajectories and the small constant geometries that operators take."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.errors import ArgumentTypeError, ArgumentValueError, GeometryError, ImmutableError
from stridewise.geometry import shapes
from stridewise.geometry.shapes import Polygon

REQUIRED = ("id", "frame", "x", "y")


@dataclass(frozen=True)
class TrajectoryData:
    """Positions (id, frame, x, y, ...) in metres as a lazy DataFrame, and frames per second.

    Row order means nothing: whatever needs an order takes that of the frames.
    """

    data: DataFrame
    frame_rate: float

    def __post_init__(self):
        missing = [c for c in REQUIRED if c not in self.data.columns]
        if missing:
            raise ArgumentValueError(f"trajectory data lacks the columns {missing}")
        typed = {"id": "long", "frame": "long", "x": "double", "y": "double"}
        object.__setattr__(self, "data", self.data.withColumns({c: F.col(c).cast(t) for c, t in typed.items() if dict(self.data.dtypes)[c] != {"long": "bigint"}.get(t, t)}))

    def __getitem__(self, key: slice) -> TrajectoryData:
        """Frames from start to before stop; both are held to the data's range, so an open stop leaves out the last frame."""
        if not isinstance(key, slice):
            raise ArgumentTypeError("only slices of frames can be taken")
        if key.step is not None:
            raise ArgumentValueError("a slice of frames has no step")
        span = self.data.agg(F.min("frame").alias("__low"), F.max("frame").alias("__high"))
        low = F.col("__low") if key.start is None else F.greatest(F.lit(key.start), F.col("__low"))
        high = F.col("__high") if key.stop is None else F.least(F.lit(key.stop), F.col("__high"))
        # one row: the range of the frames
        held = self.data.join(F.broadcast(span), how="cross").where((F.col("frame") >= low) & (F.col("frame") < high))
        return TrajectoryData(held.drop("__low", "__high"), self.frame_rate)

    def summary(self) -> DataFrame:
        """One row: bounds, number of pedestrians, frame range."""
        return self.data.agg(
            F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
            F.count_distinct("id").alias("number_pedestrians"), F.min("frame").alias("min_frame"), F.max("frame").alias("max_frame"),
        )

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return tuple(self.summary().first()[:4])

    @property
    def number_pedestrians(self) -> int:
        return self.summary().first()["number_pedestrians"]

    @property
    def frame_range(self) -> tuple[int, int]:
        row = self.data.agg(F.min("frame"), F.max("frame")).first()
        return row[0], row[1]

    def __repr__(self) -> str:
        return f"TrajectoryData(frame_rate={self.frame_rate}, columns={self.data.columns})"


def check_trajectory(value: object, name: str = "traj_data") -> None:
    if not isinstance(value, TrajectoryData):
        raise ArgumentTypeError(f"Expected '{name}' to be a TrajectoryData, got {type(value).__name__}")


def _polygons(value) -> list[Polygon]:
    if isinstance(value, Polygon):
        return [value]
    if isinstance(value, str):
        return shapes.polygons_of_wkt(value)
    value = list(value)
    if value and all(isinstance(v, Polygon) for v in value):
        return value
    return [Polygon.of(value)]


class _Frozen:
    """Attributes are set while the object is made and never after."""

    _done = False

    def __setattr__(self, name, value):
        if self._done:
            raise ImmutableError(f"{type(self).__name__} cannot be changed")
        object.__setattr__(self, name, value)

    def __delattr__(self, name):
        raise ImmutableError(f"{type(self).__name__} cannot be changed")


class WalkableArea(_Frozen):
    """Where pedestrians can be: an outline with holes, obstacles subtracted.

    Takes points, a Polygon, several polygons (their union) or WKT. Obstacles
    that lie inside become holes; others cut the area.
    """

    def __init__(self, polygon, obstacles=None):
        parts = _polygons(polygon)
        if not parts:
            raise GeometryError("a walkable area needs a polygon")
        for part in parts:
            if not Polygon(part.outline).is_simple:
                raise GeometryError("the outline of a walkable area must be simple and enclose an area")
        removed = [p for o in obstacles or [] for p in _polygons(o)]
        if len(parts) == 1:
            inside = [o for o in removed if Polygon(parts[0].outline).covers(o) and not any(parts[0].on_boundary(p) for p in o.outline)]
            parts = [Polygon(parts[0].outline, parts[0].holes + tuple(o.outline for o in inside)).normalized()]
            removed = [o for o in removed if o not in inside]
        for part in parts:
            if not all(Polygon(part.outline).covers(Polygon(h)) for h in part.holes):
                raise GeometryError("holes must lie inside the outline")
        self.parts: list[Polygon] = parts
        self.removed: list[Polygon] = removed
        single = len(parts) == 1 and not removed
        self.pieces: list[tuple] = [parts[0].outline] if single and parts[0].is_convex else shapes.trapezoids(parts, removed)
        if not self.pieces:
            raise GeometryError("the walkable area is empty")
        self.area: float = sum(abs(shapes.signed_area(p)) for p in self.pieces)
        self._done = True

    @property
    def polygon(self) -> Polygon:
        """The outline with holes of an area of one part."""
        if len(self.parts) > 1 or self.removed:
            raise GeometryError("the area has several parts")
        return self.parts[0]

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs = [p[0] for piece in self.pieces for p in piece]
        ys = [p[1] for piece in self.pieces for p in piece]
        return min(xs), min(ys), max(xs), max(ys)


class MeasurementArea(_Frozen):
    """A convex area without holes."""

    def __init__(self, polygon):
        parts = _polygons(polygon)
        if len(parts) != 1:
            raise GeometryError("a measurement area is one polygon")
        part = parts[0]
        if part.holes:
            raise GeometryError("a measurement area has no holes")
        if not part.is_simple:
            raise GeometryError("a measurement area must be simple and enclose an area")
        if not part.is_convex:
            raise GeometryError("a measurement area must be convex")
        self.polygon = part.normalized()
        self._finish()
        self._done = True

    def _finish(self) -> None:
        self.area = self.polygon.area
        self.bounds = self.polygon.bounds

    @property
    def outline(self):
        """Corners counter-clockwise."""
        points = self.polygon.outline
        return points if shapes.signed_area(points) > 0 else points[::-1]


class AxisAlignedMeasurementArea(MeasurementArea):
    """A rectangle along the axes."""

    def __init__(self, min_x: float, min_y: float, max_x: float, max_y: float):
        if not (min_x < max_x and min_y < max_y):
            raise GeometryError("a rectangle needs min_x < max_x and min_y < max_y")
        super().__init__([(min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y)])

    @staticmethod
    def from_measurement_area(area: MeasurementArea) -> AxisAlignedMeasurementArea:
        return AxisAlignedMeasurementArea(*area.bounds)


class MeasurementLine(_Frozen):
    """A straight line between two points; its normal points to the right of its direction."""

    def __init__(self, coordinates):
        points = shapes.points_of_wkt(coordinates) if isinstance(coordinates, str) else [(float(x), float(y)) for x, y in coordinates]
        if len(points) != 2:
            raise GeometryError("a measurement line has exactly two points")
        if points[0] == points[1]:
            raise GeometryError("a measurement line must have a length")
        self.coords = tuple(points)
        (ax, ay), (bx, by) = points
        self.length = math.sqrt((bx - ax) ** 2 + (by - ay) ** 2)
        self.normal_vector = ((by - ay) / self.length, (ax - bx) / self.length)
        self._done = True

    def offset(self, width: float) -> MeasurementLine:
        """The line moved by ``width`` to its left."""
        nx, ny = self.normal_vector
        return MeasurementLine([(x - width * nx, y - width * ny) for x, y in self.coords])


@dataclass(frozen=True, kw_only=True)
class Cutoff:
    """A regular polygon of 4 x quad_segments corners around a pedestrian that limits its cell."""

    radius: float
    quad_segments: int = 3
    corners: tuple = field(init=False, default=())

    def __post_init__(self):
        n = 4 * self.quad_segments
        object.__setattr__(self, "corners", tuple((self.radius * math.cos(2 * math.pi * k / n), self.radius * math.sin(2 * math.pi * k / n)) for k in range(n)))
