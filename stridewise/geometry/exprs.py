"""Geometry as Column expressions.

A convex polygon is an array of struct(x, y); the geometry of a cell is an
array of such polygons that do not overlap. Constant areas and lines become
literals, so predicates stay inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridewise.geometry.shapes import Polygon, edges_of
from stridewise.model import MeasurementArea, MeasurementLine, WalkableArea

#: Corners nearer to a line than this lie on it.
ON_LINE = 1e-9
PIECES = "array<array<struct<x:double,y:double>>>"


def lit(value: float) -> Column:
    return F.lit(float(value))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_convex(x: Column, y: Column, area: MeasurementArea) -> Column:
    """Strictly inside a convex area: to the left of every edge."""
    inside = F.lit(True)
    for (ax, ay), (bx, by) in edges_of(area.outline):
        inside = inside & (lit(bx - ax) * (y - lit(ay)) - lit(by - ay) * (x - lit(ax)) > 0)
    return inside


def _crossings(x: Column, y: Column, polygon: Polygon) -> Column:
    total = F.lit(0)
    for (ax, ay), (bx, by) in polygon.edges:
        if ay == by:
            continue
        between = (lit(ay) > y) != (lit(by) > y)
        total = total + F.when(between & (x < lit((bx - ax) / (by - ay)) * (y - lit(ay)) + lit(ax)), 1).otherwise(0)
    return total % 2 == 1


def _on_boundary(x: Column, y: Column, polygon: Polygon) -> Column:
    found = F.lit(False)
    for (ax, ay), (bx, by) in polygon.edges:
        straight = F.abs(lit(bx - ax) * (y - lit(ay)) - lit(by - ay) * (x - lit(ax))) <= 1e-12
        found = found | (straight & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    return found


def within_walkable(x: Column, y: Column, area: WalkableArea) -> Column:
    """Strictly inside a walkable area; points of its boundary are outside."""
    inside = F.lit(False)
    for part in area.parts:
        inside = inside | (_crossings(x, y, part) & ~_on_boundary(x, y, part))
    for hole in area.removed:
        inside = inside & ~(_crossings(x, y, hole) | _on_boundary(x, y, hole))
    return inside


def point_segment_distance(x: Column, y: Column, line: MeasurementLine) -> Column:
    (ax, ay), (bx, by) = line.coords
    dx, dy = bx - ax, by - ay
    t = F.greatest(lit(0), F.least(lit(1), ((x - lit(ax)) * lit(dx) + (y - lit(ay)) * lit(dy)) / lit(dx * dx + dy * dy)))
    px, py = x - lit(ax) - t * lit(dx), y - lit(ay) - t * lit(dy)
    return F.sqrt(px * px + py * py)


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_meet(x0: Column, y0: Column, x1: Column, y1: Column, line: MeasurementLine) -> Column:
    """Whether the closed segment (x0, y0)-(x1, y1) meets the line; a still point counts as a segment."""
    cx, cy, dx, dy = (lit(v) for p in line.coords for v in p)
    s1, s2 = _side(cx, cy, dx, dy, x0, y0), _side(cx, cy, dx, dy, x1, y1)
    s3, s4 = _side(x0, y0, x1, y1, cx, cy), _side(x0, y0, x1, y1, dx, dy)
    proper = (s1 * s2 < 0) & (s3 * s4 < 0)

    def on(side: Column, ax, ay, bx, by, px, py) -> Column:
        return (side == 0) & (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx)) & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by))

    touch = on(s1, cx, cy, dx, dy, x0, y0) | on(s2, cx, cy, dx, dy, x1, y1) | on(s3, x0, y0, x1, y1, cx, cy) | on(s4, x0, y0, x1, y1, dx, dy)
    return proper | touch


def convex_area(polygon: Column) -> Column:
    """Shoelace area of a convex polygon."""

    def of(p: Column) -> Column:
        # relative to the first corner, which keeps digits for polygons far from the origin
        x0, y0 = F.get(p, F.lit(0))["x"], F.get(p, F.lit(0))["y"]
        terms = F.transform(
            p,
            lambda v, i: bound(F.coalesce(F.get(p, i + 1), F.get(p, F.lit(0))), lambda w: (v["x"] - x0) * (w["y"] - y0) - (w["x"] - x0) * (v["y"] - y0)),
        )
        return F.abs(F.aggregate(terms, lit(0), lambda a, b: a + b)) / 2

    return bound(polygon, of)


def area(pieces: Column) -> Column:
    """Area of a list of convex polygons that do not overlap."""
    return F.aggregate(F.transform(pieces, convex_area), lit(0), lambda a, b: a + b)


def half_planes(outline) -> Column:
    """Literal half-planes a x + b y <= c of a counter-clockwise convex outline."""
    out = []
    for (ax, ay), (bx, by) in edges_of(outline):
        a, b = by - ay, ax - bx
        out.append(F.struct(lit(a).alias("a"), lit(b).alias("b"), lit(a * ax + b * ay).alias("c")))
    return F.array(*out)


def clip(polygon: Column, planes: Column) -> Column:
    """A convex polygon cut by half-planes, one after another."""

    def cut(p: Column, h: Column) -> Column:
        def corner(v: Column, i: Column) -> Column:
            def with_next(w: Column) -> Column:
                d, e = h["a"] * v["x"] + h["b"] * v["y"] - h["c"], h["a"] * w["x"] + h["b"] * w["y"] - h["c"]

                def emit(s: Column) -> Column:
                    t = s["d"] / (s["d"] - s["e"])
                    meet = F.struct((v["x"] + t * (w["x"] - v["x"])).alias("x"), (v["y"] + t * (w["y"] - v["y"])).alias("y"))
                    none = F.array().cast("array<struct<x:double,y:double>>")
                    own = F.when(s["d"] <= 0, F.array(v)).otherwise(none)
                    return F.concat(own, F.when((s["d"] <= 0) != (s["e"] <= 0), F.array(meet)).otherwise(none))

                return bound(F.struct(d.alias("d"), e.alias("e")), emit)

            return bound(F.coalesce(F.get(p, i + 1), F.get(p, F.lit(0))), with_next)

        return F.flatten(F.transform(p, corner))

    return F.aggregate(planes, polygon, cut)


def clip_pieces(pieces: Column, measurement: MeasurementArea) -> Column:
    """The pieces' intersections with a convex area; those without an area are left out."""
    planes = half_planes(measurement.outline)
    reaches = lambda p: F.forall(planes, lambda h: F.exists(p, lambda w: h["a"] * w["x"] + h["b"] * w["y"] - h["c"] <= 0))
    # most cells lie beyond one of the area's edges, and nothing of them would be left
    return F.filter(F.transform(F.filter(pieces, reaches), lambda p: clip(p, planes)), lambda p: F.size(p) > 2)


def line_intervals(pieces: Column, line: MeasurementLine) -> Column:
    """Closed intervals of the line's parameter inside each piece, sorted; empty ones are left out.

    A corner nearer to the line than ON_LINE lies on it, so that rounding does
    not decide whether a cell that ends at the line meets it, and how far.
    """
    (ax, ay), (bx, by) = line.coords
    dx, dy = bx - ax, by - ay
    length = math.hypot(dx, dy)

    def off(v: Column) -> Column:
        return (v["x"] - lit(ax)) * lit(dy / length) - (v["y"] - lit(ay)) * lit(dx / length)

    def along(v: Column) -> Column:
        return (v["x"] - lit(ax)) * lit(dx / length**2) + (v["y"] - lit(ay)) * lit(dy / length**2)

    def mark(v: Column) -> Column:
        return bound(off(v), lambda s: F.struct(F.when(F.abs(s) <= lit(ON_LINE), lit(0)).otherwise(s).alias("s"), along(v).alias("t")))

    def of(marks: Column) -> Column:
        none = F.array().cast("array<double>")

        def places(m: Column, i: Column) -> Column:
            def with_next(w: Column) -> Column:
                passed = F.array(m["t"] + (w["t"] - m["t"]) * (m["s"] / (m["s"] - w["s"])))
                return F.when(m["s"] == 0, F.array(m["t"])).when(m["s"] * w["s"] < 0, passed).otherwise(none)

            return bound(F.coalesce(F.get(marks, i + 1), F.get(marks, F.lit(0))), with_next)

        interval = lambda ts: F.struct(F.greatest(lit(0), F.array_min(ts)).alias("s"), F.least(lit(1), F.array_max(ts)).alias("e"))
        return bound(F.flatten(F.transform(marks, places)), interval)

    # most cells lie on one side
    both = F.filter(pieces, lambda p: (F.size(p) > 2) & F.exists(p, lambda v: off(v) <= lit(ON_LINE)) & F.exists(p, lambda v: off(v) >= lit(-ON_LINE)))
    return F.sort_array(F.filter(F.transform(both, lambda p: bound(F.transform(p, mark), of)), lambda t: t["s"] <= t["e"]))


def meets_line(pieces: Column, line: MeasurementLine) -> Column:
    """Whether a cell and the line have a point in common."""
    return F.size(line_intervals(pieces, line)) > 0


def line_share(pieces: Column, line: MeasurementLine) -> Column:
    """Share of the line that lies inside a cell; what lies on a border of two pieces counts once."""
    start = F.struct(lit(0).alias("sum"), lit(-1).alias("end"))

    def add(acc: Column, t: Column) -> Column:
        own = F.greatest(lit(0), t["e"] - F.greatest(t["s"], acc["end"]))
        return F.struct((acc["sum"] + own).alias("sum"), F.greatest(acc["end"], t["e"]).alias("end"))

    return F.aggregate(line_intervals(pieces, line), start, add, lambda acc: acc["sum"])
