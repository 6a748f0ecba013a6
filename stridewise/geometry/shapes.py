"""Polygons on the driver: parsing, predicates and convex decomposition.

These objects are small constants. They end as literals in Column expressions
or as arrays in batch kernels.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from stridewise.errors import GeometryError

Point = tuple[float, float]
EPS = 1e-12


def ring(points) -> tuple[Point, ...]:
    """Points of a ring without the closing one and without repeated neighbours."""
    out: list[Point] = []
    for p in points:
        p = (float(p[0]), float(p[1]))
        if not out or out[-1] != p:
            out.append(p)
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return tuple(out)


def signed_area(points) -> float:
    n = len(points)
    return sum(points[i][0] * points[(i + 1) % n][1] - points[(i + 1) % n][0] * points[i][1] for i in range(n)) / 2


def edges_of(points):
    return [(points[i], points[(i + 1) % len(points)]) for i in range(len(points))]


def cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def on_segment(p: Point, a: Point, b: Point) -> bool:
    return abs(cross(a, b, p)) <= EPS and min(a[0], b[0]) - EPS <= p[0] <= max(a[0], b[0]) + EPS and min(a[1], b[1]) - EPS <= p[1] <= max(a[1], b[1]) + EPS


def segment_distance(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = 0.0 if length == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / length))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def intersections(s, t) -> list[Point]:
    """Points where two segments meet; the ends of the overlap of collinear ones."""
    (a, b), (c, d) = s, t
    den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    if abs(den) < EPS:
        return [p for p in (c, d) if on_segment(p, a, b)] + [p for p in (a, b) if on_segment(p, c, d)]
    u = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
    v = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / den
    if -EPS <= u <= 1 + EPS and -EPS <= v <= 1 + EPS:
        return [(a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1]))]
    return []


@dataclass(frozen=True)
class Polygon:
    """An outline with holes."""

    outline: tuple[Point, ...]
    holes: tuple[tuple[Point, ...], ...] = ()

    @staticmethod
    def of(outline, holes=()) -> Polygon:
        return Polygon(ring(outline), tuple(ring(h) for h in holes))

    @cached_property
    def rings(self):
        return (self.outline, *self.holes)

    @cached_property
    def edges(self):
        return [e for r in self.rings for e in edges_of(r)]

    @property
    def area(self) -> float:
        return abs(signed_area(self.outline)) - sum(abs(signed_area(h)) for h in self.holes)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = [p[0] for p in self.outline], [p[1] for p in self.outline]
        return min(xs), min(ys), max(xs), max(ys)

    def on_boundary(self, p: Point) -> bool:
        return any(on_segment(p, a, b) for a, b in self.edges)

    def encloses(self, p: Point) -> bool:
        """Even-odd rule; points of the boundary may go either way."""
        inside = False
        for (ax, ay), (bx, by) in self.edges:
            if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
                inside = not inside
        return inside

    def within(self, p: Point) -> bool:
        """Strictly inside."""
        return not self.on_boundary(p) and self.encloses(p)

    def covers(self, other: Polygon) -> bool:
        """Whether every point of other's outline lies inside or on the boundary."""
        if any(not (self.on_boundary(p) or self.encloses(p)) for p in other.outline):
            return False
        for e in edges_of(other.outline):
            cuts = sorted({p for f in self.edges for p in intersections(e, f)} | {*e})
            for p, q in zip(cuts, cuts[1:], strict=False):
                middle = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
                if not (self.on_boundary(middle) or self.encloses(middle)):
                    return False
        return True

    @property
    def is_simple(self) -> bool:
        """Whether no two edges of the outline meet but at shared corners."""
        es = edges_of(self.outline)
        n = len(es)
        if n < 3 or abs(signed_area(self.outline)) < EPS:
            return False
        for i in range(n):
            for j in range(i + 1, n):
                found = intersections(es[i], es[j])
                if not found:
                    continue
                if j == i + 1 or (i == 0 and j == n - 1):
                    shared = es[i][1] if j == i + 1 else es[i][0]
                    if any(math.dist(p, shared) > 1e-9 for p in found):
                        return False
                else:
                    return False
        return True

    @property
    def is_convex(self) -> bool:
        n = len(self.outline)
        signs = {c > 0 for i in range(n) if abs(c := cross(self.outline[i], self.outline[(i + 1) % n], self.outline[(i + 2) % n])) > EPS}
        return len(signs) == 1 and not self.holes

    def normalized(self) -> Polygon:
        """Outline clockwise from its smallest corner, holes counter-clockwise from theirs, holes in falling order."""

        def turned(points, clockwise: bool):
            points = points[::-1] if (signed_area(points) < 0) != clockwise else points
            k = points.index(min(points))
            return points[k:] + points[:k]

        return Polygon(turned(self.outline, True), tuple(sorted((turned(h, False) for h in self.holes), reverse=True)))


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_wkt(text: str):
    """A nested structure of a WKT text: ('POINT'|'LINESTRING'|'POLYGON', points or rings), or (kind, parts)."""
    tokens = re.findall(rf"[A-Za-z]+|[(),]|{_NUMBER}", text)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else ""

    def take(expected=None):
        nonlocal at
        token = peek()
        if not token or (expected and token != expected):
            raise GeometryError(f"cannot parse WKT: {text[:80]!r}")
        at += 1
        return token

    def point():
        numbers = []
        while re.fullmatch(_NUMBER, peek() or " "):
            numbers.append(float(take()))
        if len(numbers) < 2:
            raise GeometryError(f"cannot parse WKT: {text[:80]!r}")
        return numbers[0], numbers[1]

    def many(item):
        take("(")
        out = [item()]
        while peek() == ",":
            take()
            out.append(item())
        take(")")
        return out

    def bare_point():
        if peek() == "(":
            return many(point)[0]
        return point()

    def geometry():
        kind = take().upper()
        while peek().upper() in ("Z", "M", "ZM"):
            take()
        if peek().upper() == "EMPTY":
            take()
            return kind, []
        if kind == "POINT":
            return kind, many(point)
        if kind == "LINESTRING":
            return kind, many(point)
        if kind == "MULTIPOINT":
            return kind, many(bare_point)
        if kind == "POLYGON":
            return kind, many(lambda: many(point))
        if kind == "MULTIPOLYGON":
            return kind, [("POLYGON", p) for p in many(lambda: many(lambda: many(point)))]
        if kind == "MULTILINESTRING":
            return kind, [("LINESTRING", p) for p in many(lambda: many(point))]
        if kind == "GEOMETRYCOLLECTION":
            return kind, many(geometry)
        raise GeometryError(f"cannot parse WKT: {text[:80]!r}")

    found = geometry()
    if at != len(tokens):
        raise GeometryError(f"cannot parse WKT: {text[:80]!r}")
    return found


def polygons_of_wkt(text: str) -> list[Polygon]:
    """All polygons of a WKT text."""

    def of(node):
        kind, parts = node
        if kind == "POLYGON":
            return [Polygon.of(parts[0], parts[1:])] if parts else []
        if kind in ("MULTIPOLYGON", "GEOMETRYCOLLECTION"):
            return [p for part in parts for p in of(part)]
        return []

    return of(parse_wkt(text))


def points_of_wkt(text: str) -> list[Point]:
    kind, parts = parse_wkt(text)
    if kind == "POLYGON":
        return parts[0]
    if kind in ("POINT", "LINESTRING", "MULTIPOINT"):
        return parts
    raise GeometryError(f"no line or outline in WKT: {text[:80]!r}")


def trapezoids(added: list[Polygon], removed: list[Polygon]) -> list[tuple[Point, ...]]:
    """Disjoint convex pieces of the union of ``added`` without ``removed``.

    Vertical slabs run through all corners and crossings; in a slab, what lies
    between two edges belongs to the region or not as a whole.
    """
    es = [e for p in (*added, *removed) for e in p.edges]
    xs = {p[0] for e in es for p in e}
    for i, e in enumerate(es):
        for f in es[i + 1 :]:
            xs |= {p[0] for p in intersections(e, f)}
    cuts = sorted(xs)
    merged = [x for i, x in enumerate(cuts) if i == 0 or x - cuts[i - 1] > 1e-10]
    out = []
    for left, right in zip(merged, merged[1:], strict=False):
        middle = (left + right) / 2
        spans = []
        for (ax, ay), (bx, by) in es:
            if min(ax, bx) <= middle <= max(ax, bx) and ax != bx:
                at = lambda x, ax=ax, ay=ay, bx=bx, by=by: ay + (by - ay) * (x - ax) / (bx - ax)
                spans.append((at(middle), at(left), at(right)))
        spans.sort()
        for low, high in zip(spans, spans[1:], strict=False):
            if high[0] - low[0] <= 1e-10:
                continue
            p = (middle, (low[0] + high[0]) / 2)
            if any(a.encloses(p) for a in added) and not any(r.encloses(p) for r in removed):
                out.append(ring([(left, low[1]), (right, low[2]), (right, high[2]), (left, high[1])]))
    return out


def convex_hull(points) -> tuple[Point, ...]:
    points = sorted({(float(x), float(y)) for x, y in points})
    if len(points) < 3:
        return tuple(points)

    def half(source):
        out: list[Point] = []
        for p in source:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return tuple(half(points) + half(points[::-1]))
