"""Makes the geometry kernel's expressions callable from SQL.

Areas and lines are constants, so each function is made for one geometry and
registered under a name of its own; in SQL it is an ordinary expression that
Catalyst inlines.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from stridewise.functions.gaps import fill_gaps
from stridewise.model import MeasurementArea, MeasurementLine
from stridewise.shipping import ship


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def inside_sql(area: MeasurementArea, x: str = "x", y: str = "y") -> str:
    """SQL text of: strictly inside a convex area."""
    points = area.outline
    terms = []
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        terms.append(f"({_number(bx - ax)} * ({y} - {_number(ay)}) - {_number(by - ay)} * ({x} - {_number(ax)}) > 0)")
    return " AND ".join(terms)


def distance_sql(line: MeasurementLine, x: str = "x", y: str = "y") -> str:
    """SQL text of: distance to a line."""
    (ax, ay), (bx, by) = line.coords
    dx, dy = bx - ax, by - ay
    t = f"greatest(0D, least(1D, (({x} - {_number(ax)}) * {_number(dx)} + ({y} - {_number(ay)}) * {_number(dy)}) / {_number(dx * dx + dy * dy)}))"
    px, py = f"({x} - {_number(ax)} - {t} * {_number(dx)})", f"({y} - {_number(ay)} - {t} * {_number(dy)})"
    return f"sqrt({px} * {px} + {py} * {py})"


@udtf(returnType="row int, col int, x0 double, y0 double, x1 double, y1 double")
class GridCells:
    """Rows of the grid over a rectangle, from its top left corner."""

    def eval(self, min_x: float, min_y: float, max_x: float, max_y: float, size: float):
        import numpy as np

        xs, ys = np.arange(min_x, max_x + size, size), np.arange(max_y, min_y - size, -size)
        for row in range(len(ys) - 1):
            for col in range(len(xs) - 1):
                yield row, col, float(xs[col]), float(ys[row + 1]), float(xs[col + 1]), float(ys[row])


def register_functions(spark: SparkSession, areas: dict[str, MeasurementArea] | None = None, lines: dict[str, MeasurementLine] | None = None) -> None:
    """Register in_<name>(x, y) for areas, distance_to_<name>(x, y) for lines, and the table functions grid_cells and fill_gaps."""
    for name, area in (areas or {}).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION in_{name}(x DOUBLE, y DOUBLE) RETURNS BOOLEAN RETURN {inside_sql(area)}")
    for name, line in (lines or {}).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION distance_to_{name}(x DOUBLE, y DOUBLE) RETURNS DOUBLE RETURN {distance_sql(line)}")
    ship(spark)
    spark.udtf.register("grid_cells", GridCells)
    spark.udtf.register("fill_gaps", fill_gaps)
