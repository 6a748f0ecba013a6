"""Cells that end at a line, cells that an obstacle cuts in two, and frames that are computed together."""

import duckdb
import numpy as np
import pytest

from stridewise.geometry import exprs, kernel
from stridewise.model import AxisAlignedMeasurementArea, MeasurementLine
from stridewise.operators import profiles
from stridewise.plans import oracle
from stridewise.plans.view import SQL

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def test_a_cell_that_ends_at_a_line_meets_it_whatever_rounding_says(spark):
    line = MeasurementLine([(0, 0), (0, 5)])
    corners = lambda *xy: [[{"x": float(x), "y": float(y)} for x, y in xy]]
    e = 3e-17
    rows = [
        ("left of it", corners((-1, 1), (e, 1), (-e, 2), (-1, 2))),
        ("right of it", corners((-e, 1), (1, 1), (1, 2), (e, 2))),
        ("a corner", corners((-1, 1), (-e, 1.5), (-1, 2))),
        ("across", corners((-1, 1), (1, 1), (1, 3), (-1, 3))),
        ("off", corners((1e-6, 1), (1, 1), (1, 2))),
    ]
    df = spark.createDataFrame(rows, f"name string, polygon {exprs.PIECES}")
    found = {r.name: (r.meets, r.share) for r in df.select("name", exprs.meets_line(df.polygon, line).alias("meets"), exprs.line_share(df.polygon, line).alias("share")).collect()}
    assert found["left of it"] == (True, pytest.approx(0.2)) and found["right of it"] == (True, pytest.approx(0.2))
    assert found["a corner"] == (True, 0.0) and found["across"] == (True, pytest.approx(0.4)) and found["off"] == (False, 0.0)


def test_sql_of_the_obstacle_leaves_out_parts_behind_it():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (VALUES (1, 0, 10.0::DOUBLE, 2.5::DOUBLE), (2, 0, 10.0, 2.44), (3, 0, 10.0, 2.56)) v(id, frame, x, y)")
    holed = "WITH _ AS (SELECT 1)" + oracle.HOLED
    area = dict(con.execute(holed + " SELECT id, area FROM holed").fetchall())
    # the middle cell is 0.06 high: what lies right of the obstacle is cut off
    assert area[1] == pytest.approx(30 * 0.06) and area[2] == pytest.approx(35 * 2.47 - 0.2 * 0.07) and area[3] == pytest.approx(35 * 2.47 - 0.2 * 0.07)
    assert "holed" in SQL + oracle.ORACLES["voronoi_cells_obstacle"]


def test_frames_computed_together_are_as_each_by_itself():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 30, 200, 1, 25]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    x, y = rng.random(starts[-1]) * 4, rng.random(starts[-1]) * 4
    x[40], y[40] = x[41], y[41]
    pairs: list = []
    px, py, count = kernel.voronoi(x, y, (0.0, 0.0, 4.0, 4.0), None, pairs, starts)
    near = set(zip(*(v.tolist() for v in kernel.touching_padded(px, py, count, 1e-9, pairs[0])), strict=True))
    expected = set()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own: list = []
        qx, qy, q = kernel.voronoi(x[a:b], y[a:b], (0.0, 0.0, 4.0, 4.0), None, own)
        assert (count[a:b] == q).all() and all((px[a + i, :n] == qx[i, :n]).all() and (py[a + i, :n] == qy[i, :n]).all() for i, n in enumerate(q))
        cells = kernel.cells_in_area(x[a:b], y[a:b], qx, qy, q, [SQUARE], [])
        expected |= {(i + a, j + a) for i, j in kernel.touching(cells, 1e-9)}
    assert near == expected


def test_pieces_of_a_cell_in_one_grid_cell_count_as_one(spark):
    square = lambda x, y, w: [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + w}, {"x": x, "y": y + w}]
    rows = [(1, 0, [square(0.0, 0.0, 0.5), square(0.5, 0.0, 0.25)]), (2, 0, [square(0.5, 0.5, 1.0)]), (3, 0, []), (4, 0, None)]
    df = spark.createDataFrame(rows, f"id long, frame long, polygon {exprs.PIECES}")
    area = AxisAlignedMeasurementArea(0, 0, 2, 2)
    found = profiles.grid_cell_polygon_intersection_area(df, profiles.grid_cells(axis_aligned_measurement_area=area, grid_size=1.0)).collect()
    assert {(r.id, r.row, r.col): r.area for r in found} == {(1, 1, 0): 0.3125, (2, 0, 0): 0.25, (2, 0, 1): 0.25, (2, 1, 0): 0.25, (2, 1, 1): 0.25}
