"""DuckDB counterparts of the trajectory queries: plain SQL over the same view."""

from __future__ import annotations

from stridewise.model import Cutoff
from stridewise.plans.view import CUTOFF, GRID_SHIFT, OBSTACLE, PAIR_CUTOFF, SQL

R = lambda v: f"(round({v}, 6) + 0.0)"
INSIDE = "x > -1.5 AND x < 1.5 AND y > 0 AND y < 5"

SPEED = ", d AS (SELECT id, frame, lag(x, 5) OVER w AS x0, lag(y, 5) OVER w AS y0, lag(frame, 5) OVER w AS f0, lead(x, 5) OVER w AS x1, lead(y, 5) OVER w AS y1, lead(frame, 5) OVER w AS f1, x, y FROM t WINDOW w AS (PARTITION BY id ORDER BY frame))"
EXCLUDE = SPEED + ", v AS (SELECT id, frame, (x1 - x0) / ((f1 - f0) / 10.0) AS v_x, (y1 - y0) / ((f1 - f0) / 10.0) AS v_y, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / ((f1 - f0) / 10.0) AS speed FROM d WHERE f0 IS NOT NULL AND f1 IS NOT NULL)"
SINGLE = SPEED + ", v AS (SELECT id, frame, (coalesce(x1, x) - coalesce(x0, x)) / nullif((coalesce(f1, frame) - coalesce(f0, frame)) / 10.0, 0) AS v_x, (coalesce(y1, y) - coalesce(y0, y)) / nullif((coalesce(f1, frame) - coalesce(f0, frame)) / 10.0, 0) AS v_y, sqrt(power(coalesce(x1, x) - coalesce(x0, x), 2) + power(coalesce(y1, y) - coalesce(y0, y), 2)) / nullif((coalesce(f1, frame) - coalesce(f0, frame)) / 10.0, 0) AS speed FROM d)"
ADAPTIVE = """, r AS (SELECT *, least(5, frame - min(frame) OVER (PARTITION BY id), max(frame) OVER (PARTITION BY id) - frame) AS w FROM t),
v AS (SELECT r.id, r.frame, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / (2 * r.w / 10.0) AS speed FROM r JOIN t a ON a.id = r.id AND a.frame = r.frame - r.w JOIN t b ON b.id = r.id AND b.frame = r.frame + r.w WHERE r.w > 0)"""
ACCELERATION = """, q AS (SELECT id, frame, x, y, lag(x, 5) OVER w AS mx, lag(y, 5) OVER w AS my, lag(frame, 5) OVER w AS mf, lag(x, 10) OVER w AS sx, lag(y, 10) OVER w AS sy FROM t WINDOW w AS (PARTITION BY id ORDER BY frame)),
acc AS (SELECT id, frame, (x - mx - (mx - sx)) AS ax, (y - my - (my - sy)) AS ay, (frame - mf) / 10.0 AS s FROM q WHERE sx IS NOT NULL),
a AS (SELECT id, frame, sqrt(ax * ax + ay * ay) / (s * s) AS acceleration, ax / (s * s) AS a_x, ay / (s * s) AS a_y FROM acc)"""


def _filled(value: str, source: str, name: str) -> str:
    return f" SELECT spine.frame, CASE WHEN g.frame IS NULL THEN 0.0 ELSE {R('g.v')} END AS {name} FROM spine LEFT JOIN (SELECT frame, {value} AS v FROM {source} GROUP BY frame) g USING (frame)"


CROSS = """, s AS (SELECT id, frame, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0, frame - lag(frame) OVER w AS gap, lead(frame) OVER w - frame AS ahead FROM t WINDOW w AS (PARTITION BY id ORDER BY frame)),
m AS (SELECT *, CASE WHEN x = x0 THEN y ELSE y0 + (y - y0) * (0 - x0) / (x - x0) END AS yc FROM s WHERE gap = 1 AND ahead = 1 AND x0 * x <= 0),
hit AS (SELECT id, frame, x, y FROM m WHERE yc >= 0 AND yc <= 5),
c AS (SELECT id, frame FROM hit WHERE sqrt(x * x + power(y - greatest(0, least(5, y)), 2)) >= 1e-5)"""
NT = CROSS + """, f AS (SELECT id, min(frame) AS frame FROM c GROUP BY id),
nt AS (SELECT frame, CAST(sum(coalesce(n, 0)) OVER (ORDER BY frame) AS BIGINT) AS n FROM spine LEFT JOIN (SELECT frame, count(*) AS n FROM f GROUP BY frame) USING (frame))"""

# stays between the line x = 0 and x = -1, in over one and out over the other
STAYS = """, i AS (SELECT id, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY id ORDER BY frame) >= 2 THEN 1 ELSE 0 END AS new FROM t WHERE {inside}),
j AS (SELECT id, frame, sum(new) OVER (PARTITION BY id ORDER BY frame) AS stay FROM i),
stay AS (SELECT id, min(frame) AS entering_frame, max(frame) + 1 AS leaving_frame FROM j GROUP BY id, stay)"""
_ON = """, s AS (SELECT id, frame, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0, frame - lag(frame) OVER w AS gap, lead(frame) OVER w - frame AS ahead FROM t WINDOW w AS (PARTITION BY id ORDER BY frame)),
on0 AS (SELECT id, frame FROM s WHERE gap = 1 AND ahead = 1 AND x0 * x <= 0 AND (CASE WHEN x = x0 THEN y ELSE y0 + (y - y0) * (0 - x0) / (x - x0) END) BETWEEN 0 AND 5),
on1 AS (SELECT id, frame FROM s WHERE gap = 1 AND ahead = 1 AND (x0 + 1) * (x + 1) <= 0 AND (CASE WHEN x = x0 THEN y ELSE y0 + (y - y0) * (-1 - x0) / (x - x0) END) BETWEEN 0 AND 5)"""
THROUGH = STAYS.format(inside="x > -1 AND x < 0 AND y > 0 AND y < 5") + _ON + """, thr AS (SELECT * FROM stay z WHERE
  (EXISTS (FROM on0 WHERE id = z.id AND frame = z.entering_frame) AND EXISTS (FROM on1 WHERE id = z.id AND frame = z.leaving_frame))
  OR (EXISTS (FROM on1 WHERE id = z.id AND frame = z.entering_frame) AND EXISTS (FROM on0 WHERE id = z.id AND frame = z.leaving_frame)))"""

# polygons are lists of (x, y, w); a half-plane is a list of one (a, b, c), so that both have one type
_D = "(h[1].x * p[{i}].x + h[1].y * p[{i}].y - h[1].w)"
_J = "(i % len(p) + 1)"
_DI, _DJ = _D.format(i="i"), _D.format(i=_J)
_MEET = f"{{'x': p[i].x + {_DI} / ({_DI} - {_DJ}) * (p[{_J}].x - p[i].x), 'y': p[i].y + {_DI} / ({_DI} - {_DJ}) * (p[{_J}].y - p[i].y), 'w': 0.0::DOUBLE}}"
_CLIP = f"lambda p, h: flatten(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN {_DI} <= 0 AND {_DJ} <= 0 THEN [p[i]] WHEN {_DI} <= 0 THEN [p[i], {_MEET}] WHEN {_DJ} <= 0 THEN [{_MEET}] ELSE [] END))"
_C = lambda x, y, w: f"{{'x': {x}::DOUBLE, 'y': {y}::DOUBLE, 'w': {w}::DOUBLE}}"
_BOX = "[" + ", ".join(_C(x, y, 0) for x, y in ((-15, 0), (20, 0), (20, 5), (-15, 5))) + "]"
_M_PLANES = "[" + ", ".join(f"[{_C(a, b, c)}]" for a, b, c in ((1, 0, 1.5), (-1, 0, 1.5))) + "]"


def polygon_area(p: str) -> str:
    return f"abs(coalesce(list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({p}[i].x - {p}[1].x) * ({p}[i % len({p}) + 1].y - {p}[1].y) - ({p}[i % len({p}) + 1].x - {p}[1].x) * ({p}[i].y - {p}[1].y))), 0.0)) / 2"


CELLS = f""", near AS (SELECT a.frame, a.id, list([{_C('b.x - a.x', 'b.y - a.y', '(b.x * b.x - a.x * a.x + b.y * b.y - a.y * a.y) / 2').replace('b.x - a.x::DOUBLE', '(b.x - a.x)::DOUBLE').replace('b.y - a.y::DOUBLE', '(b.y - a.y)::DOUBLE').replace('(b.x * b.x - a.x * a.x + b.y * b.y - a.y * a.y) / 2::DOUBLE', '((b.x * b.x - a.x * a.x + b.y * b.y - a.y * a.y) / 2)::DOUBLE')}] ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) FILTER (b.id IS NOT NULL) AS hs FROM t a LEFT JOIN t b ON a.frame = b.frame AND a.id <> b.id GROUP BY a.frame, a.id),
raw AS (SELECT frame, id, list_reduce(coalesce(hs, []), {_CLIP}, {_BOX}) AS p FROM near),
cell AS (SELECT frame, id, p, {polygon_area('p')} AS area FROM raw),
cut AS (SELECT *, {polygon_area('q')} AS part FROM (SELECT *, list_reduce({_M_PLANES}, {_CLIP}, p) AS q FROM cell))"""
# where the cells' outlines pass x = 0; a corner within 1e-9 of it lies on it
_NEXT = "p[i % len(p) + 1]"
_YC = f"p[i].y + (0 - p[i].x) / ({_NEXT}.x - p[i].x) * ({_NEXT}.y - p[i].y)"
LINE = CELLS + SINGLE + f""", z AS (SELECT frame, id, area, list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i].x = 0 THEN p[i].y WHEN p[i].x * {_NEXT}.x < 0 THEN {_YC} END), lambda u: u IS NOT NULL) AS ys
  FROM (SELECT frame, id, area, list_transform(p, lambda u: {{'x': CASE WHEN abs(u.x) <= 1e-9 THEN 0.0::DOUBLE ELSE u.x END, 'y': u.y}}) AS p FROM cell)),
onl AS (SELECT frame, id, 1 / area AS density, (least(5, list_max(ys)) - greatest(0, list_min(ys))) / 5 AS share FROM z WHERE len(ys) >= 1 AND list_max(ys) >= 0 AND list_min(ys) <= 5),
sp AS (SELECT o.id, sign(v.v_x) AS species FROM (SELECT id, min(frame) AS frame FROM onl GROUP BY id) o JOIN v USING (id, frame)),
ls AS (SELECT frame, id, share, density, species, v_x FROM onl JOIN sp USING (id) JOIN v USING (id, frame) WHERE species IN (1, -1))"""


def _line(value: str, up: str, down: str, total: str, flip: bool) -> str:
    minus = "-" if flip else ""
    return SQL + LINE + f' SELECT frame, {R("u")} AS "{up}", {R("d")} AS "{down}", {R("coalesce(u, 0) + coalesce(d, 0)")} AS {total} FROM (SELECT frame, sum({value}) FILTER (species = 1) AS u, {minus}sum({value}) FILTER (species = -1) AS d FROM ls GROUP BY frame)'


# the grid over x -4..4 less S, y 0..5 and S more, cells of 1 m
S = repr(GRID_SHIFT) + "::DOUBLE"
GRID = f", fr AS (SELECT DISTINCT frame FROM t), g AS (SELECT frame, r.r::INTEGER AS row, c.c::INTEGER AS col FROM fr, range(5) r(r), range(8) c(c)), b AS (SELECT *, greatest(4 - floor(y - {S}), 0)::INTEGER AS row, least(floor(x + 4 + {S}), 7)::INTEGER AS col FROM t WHERE x >= -4 - {S} AND x <= 4 - {S} AND y >= {S} AND y <= 5 + {S})"


def _grid(value: str, source: str, fill: str) -> str:
    return f" SELECT g.frame, g.row, g.col, coalesce({R('k.v')}, {fill}) AS value FROM g LEFT JOIN (SELECT frame, row, col, {value} AS v FROM {source} GROUP BY frame, row, col) k USING (frame, row, col)"


_SIGMA = "(1.0 / 2.35482)"
_BELL = lambda d: f"(1 / (2.50662 * {_SIGMA}) * exp(-({d}) * ({d}) / (2 * {_SIGMA} * {_SIGMA})))"
_GS = "(0.5 / (2 * sqrt(2 * ln(2))))"
_OVER = CELLS + EXCLUDE + f""", ov AS (SELECT frame, id, area, speed, row, col, {polygon_area('q')} AS part FROM (
  SELECT c.frame, c.id, c.area, v.speed, r.r::INTEGER AS row, k.k::INTEGER AS col, list_reduce([[{{'x': 1.0::DOUBLE, 'y': 0.0::DOUBLE, 'w': (k.k - 3 - {S})::DOUBLE}}], [{{'x': -1.0::DOUBLE, 'y': 0.0::DOUBLE, 'w': (4 + {S} - k.k)::DOUBLE}}], [{{'x': 0.0::DOUBLE, 'y': 1.0::DOUBLE, 'w': (5 + {S} - r.r)::DOUBLE}}], [{{'x': 0.0::DOUBLE, 'y': -1.0::DOUBLE, 'w': (r.r - 4 - {S})::DOUBLE}}]], {_CLIP}, c.p) AS q
  FROM cell c JOIN v USING (id, frame), range(5) r(r), range(8) k(k)
  WHERE list_max(list_transform(c.p, lambda u: u.x)) > k.k - 4 - {S} AND list_min(list_transform(c.p, lambda u: u.x)) < k.k - 3 - {S} AND list_max(list_transform(c.p, lambda u: u.y)) > 4 + {S} - r.r AND list_min(list_transform(c.p, lambda u: u.y)) < 5 + {S} - r.r) WHERE len(q) > 2),
fr AS (SELECT DISTINCT frame FROM v), g AS (SELECT frame, r.r::INTEGER AS row, c.c::INTEGER AS col FROM fr, range(5) r(r), range(8) c(c))"""
_RSET = lambda f: SQL + GRID + f" SELECT q.row, q.col, {R('k.v')} AS value FROM (SELECT DISTINCT row, col FROM g) q LEFT JOIN (SELECT row, col, {f}(frame / 10.0) AS v FROM b GROUP BY row, col) k USING (row, col)"

# cells inside a polygon of twelve corners around each pedestrian
_CORNERS = "[" + ", ".join(_C(repr(x), repr(y), 0) for x, y in Cutoff(radius=CUTOFF).corners) + "]"
_BOX_PLANES = "[" + ", ".join(f"[{_C(a, b, c)}]" for a, b, c in ((1, 0, 20), (-1, 0, 15), (0, 1, 5), (0, -1, 0))) + "]"
CUT_CELLS = CELLS + f""", around AS (SELECT near.frame, near.id, list_reduce(coalesce(hs, []) || {_BOX_PLANES}, {_CLIP}, list_transform({_CORNERS}, lambda u: {{'x': u.x + t.x, 'y': u.y + t.y, 'w': 0.0::DOUBLE}})) AS p FROM near JOIN t USING (frame, id))"""

# squared distance of corner v to the edge of q from k on
_SX, _SY = "(q[k % len(q) + 1].x - q[k].x)", "(q[k % len(q) + 1].y - q[k].y)"
_T = f"greatest(0, least(1, ((v.x - q[k].x) * {_SX} + (v.y - q[k].y) * {_SY}) / ({_SX} * {_SX} + {_SY} * {_SY})))"
_D2 = f"power(v.x - q[k].x - {_T} * {_SX}, 2) + power(v.y - q[k].y - {_T} * {_SY}, 2)"
_REACH = lambda p, q: f"list_min(flatten(list_transform({p}, lambda v: list_transform(range(1, len({q}) + 1), lambda k: {_D2.replace('q[', q + '[').replace('len(q)', f'len({q})')}))))"
_SPAN = ", ".join(f"list_{f}(list_transform(p, lambda u: u.{c})) AS {f}_{c}" for f in ("min", "max") for c in "xy")
TOUCH = CELLS + f""", bx AS MATERIALIZED (SELECT frame, id, p, {_SPAN} FROM cell),
pr AS (SELECT a.frame, a.id, b.id AS other, a.p AS pa, b.p AS pb FROM bx a JOIN bx b ON a.frame = b.frame AND a.id < b.id AND a.min_x <= b.max_x + 1e-9 AND b.min_x <= a.max_x + 1e-9 AND a.min_y <= b.max_y + 1e-9 AND b.min_y <= a.max_y + 1e-9),
to1 AS (SELECT frame, id, other FROM pr WHERE least({_REACH('pa', 'pb')}, {_REACH('pb', 'pa')}) <= 1e-18),
nb AS (SELECT id, frame, other AS neighbor_id FROM to1 UNION ALL SELECT other, frame, id FROM to1)"""

# cells less a small obstacle; of parts that do not touch, the one around the pedestrian. Around the obstacle lie four pieces, in turn: left of it, below, right, above
_HALF = lambda a, b, c: f"[{_C(a, b, c)}]"
_AROUND = (
    [_HALF(1, 0, OBSTACLE[0])],
    [_HALF(-1, 0, -OBSTACLE[0]), _HALF(1, 0, OBSTACLE[2]), _HALF(0, 1, OBSTACLE[1])],
    [_HALF(-1, 0, -OBSTACLE[2])],
    [_HALF(-1, 0, -OBSTACLE[0]), _HALF(1, 0, OBSTACLE[2]), _HALF(0, -1, -OBSTACLE[3])],
)
_AT = lambda q, x: f"list_transform(list_filter({q}, lambda u: abs(u.x - {x}) <= 1e-9), lambda u: u.y)"
_TOUCH = lambda q, r, x: f"(len({_AT(q, x)}) > 1 AND len({_AT(r, x)}) > 1 AND least(list_max({_AT(q, x)}), list_max({_AT(r, x)})) - greatest(list_min({_AT(q, x)}), list_min({_AT(r, x)})) > 1e-10)"
HOLED = CELLS + f""", piece AS (SELECT frame, id, {", ".join(f"list_reduce([{', '.join(h)}], {_CLIP}, p) AS q{k}" for k, h in enumerate(_AROUND))} FROM cell),
linked AS (SELECT frame, id, [{", ".join(polygon_area(f"q{k}") for k in range(4))}] AS a, [{_TOUCH("q0", "q1", OBSTACLE[0])}, {_TOUCH("q1", "q2", OBSTACLE[2])}, {_TOUCH("q2", "q3", OBSTACLE[2])}, {_TOUCH("q3", "q0", OBSTACLE[0])}] AS e FROM piece),
homed AS (SELECT linked.*, CASE WHEN x <= {OBSTACLE[0]} THEN 0 WHEN x <= {OBSTACLE[2]} AND y <= {OBSTACLE[1]} THEN 1 WHEN x <= {OBSTACLE[2]} AND y >= {OBSTACLE[3]} THEN 3 WHEN x >= {OBSTACLE[2]} THEN 2 END AS h FROM linked JOIN t USING (frame, id)),
holed AS (SELECT frame, id, list_sum(list_transform(range(0, 4), lambda k: CASE WHEN h IS NULL OR k = 0 OR list_bool_and(list_transform(range(h, h + k), lambda j: e[j % 4 + 1])) OR list_bool_and(list_transform(range(h + k, h + 4), lambda j: e[j % 4 + 1])) THEN a[(coalesce(h, 0) + k) % 4 + 1] ELSE 0 END)) AS area FROM homed)"""
# twice through the wall's band, from [-1, 0.05] onto [0.01, 0.05]
_PUSH = lambda d: f"(({d}) + 1) * (0.04::DOUBLE / 1.05::DOUBLE) + 0.01"
# one position of every tenth pedestrian takes the place of the next one, as a gap of one is filled from its later end
REPAIRED = ", o AS (SELECT id, frame, CASE WHEN id % 10 = 3 AND frame = min(frame) OVER (PARTITION BY id) + 20 THEN lead(x) OVER (PARTITION BY id ORDER BY frame) ELSE x END AS x, CASE WHEN id % 10 = 3 AND frame = min(frame) OVER (PARTITION BY id) + 20 THEN lead(y) OVER (PARTITION BY id ORDER BY frame) ELSE y END AS y, dense_rank() OVER (ORDER BY id) AS new_id FROM t)"
_PAIRS = "SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM {0} a JOIN {0} b ON a.frame = b.frame AND a.place < b.place WHERE a.frame IN (SELECT frame FROM {0} GROUP BY frame HAVING min(id) < max(id))"
_DISTANCE = "sqrt(x * x + power(y - greatest(0, least(5, y)), 2))"
_VIEW = SQL + f" SELECT id, frame, {R('x')} AS x, {R('y')} AS y FROM t"
TIMES = CROSS + f", td AS (SELECT t.id, t.frame, (c.frame - t.frame) / 10.0 AS time, {_DISTANCE} AS distance FROM t JOIN c ON c.id = t.id WHERE c.frame >= t.frame)"

ORACLES = {
    "traj_view": SQL + f" SELECT id, frame, {R('x')} AS x, {R('y')} AS y FROM t",
    "frame_slice": SQL + f" SELECT id, frame, {R('x')} AS x, {R('y')} AS y FROM t WHERE frame >= 10 AND frame < least(60, (SELECT max(frame) FROM t))",
    "summary": SQL + f" SELECT {R('min(x)')} AS min_x, {R('min(y)')} AS min_y, {R('max(x)')} AS max_x, {R('max(y)')} AS max_y, count(DISTINCT id) AS number_pedestrians, min(frame) AS min_frame, max(frame) AS max_frame FROM t",
    "invalid_trajectory": SQL + f" SELECT id, frame, {R('x')} AS x, {R('y')} AS y FROM t WHERE NOT (x > -9 AND x < 11 AND y > 0.5 AND y < 4.5) OR (x >= 2 AND x <= 3 AND y >= 2 AND y <= 3)",
    "classic_density": SQL + _filled("count(*) / 15.0", f"t WHERE {INSIDE}", "density"),
    "individual_speed": SQL + EXCLUDE + f" SELECT id, frame, {R('speed')} AS speed, {R('v_x')} AS v_x, {R('v_y')} AS v_y FROM v",
    "individual_speed_single_sided": SQL + SINGLE + f" SELECT id, frame, {R('speed')} AS speed FROM v",
    "individual_speed_adaptive": SQL + ADAPTIVE + f" SELECT id, frame, {R('speed')} AS speed FROM v",
    "individual_speed_direction": SQL + EXCLUDE + f" SELECT id, frame, {R('(v_x * 0.6 + v_y * 0.8)')} AS speed FROM v",
    "mean_speed": SQL + EXCLUDE + _filled("avg(speed)", f"(SELECT t.frame, v.speed, t.x, t.y FROM t JOIN v USING (id, frame)) WHERE {INSIDE}", "speed"),
    "individual_acceleration": SQL + ACCELERATION + f" SELECT id, frame, {R('acceleration')} AS acceleration, {R('a_x')} AS a_x, {R('a_y')} AS a_y FROM a",
    "mean_acceleration": SQL + ACCELERATION + _filled("avg(acceleration)", f"(SELECT t.frame, a.acceleration, t.x, t.y FROM t JOIN a USING (id, frame)) WHERE {INSIDE}", "acceleration"),
    "stay_intervals": SQL + STAYS.format(inside=INSIDE) + " SELECT id, entering_frame, leaving_frame FROM stay",
    "crossing_frames": SQL + CROSS + " SELECT id, frame FROM c",
    "n_t": SQL + NT + f" SELECT frame, n AS cumulative_pedestrians, {R('frame / 10.0')} AS time FROM nt",
    "flow": SQL + NT + EXCLUDE + f""", p0 AS (SELECT min(frame) FILTER (n > 0) AS f0, max(frame) AS last FROM nt),
gr AS (SELECT f0, unnest(generate_series(f0 + 20, last - 1, 20)) AS frame FROM p0), sm AS (SELECT DISTINCT f0, n FROM gr JOIN nt USING (frame)),
rc AS (SELECT n, min(frame) + 1 AS passed FROM nt GROUP BY n),
wn AS (SELECT n, passed, lag(n, 1, 0) OVER (ORDER BY n) AS n0, coalesce(lag(passed) OVER (ORDER BY n), f0) AS ws FROM sm JOIN rc USING (n))
SELECT {R('(n - n0) / (passed - ws) * 10.0')} AS flow, {R('(SELECT avg(speed) FROM f JOIN v USING (id, frame) WHERE frame BETWEEN ws AND passed)')} AS mean_speed, ws AS window_start, passed AS window_end FROM wn WHERE n > n0""",
    "frame_range_in_area": SQL + THROUGH + " SELECT id, entering_frame, leaving_frame FROM thr",
    "passing_speed": SQL + THROUGH + f" SELECT id, {R('10.0 * 1.0 / abs(leaving_frame - entering_frame)')} AS speed FROM thr",
    "passing_density": SQL + THROUGH + f", dn AS (SELECT spine.frame, coalesce(n, 0) / 15.0 AS density FROM spine LEFT JOIN (SELECT frame, count(*) AS n FROM t WHERE {INSIDE} GROUP BY frame) USING (frame)) SELECT id, {R('avg(density)')} AS density FROM thr JOIN dn ON frame >= entering_frame AND frame < leaving_frame GROUP BY id, entering_frame",
    "time_distance_line": SQL + CROSS + f" SELECT t.id, t.frame, {R('(c.frame - t.frame) / 10.0')} AS time, {R('sqrt(x * x + power(y - greatest(0, least(5, y)), 2))')} AS distance FROM t JOIN c ON c.id = t.id WHERE c.frame >= t.frame",
    "voronoi_cells": SQL + CELLS + f" SELECT id, frame, {R('area')} AS area, {R('1 / area')} AS density FROM cell",
    "voronoi_cells_cutoff": SQL + CUT_CELLS + f" SELECT id, frame, {R(polygon_area('p'))} AS area, {R('1 / (' + polygon_area('p') + ')')} AS density FROM around",
    "neighbors": SQL + TOUCH + " SELECT id, frame, neighbor_id FROM nb",
    "neighbor_distance": SQL + TOUCH + f" SELECT nb.id, nb.frame, neighbor_id, {R('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} AS distance FROM nb JOIN t a ON a.id = nb.id AND a.frame = nb.frame JOIN t b ON b.id = neighbor_id AND b.frame = nb.frame",
    "grid_intersection_area": SQL + _OVER.replace("JOIN v USING (id, frame), range(5)", "LEFT JOIN v USING (id, frame), range(5)") + f" SELECT id, frame, row, col, {R('part')} AS area FROM ov WHERE part > 0",
    "intersecting_polygons": SQL + CELLS + f" SELECT id, frame, {R('part')} AS area FROM cut",
    "voronoi_density": SQL + CELLS + _filled("sum(part / area) / 15.0", "cut", "density"),
    "voronoi_speed": SQL + CELLS + EXCLUDE + _filled("sum(part * speed) / 15.0", "(SELECT cut.frame, part, speed FROM cut JOIN v USING (id, frame))", "speed"),
    "voronoi_acceleration": SQL + CELLS + ACCELERATION + _filled("sum(part * acceleration) / 15.0", "(SELECT cut.frame, part, acceleration FROM cut JOIN a USING (id, frame))", "acceleration"),
    "species": SQL + LINE + " SELECT id, CAST(species AS DOUBLE) AS species FROM sp",
    "line_speed": _line("v_x * share", "s_sp+1", "s_sp-1", "speed", True),
    "line_density": _line("density * share", "p_sp+1", "p_sp-1", "density", False),
    "line_flow": _line("v_x * density * share", "j_sp+1", "j_sp-1", "flow", True),
    "pair_histogram": SQL + " SELECT CAST(ceil(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.5) AS BIGINT) AS bin, count(*) AS n FROM t a JOIN t b ON a.frame = b.frame AND a.id < b.id GROUP BY 1",
    "grid_cells": SQL + f" SELECT r.r::INTEGER AS row, c.c::INTEGER AS col, (SELECT count(*) FROM t WHERE x >= -4 - {S} + c.c AND x < -4 - {S} + c.c + 1 AND y >= {S} + 4 - r.r AND y < {S} + 5 - r.r) AS positions FROM range(5) r(r), range(8) c(c)",
    "gap_filling": SQL + f""", h AS (SELECT *, frame - min(frame) OVER (PARTITION BY id) AS since FROM t), k AS (SELECT id, frame, x, y FROM h WHERE NOT (id % 3 = 0 AND (since BETWEEN 5 AND 6 OR since BETWEEN 12 AND 17))),
n AS (SELECT *, lead(frame) OVER w AS f1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY id ORDER BY frame)),
i AS (SELECT *, unnest(generate_series(1, f1 - frame - 1)) AS j FROM n WHERE f1 - frame BETWEEN 2 AND 5)
SELECT id, frame, {R('x')} AS x, {R('y')} AS y, false AS filled FROM k UNION ALL SELECT id, frame + j, {R('x + (x1 - x) * j / (f1 - frame)')}, {R('y + (y1 - y) * j / (f1 - frame)')}, true FROM i""",
    "crowd_hull": SQL + f""", u AS (SELECT DISTINCT frame, x, y FROM t), n AS (SELECT frame, count(*) AS n FROM u GROUP BY frame),
edge AS (SELECT a.frame, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM u a JOIN u b ON a.frame = b.frame AND (a.x <> b.x OR a.y <> b.y)),
sides AS (SELECT edge.*, (vx - ux) * (c.y - uy) - (vy - uy) * (c.x - ux) AS side, (c.x - ux) * (c.x - vx) + (c.y - uy) * (c.y - vy) AS between_ FROM edge JOIN u c ON c.frame = edge.frame AND NOT (c.x = ux AND c.y = uy) AND NOT (c.x = vx AND c.y = vy)),
around AS (SELECT frame, ux, uy, vx, vy FROM sides GROUP BY ALL HAVING bool_and(side > 1e-13 OR (abs(side) <= 1e-13 AND between_ <= 0))),
ring AS (SELECT frame, CAST(count(*) AS INTEGER) AS corners, sum(ux * vy - vx * uy) / 2 AS area, sum(sqrt((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy))) AS perimeter FROM around GROUP BY frame),
two AS (SELECT frame, CAST(count(*) AS INTEGER) AS corners, 0.0 AS area, 2 * sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS perimeter FROM u JOIN n USING (frame) WHERE n < 3 GROUP BY frame)
SELECT frame, corners, {R('area')} AS area, {R('perimeter')} AS perimeter FROM (SELECT * FROM ring UNION ALL SELECT * FROM two)""",
    "profiles_of_kept_intersections": SQL + _OVER + ", k AS (SELECT frame, row, col, sum(part / area) AS d, avg(CASE WHEN part > 1e-16 THEN speed END) AS s FROM ov GROUP BY ALL)" + f" SELECT 'density' AS profile, g.frame, g.row, g.col, coalesce({R('d')}, 0.0) AS value FROM g LEFT JOIN k USING (frame, row, col) UNION ALL SELECT 'speed', g.frame, g.row, g.col, coalesce({R('s')}, 0.0) FROM g LEFT JOIN k USING (frame, row, col)",
    "density_profile_classic": SQL + GRID + _grid("count(*) / 1.0", "b", "0.0"),
    "density_profile_gaussian": SQL + GRID + f" SELECT frame, row, col, {R('sum(' + _BELL(f'x - (-4 - {S} + col + 0.5)') + ' * ' + _BELL(f'y - (5 + {S} - row - 0.5)') + ')')} AS value FROM g JOIN t USING (frame) GROUP BY frame, row, col",
    "density_profile_voronoi": SQL + _OVER + _grid("sum(part / area)", "ov", "0.0"),
    "speed_profile_voronoi": SQL + _OVER + _grid("sum(part * speed)", "ov", "0.0"),
    "speed_profile_arithmetic": SQL + _OVER + _grid("avg(speed)", "(SELECT * FROM ov WHERE part > 1e-16)", "0.0"),
    "speed_profile_mean": SQL + EXCLUDE + ", tv AS (SELECT t.*, v.speed FROM t JOIN v USING (id, frame))" + GRID.replace("FROM t WHERE x >=", "FROM tv WHERE x >=").replace("SELECT DISTINCT frame FROM t)", "SELECT DISTINCT frame FROM tv)") + _grid("avg(speed)", "b", "-1.0"),
    "speed_profile_gaussian": SQL + EXCLUDE + ", tv AS (SELECT t.*, v.speed FROM t JOIN v USING (id, frame))" + GRID.replace("FROM t WHERE x >=", "FROM tv WHERE x >=").replace("SELECT DISTINCT frame FROM t)", "SELECT DISTINCT frame FROM tv)") + f" SELECT frame, row, col, CASE WHEN sum(w) > 0 THEN {R('sum(w * speed) / sum(w)')} ELSE -1.0 END AS value FROM (SELECT g.*, tv.speed, exp(-(power(x - (-4 - {S} + col + 0.5), 2) + power(y - (5 + {S} - row - 0.5), 2)) / (2 * {_GS} * {_GS})) AS w FROM g JOIN tv USING (frame)) GROUP BY frame, row, col",
    "individual_speed_long_direction": SQL + EXCLUDE + f" SELECT id, frame, {R('(v_x * 3 + v_y * 4) * 125')} AS speed FROM v",
    "flow_without_crossing": "SELECT 0.0::DOUBLE AS flow, 0.0::DOUBLE AS mean_speed, 0::BIGINT AS window_start, 0::BIGINT AS window_end WHERE false",
    "voronoi_cells_obstacle": SQL + HOLED + f" SELECT id, frame, {R('area')} AS area FROM holed",
    "voronoi_profiles": SQL + _OVER + f" SELECT g.frame, g.row, g.col, coalesce({R('d')}, 0.0) AS density, coalesce({R('s')}, 0.0) AS speed FROM g LEFT JOIN (SELECT frame, row, col, sum(part / area) AS d, sum(part * speed) AS s FROM ov GROUP BY ALL) k USING (frame, row, col)",
    "compute_profiles": SQL + _OVER + ", k AS (SELECT frame, row, col, sum(part / area) AS d, sum(part * speed) AS s FROM ov GROUP BY ALL)" + f" SELECT 'density' AS profile, g.frame, g.row, g.col, coalesce({R('d')}, 0.0) AS value FROM g LEFT JOIN k USING (frame, row, col) UNION ALL SELECT 'speed', g.frame, g.row, g.col, coalesce({R('s')}, 0.0) FROM g LEFT JOIN k USING (frame, row, col)",
    "line_validation": SQL + LINE + """, w(what, missing) AS (
  SELECT 'species', (SELECT count(*) FROM onl WHERE id NOT IN (SELECT id FROM sp)) UNION ALL SELECT 'half the species', (SELECT count(*) FROM onl WHERE id NOT IN (SELECT id FROM sp WHERE id % 2 = 0))
  UNION ALL SELECT 'speeds', (SELECT count(*) FROM onl LEFT JOIN v USING (id, frame) WHERE v_x IS NULL) UNION ALL SELECT 'half the speeds', (SELECT count(*) FROM onl LEFT JOIN (FROM v WHERE id % 2 = 0) h USING (id, frame) WHERE h.v_x IS NULL))
SELECT what, CASE WHEN what LIKE '%species' THEN CASE WHEN missing = 0 THEN 'true' ELSE 'false' END WHEN missing = 0 THEN 'DATA_CORRECT' ELSE 'ENTRY_MISSING' END AS verdict FROM w UNION ALL SELECT 'speeds without components', 'COLUMN_MISSING'""",
    "guards": SQL + LINE + """, gap AS (SELECT sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / ((frame - lag(frame) OVER w) / 10.0) AS m FROM t WINDOW w AS (PARTITION BY id ORDER BY frame)), top AS (SELECT max(m) AS m FROM gap),
borders AS (SELECT count(*) AS n FROM (SELECT lag(id, 5) OVER w AS b, lead(id, 5) OVER w AS a FROM t WINDOW w AS (PARTITION BY id ORDER BY frame)) WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT 'speeds without borders' AS what, CASE WHEN (SELECT n FROM borders) < (SELECT count(*) FROM t) THEN 'SpeedError' ELSE 'fine' END AS verdict
UNION ALL SELECT 'speeds of all rows', 'fine'
UNION ALL SELECT 'all species', CASE WHEN (SELECT count(*) FROM onl WHERE id NOT IN (SELECT id FROM sp)) > 0 THEN 'InputError' ELSE 'fine' END
UNION ALL SELECT 'half the species', CASE WHEN (SELECT count(*) FROM onl WHERE id NOT IN (SELECT id FROM sp WHERE id % 2 = 0)) > 0 THEN 'InputError' ELSE 'fine' END
UNION ALL SELECT 'steps at 10 a second', CASE WHEN m / 10 > 0.1 THEN 'long' ELSE 'fine' END FROM top
UNION ALL SELECT 'steps at 1000 a second', CASE WHEN m / 1000 > 0.1 THEN 'long' ELSE 'fine' END FROM top""",
    "pair_distribution_function": SQL + f""", r AS (SELECT id, frame, x, y, row_number() OVER (ORDER BY md5(concat_ws(':', 0, id, frame, 1))) AS place FROM t),
l AS (SELECT frame, row_number() OVER (ORDER BY md5(concat_ws(':', 1, id, frame, 1))) AS place FROM t),
s AS (SELECT place, id, l.frame, x, y FROM r JOIN l USING (place)), u AS (SELECT row_number() OVER () AS place, id, frame, x, y FROM t),
op AS ({_PAIRS.format('u')}), rp AS ({_PAIRS.format('s')}),
ob AS (SELECT ceil(d / 0.5) AS bin, count(*) AS n FROM op GROUP BY 1), rb AS (SELECT ceil(d / 0.5) AS bin, count(*) AS n FROM rp GROUP BY 1),
bins AS (SELECT unnest(range(1, CAST((SELECT ceil(max(d) / 0.5) FROM op) AS BIGINT))) AS bin)
SELECT {R('bin * 0.5')} AS r, {R('(coalesce(ob.n, 0) / (SELECT count(*) FROM op)) / (rb.n / (SELECT count(*) FROM rp))')} AS g FROM bins LEFT JOIN ob USING (bin) LEFT JOIN rb USING (bin)""",
    "outlier_repair": SQL + f" SELECT dense_rank() OVER (ORDER BY id) AS id, frame, {R('x')} AS x, {R('y')} AS y FROM t",
    "outlier_repair_planted": SQL + REPAIRED + f" SELECT new_id AS id, frame, {R('x')} AS x, {R('y')} AS y FROM o",
    "outlier_changes": SQL + REPAIRED + " SELECT DISTINCT id AS original_id, new_id FROM o WHERE id % 10 = 3",
    "wall_projection_one_wall": SQL + f" SELECT id, frame, {R('x')} AS x, CASE WHEN y - 0.5 <= 0.05 THEN {R('0.5 + ' + _PUSH(_PUSH('y - 0.5')))} ELSE {R('y')} END AS y FROM t",
    "track_ends": SQL + f" SELECT id, {R('arg_min(x, frame)')} AS first_x, {R('arg_min(y, frame)')} AS first_y, {R('arg_max(x, frame)')} AS last_x, {R('arg_max(y, frame)')} AS last_y FROM t GROUP BY id",
    "speed_distribution": SQL + EXCLUDE + f" SELECT {R('min(speed)')} AS min, {R('avg(speed)')} AS mean, {R('median(speed)')} AS median, {R('max(speed)')} AS max FROM v",
    "density_over_time": SQL + _filled("count(*) / 15.0", f"t WHERE {INSIDE}", "density").replace("SELECT spine.frame,", f"SELECT spine.frame, {R('spine.frame / 10.0')} AS time,"),
    "neighborhood_roles": SQL + TOUCH + f" SELECT id, {R('x')} AS x, {R('y')} AS y, CASE WHEN id = 30 THEN 'base' WHEN id IN (SELECT neighbor_id FROM nb WHERE frame = 40 AND id = 30) THEN 'neighbor' ELSE 'other' END AS role FROM t WHERE frame = 40",
    "mean_density_profile": SQL + GRID + f" SELECT row, col, {R('avg(v)')} AS value FROM (SELECT g.frame, g.row, g.col, count(b.frame) AS v FROM g LEFT JOIN b USING (frame, row, col) GROUP BY ALL) GROUP BY row, col",
    "time_distance_speed": SQL + TIMES + EXCLUDE.replace(", d AS", ", dd AS").replace("FROM d WHERE", "FROM dd WHERE") + f" SELECT id, frame, {R('time')} AS time, {R('distance')} AS distance, {R('speed')} AS speed FROM td JOIN v USING (id, frame)",
    "time_distance_starts": SQL + TIMES + f" SELECT id, min(frame) AS frame, {R('arg_min(time, frame)')} AS time, {R('arg_min(distance, frame)')} AS distance FROM td GROUP BY id",
    "sql_functions": SQL + f" SELECT id, frame, {INSIDE} AS inside, {R(_DISTANCE)} AS distance FROM t",
    "source_areas": SQL + ", b AS (SELECT ceil(max(x)) - floor(min(x)) AS w, ceil(max(y)) - floor(min(y)) AS h FROM t) SELECT 'floor' AS source, (w + 1) * (h + 3) - 2 * w AS area FROM b UNION ALL SELECT 'scenario', (w - 1) * (h - 1) - 1 FROM b",
    "trajectory_validity": SQL + " SELECT 'box' AS area, bool_and(x > -15 AND x < 20 AND y > 0 AND y < 5) AS valid FROM t UNION ALL SELECT 'above the wall', bool_and(x > -20 AND x < 25 AND y > 0.5 AND y < 9) FROM t",
    "source_text": _VIEW,
    "source_viswalk": _VIEW,
    "source_pathfinder_csv": _VIEW,
    "source_crowdit": _VIEW,
    "source_pathfinder_json": _VIEW,
    "source_vadere": SQL + f", n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM t WINDOW w AS (PARTITION BY id ORDER BY frame)) SELECT id, 2 * frame AS frame, {R('x')} AS x, {R('y')} AS y FROM n UNION ALL SELECT id, 2 * frame + 1, {R('(x + x1) / 2')}, {R('(y + y1) / 2')} FROM n WHERE x1 IS NOT NULL",
    "step_quantiles": SQL + f", st AS (SELECT sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM t WINDOW w AS (PARTITION BY id ORDER BY frame)) SELECT share, {R('step')} AS step FROM (SELECT unnest([0.0, 0.01, 0.5, 0.99, 1.0]::DOUBLE[]) AS share, unnest(quantile_cont(step, [0.0, 0.01, 0.5, 0.99, 1.0])) AS step FROM st)",
    "live_stay_intervals": SQL + STAYS.format(inside=INSIDE) + " SELECT id, entering_frame, leaving_frame FROM stay",
    "live_crossings": SQL + CROSS + " SELECT id, frame FROM c",
    "live_first_crossings": SQL + NT + " SELECT id, frame FROM f",
    "live_n_t": SQL + NT + f" SELECT frame, n AS cumulative_pedestrians, {R('frame / 10.0')} AS time FROM nt WHERE frame BETWEEN (SELECT min(frame) FROM f) AND (SELECT max(frame) FROM f)",
    "rset_map_max": _RSET("max"),
    "rset_map_min": _RSET("min"),
    "rset_map_mean": _RSET("avg"),
}
# a cutoff leaves what is nearer as it is
ORACLES["pair_histogram_cutoff"] = ORACLES["pair_histogram"].replace(" GROUP BY 1", f" AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {PAIR_CUTOFF} GROUP BY 1")
ORACLES["pair_distribution_cutoff"] = f"SELECT * FROM ({ORACLES['pair_distribution_function']}) WHERE r <= {PAIR_CUTOFF}"
