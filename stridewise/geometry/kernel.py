"""Batch kernels in numpy: Voronoi cells, their pieces in an area, distances of cells."""

from __future__ import annotations

import numpy as np

from stridewise.errors import GeometryError

#: Cells that are cut together, of one frame or many, and pairs of cells that are compared together.
BATCH = 8192
#: Numbers in a table of the bins around points, about; a crowded bin makes its rows long.
TABLE = 1 << 22
#: Points of a bin, about; points that are few enough for a single bin; bins to each side that are looked through first.
PER_BIN, FEW_POINTS, FIRST_RADIUS = 2.0, 24, 2
#: Bisectors that cut each cell in turn; then, that are looked at together for the next one that cuts.
FIRST_CUTS, LOOK = 12, 16
#: A cell nearer to a bisector than this may touch the one behind it.
REACHES = 1e-7


def clip_many(px: np.ndarray, py: np.ndarray, count: np.ndarray, a, b, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each convex polygon (a row of padded corners) by its own half-plane a x + b y <= c."""
    n, width = px.shape
    at = np.arange(width)
    valid = at < count[:, None]
    following = np.where(at + 1 < count[:, None], at + 1, 0)
    a, b, c = (np.broadcast_to(np.asarray(v, float), (n,))[:, None] for v in (a, b, c))
    d = a * px + b * py - c
    inside = (d <= 0) & valid
    if inside.sum() == valid.sum():
        return px, py, count
    nx, ny, nd = (np.take_along_axis(v, following, 1) for v in (px, py, d))
    cut = valid & ((d <= 0) != (nd <= 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(cut, d / np.where(cut, d - nd, 1), 0)
    both_x, both_y, keep = np.empty((n, 2 * width)), np.empty((n, 2 * width)), np.zeros((n, 2 * width), bool)
    both_x[:, 0::2], both_x[:, 1::2] = px, px + t * (nx - px)
    both_y[:, 0::2], both_y[:, 1::2] = py, py + t * (ny - py)
    keep[:, 0::2], keep[:, 1::2] = inside, cut
    new_count = keep.sum(axis=1)
    new_width = max(3, int(new_count.max(initial=0)))
    row, column = np.nonzero(keep)
    place = (np.cumsum(keep, axis=1) - 1)[row, column]
    out_x, out_y = np.zeros((n, new_width)), np.zeros((n, new_width))
    out_x[row, place], out_y[row, place] = both_x[row, column], both_y[row, column]
    return out_x, out_y, new_count


def _padded(target: np.ndarray, width: int) -> np.ndarray:
    return target if target.shape[1] >= width else np.pad(target, ((0, 0), (0, width - target.shape[1])))


def areas(px: np.ndarray, py: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Shoelace areas of padded polygons."""
    at = np.arange(px.shape[1])
    valid = at < count[:, None]
    following = np.where(at + 1 < count[:, None], at + 1, 0)
    x, y = px - px[:, :1], py - py[:, :1]
    nx, ny = np.take_along_axis(x, following, 1), np.take_along_axis(y, following, 1)
    return np.abs(np.where(valid, x * ny - nx * y, 0).sum(axis=1)) / 2


class Bins:
    """Points of frames in square bins, those of a row of bins side by side; each frame has bins of its own, one frame's behind the other's.

    starts: where frames begin among the points, and their end.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray):
        self.x, self.y = x, y
        count = np.diff(starts)
        low = lambda v: np.minimum.reduceat(v, starts[:-1])
        x0, y0 = low(x), low(y)
        wide, high = -low(-x) - x0, -low(-y) - y0
        many = count / PER_BIN
        # of points on a line, bins along it
        size = np.where(count > FEW_POINTS, np.maximum(np.sqrt(wide * high / many), np.maximum(wide, high) / many), 0.0)
        size = np.where(size > 0, size, np.maximum(np.maximum(wide, high), 1.0) * 2)
        nx, ny = (wide / size).astype(np.int64) + 1, (high / size).astype(np.int64) + 1
        ends = np.cumsum(nx * ny)
        each = lambda v: np.repeat(v, count)
        self.x0, self.y0, self.size, self.nx, self.ny, self.base = map(each, (x0, y0, size, nx, ny, ends - nx * ny))
        self.bx = np.minimum(((x - self.x0) / self.size).astype(np.int64), self.nx - 1)
        self.by = np.minimum(((y - self.y0) / self.size).astype(np.int64), self.ny - 1)
        flat = self.base + self.by * self.nx + self.bx
        self.order = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[self.order], np.arange(ends[-1] + 1))

    def around(self, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For points ``at``: points in bins up to ``radius`` off, nearest first, their squared distances, and the distance up to which all are there.

        Rows are filled up with infinite distances; a point itself and those at its place have them, too.
        """
        bx, by, nx, ny = self.bx[at], self.by[at], self.nx[at], self.ny[at]
        low, high = np.maximum(bx - radius, 0), np.minimum(bx + radius, nx - 1)
        rows = by[:, None] + np.arange(-radius, radius + 1)
        inside = (rows >= 0) & (rows < ny[:, None])
        base = self.base[at][:, None] + np.where(inside, rows, 0) * nx[:, None]
        first, last = self.starts[base + low[:, None]], self.starts[base + high[:, None] + 1]
        counts = np.where(inside, last - first, 0)
        total = counts.sum(axis=1)
        width = int(total.max(initial=1))
        order, square = np.zeros((len(at), width), np.int64), np.full((len(at), width), np.inf)
        flat = counts.ravel()
        run = np.repeat(np.cumsum(flat) - flat, flat)
        place = np.arange(flat.sum()) - run + np.repeat(first.ravel(), flat)
        row = np.repeat(np.arange(len(at)), total)
        column = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
        found = self.order[place]
        d = (self.x[found] - self.x[at][row]) ** 2 + (self.y[found] - self.y[at][row]) ** 2
        order[row, column], square[row, column] = found, np.where(d > 0, d, np.inf)
        sorting = np.argsort(square, axis=1, kind="stable")
        gap = lambda edge, open_: np.where(open_, edge, np.inf)
        x, y, s = self.x[at] - self.x0[at], self.y[at] - self.y0[at], self.size[at]
        edges = (
            gap(x - (bx - radius) * s, bx - radius > 0), gap((bx + radius + 1) * s - x, bx + radius < nx - 1),
            gap(y - (by - radius) * s, by - radius > 0), gap((by + radius + 1) * s - y, by + radius < ny - 1),
        )
        return np.take_along_axis(order, sorting, 1), np.take_along_axis(square, sorting, 1), np.minimum.reduce(edges)


def voronoi(x: np.ndarray, y: np.ndarray, box, corners=None, pairs: list | None = None, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the points of one or more frames inside a box, as padded polygons.

    Each cell is cut by the bisectors to its neighbours, the nearest first,
    and is done when the next one lies further off than twice its farthest
    corner. Neighbours come from the bins around a point, further ones only
    for cells that reach so far. box: left, low, right and high, a number each
    or one for each frame. corners: of a polygon around each point that limits
    its cell. pairs: gets (i, j), i < j, of all points whose cells may touch:
    one of them reaches the bisector between both, or both are at one place.
    starts: where frames begin, and their end; without it, all is one frame.
    """
    n = len(x)
    starts = np.array([0, n]) if starts is None else starts
    bins = Bins(x, y, starts)
    frame = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    box = [np.broadcast_to(np.asarray(v, float), len(starts) - 1)[frame] for v in box]
    most = int(np.diff(bins.starts).max()) * (2 * FIRST_RADIUS + 1) ** 2
    step = max(BATCH // 16, min(BATCH, TABLE // most))
    found = [_voronoi_rows(bins, np.arange(lo, min(n, lo + step)), [v[lo : lo + step] for v in box], corners, pairs) for lo in range(0, n, step)]
    width = max(f[0].shape[1] for f in found)
    if pairs is not None:
        together = _same_place(x, y, frame)
        own = np.concatenate([*(p for p, _ in pairs), together[0]])
        other = np.concatenate([*(p for _, p in pairs), together[1]])
        both = np.unique(np.minimum(own, other) * n + np.maximum(own, other))
        pairs[:] = [(both // n, both % n)]
    return tuple(np.concatenate([_padded(f[i], width) for f in found]) for i in (0, 1)) + (np.concatenate([f[2] for f in found]),)


def _same_place(x: np.ndarray, y: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((y, x, frame))
    fresh = np.ones(len(x), bool)
    fresh[1:] = np.any([v[order][1:] != v[order][:-1] for v in (x, y, frame)], axis=0)
    ends = np.append(np.flatnonzero(fresh), len(x))
    groups = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True) if b - a > 1]
    made = [np.triu_indices(len(g), 1) for g in groups]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(g[i] for g, (i, _) in zip(groups, made, strict=True))]), np.concatenate([none, *(g[j] for g, (_, j) in zip(groups, made, strict=True))])


def _bisectors(x: np.ndarray, y: np.ndarray, own_x: np.ndarray, own_y: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-planes a x + b y <= c of what is nearer to own places than to other points."""
    return x[other] - own_x, y[other] - own_y, (x[other] ** 2 - own_x**2 + y[other] ** 2 - own_y**2) / 2


def _voronoi_rows(bins: Bins, at: np.ndarray, box, corners, pairs: list | None):
    x, y = bins.x, bins.y
    own_x, own_y = x[at], y[at]
    m = len(at)
    left, low, right, high = box
    px = np.stack([left, right, right, left], axis=1)
    py = np.stack([low, low, high, high], axis=1)
    count = np.full(m, 4)
    if corners is not None:
        for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
            a, b = by - ay, ax - bx
            px, py, count = clip_many(px, py, count, np.full(m, a), np.full(m, b), a * (ax + own_x) + b * (ay + own_y))

    def reach(cells: np.ndarray) -> np.ndarray:
        corner = np.arange(px.shape[1]) < count[cells, None]
        return np.where(corner, (px[cells] - own_x[cells, None]) ** 2 + (py[cells] - own_y[cells, None]) ** 2, 0).max(axis=1) * (1 + 1e-9)

    met: list[tuple[np.ndarray, np.ndarray]] = []
    left_over, done_to, radius = np.arange(m), np.zeros(m), FIRST_RADIUS
    while len(left_over):
        order, square, limit = bins.around(at[left_over], radius)
        # what has been cut before is passed over; beyond the limit, nearer points may be missing
        k = (square <= (done_to[left_over] ** 2)[:, None]).sum(axis=1)
        end = (square <= (limit**2)[:, None]).sum(axis=1)
        end = np.where(np.isinf(limit), np.isfinite(square).sum(axis=1), end)
        row, turn = np.arange(len(left_over)), 0
        while len(row):
            row = row[k[row] < end[row]]
            cells = left_over[row]
            most = 4 * reach(cells)
            row, cells, most = (v[square[row, k[row]] <= most] for v in (row, cells, most))
            if not len(row):
                break
            if turn >= FIRST_CUTS:
                # the nearest points have cut; of those behind them few do, and a cell that shrinks is never cut by one that misses it now
                at_k = k[row][:, None] + np.arange(LOOK)
                inside = at_k < end[row][:, None]
                at_k = np.minimum(at_k, order.shape[1] - 1)
                inside &= square[row[:, None], at_k] <= most[:, None]
                other = order[row[:, None], at_k]
                a, b, c = _bisectors(x, y, own_x[cells][:, None], own_y[cells][:, None], other)
                corner = np.arange(px.shape[1]) < count[cells, None]
                off = np.full(a.shape, -np.inf)
                for i in range(int(count[cells].max())):
                    d = a * px[cells, i][:, None] + b * py[cells, i][:, None] - c
                    np.maximum(off, d, out=off, where=corner[:, i][:, None])
                cuts = inside & (off > 0)
                ahead = np.where(cuts.any(axis=1), cuts.argmax(axis=1), inside.sum(axis=1))
                if pairs is not None:
                    passed = inside & (np.arange(LOOK) < ahead[:, None]) & (off >= -2 * REACHES * np.hypot(a, b))
                    met.append((np.broadcast_to(cells[:, None], passed.shape)[passed], other[passed]))
                k[row] += ahead
                has = cuts.any(axis=1)
                cut, row = row[has], row[has | inside.all(axis=1)]
            else:
                cut = row
            if len(cut):
                cells, other = left_over[cut], order[cut, k[cut]]
                a, b, c = _bisectors(x, y, own_x[cells], own_y[cells], other)
                qx, qy, q = clip_many(px[cells], py[cells], count[cells], a, b, c)
                width = max(px.shape[1], qx.shape[1])
                px, py = _padded(px, width), _padded(py, width)
                px[cells, : qx.shape[1]], py[cells, : qy.shape[1]] = qx, qy
                count[cells] = q
                k[cut] += 1
                if pairs is not None:
                    met.append((cells, other))
            turn += 1
        done_to[left_over] = limit
        left_over = left_over[(limit**2 < 4 * reach(left_over)) & np.isfinite(limit)]
        radius *= 2
    if pairs is not None and met:
        cells, other = (np.concatenate(c) for c in zip(*met, strict=True))
        a, b = x[other] - own_x[cells], y[other] - own_y[cells]
        far = np.hypot(a, b)
        corner = np.arange(px.shape[1]) < count[cells, None]
        # how far corners are from the bisector, on the point's own side
        off = ((px[cells] - ((own_x[cells] + x[other]) / 2)[:, None]) * a[:, None] + (py[cells] - ((own_y[cells] + y[other]) / 2)[:, None]) * b[:, None]) / far[:, None]
        near = np.where(corner, off, -np.inf).max(axis=1) >= -REACHES
        pairs.append((at[cells[near]], other[near]))
    return px, py, count


def in_piece(x: np.ndarray, y: np.ndarray, piece) -> np.ndarray:
    """Points inside or on a counter-clockwise convex piece."""
    inside = np.ones(len(x), bool)
    for (ax, ay), (bx, by) in zip(piece, [*piece[1:], piece[0]], strict=True):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12
    return inside


def adjacency(pieces) -> list[tuple[int, int, float, float, float]]:
    """(i, j, x, y low, y high) of vertical borders that slabs' pieces share."""
    out = []
    for i, p in enumerate(pieces):
        for j, q in enumerate(pieces):
            x = max(v[0] for v in p)
            if i == j or abs(x - min(v[0] for v in q)) > 1e-10:
                continue
            mine = [v[1] for v in p if abs(v[0] - x) <= 1e-10]
            theirs = [v[1] for v in q if abs(v[0] - x) <= 1e-10]
            low, high = max(min(mine), min(theirs)), min(max(mine), max(theirs))
            if high - low > 1e-10:
                out.append((i, j, x, low, high))
    return out


def in_convex(px: np.ndarray, py: np.ndarray, count: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded polygons cut by a counter-clockwise convex piece; those without an area have no corner."""
    for (ax, ay), (bx, by) in zip(piece, [*piece[1:], piece[0]], strict=True):
        a, b = by - ay, ax - bx
        px, py, count = clip_many(px, py, count, a, b, a * ax + b * ay)
    return px, py, np.where((count > 2) & (areas(px, py, count) > 1e-14), count, 0)


def cells_in_area(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, count: np.ndarray, pieces, borders) -> list[list[np.ndarray]]:
    """For each cell, its convex pieces inside the area; of parts that do not touch, the one around the point.

    A point outside the area has none of the parts for its own, which is an
    error if there are several.
    """
    n = len(x)
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
    for k, piece in enumerate(pieces):
        qx, qy, q = in_convex(px, py, count, piece)
        for i in np.flatnonzero(q).tolist():
            found[i].append((k, np.stack([qx[i, : q[i]], qy[i, : q[i]]], axis=1)))
    if len(pieces) == 1:
        return [[p for _, p in f] for f in found]
    home = np.full(n, -1)
    for k, piece in enumerate(pieces):
        home = np.where((home < 0) & in_piece(x, y, piece), k, home)
    return [_around(f, int(home[i]), borders) if len(f) > 1 else [p for _, p in f] for i, f in enumerate(found)]


def _around(parts: list[tuple[int, np.ndarray]], home: int, borders) -> list[np.ndarray]:
    """The parts that hang together with the one in piece ``home``."""
    have = {k: p for k, p in parts}
    links: dict[int, set[int]] = {}
    for i, j, x, low, high in borders:
        if i in have and j in have:
            mine = have[i][np.abs(have[i][:, 0] - x) <= 1e-9][:, 1]
            theirs = have[j][np.abs(have[j][:, 0] - x) <= 1e-9][:, 1]
            if len(mine) > 1 and len(theirs) > 1 and min(mine.max(), theirs.max(), high) - max(mine.min(), theirs.min(), low) > 1e-10:
                links.setdefault(i, set()).add(j)
                links.setdefault(j, set()).add(i)
    outside = home not in have
    reached = {next(iter(have)) if outside else home}
    queue = list(reached)
    while queue:
        for j in links.get(queue.pop(), ()):
            if j not in reached:
                reached.add(j)
                queue.append(j)
    if outside and len(reached) < len(have):
        raise GeometryError("a cell has several parts in the walkable area and its pedestrian is in none of them")
    return [have[k] for k in sorted(reached)]


def _edges(cells: list[list[np.ndarray]]) -> np.ndarray:
    """Edges (x0, y0, x1, y1) of each cell, as many for each: short lists repeat their first edge."""
    own = [np.concatenate([np.concatenate([p, np.roll(p, -1, axis=0)], axis=1) for p in c]) for c in cells]
    out = np.empty((len(own), max(map(len, own)), 4))
    for i, e in enumerate(own):
        out[i, : len(e)] = e
        out[i, len(e) :] = e[0]
    return out


def _nearest(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Least squared distance from the starts of edges e to edges f, for each pair of cells."""
    x, y = e[:, :, None, 0] - f[:, None, :, 0], e[:, :, None, 1] - f[:, None, :, 1]
    dx, dy = (f[:, :, 2] - f[:, :, 0])[:, None, :], (f[:, :, 3] - f[:, :, 1])[:, None, :]
    t = np.clip((x * dx + y * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
    return ((x - t * dx) ** 2 + (y - t * dy) ** 2).min(axis=(1, 2))


def padded_edges(px: np.ndarray, py: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Edges (x0, y0, x1, y1) of padded polygons; short ones repeat their first edge."""
    at = np.arange(px.shape[1])
    own = np.where(at < count[:, None], at, 0)
    following = np.where(own + 1 < count[:, None], own + 1, 0)
    return np.stack([np.take_along_axis(v, i, 1) for i in (own, following) for v in (px, py)], axis=2)


def touching_padded(px: np.ndarray, py: np.ndarray, count: np.ndarray, distance: float, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of cells that may touch, those that come as near as ``distance``; cells are padded polygons, no corners: no cell."""
    some = (count[pairs[0]] > 0) & (count[pairs[1]] > 0)
    own, other = pairs[0][some], pairs[1][some]
    near = _close(padded_edges(px, py, count), own, other, distance)
    return own[near], other[near]


def _close(edges: np.ndarray, own: np.ndarray, other: np.ndarray, distance: float) -> np.ndarray:
    near = np.zeros(len(own), bool)
    for lo in range(0, len(own), BATCH):
        e, f = edges[own[lo : lo + BATCH]], edges[other[lo : lo + BATCH]]
        found = _corners_meet(e, f, distance)
        rest = np.flatnonzero(~found)
        # of two outlines that do not cross, the nearest points include a corner of one
        found[rest] = np.minimum(_nearest(e[rest], f[rest]), _nearest(f[rest], e[rest])) <= distance * distance
        near[lo : lo + BATCH] = found
    return near


def _corners_meet(e: np.ndarray, f: np.ndarray, distance: float) -> np.ndarray:
    """Whether two cells have corners within ``distance``, as most cells that touch do: they share the ends of their border."""
    found = np.zeros(len(e), bool)
    for i in range(e.shape[1]):
        left = np.flatnonzero(~found)
        if not len(left):
            break
        x, y = e[left, i, 0][:, None] - f[left, :, 0], e[left, i, 1][:, None] - f[left, :, 1]
        found[left] = (x * x + y * y <= distance * distance).any(axis=1)
    return found


def touching(cells: list[list[np.ndarray]], distance: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of a frame's cells that come as near as ``distance``; cells do not overlap unless they are the same.

    pairs: those that may touch; else boxes around all cells are compared.
    """
    at = [i for i, c in enumerate(cells) if c]
    if len(at) < 2:
        return []
    edges = _edges([cells[i] for i in at])
    if pairs is None:
        found = list(_near_boxes(edges, distance))
        own, other = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    else:
        place = np.full(len(cells), -1)
        place[at] = np.arange(len(at))
        own, other = place[pairs[0]], place[pairs[1]]
        own, other = own[(own >= 0) & (other >= 0)], other[(own >= 0) & (other >= 0)]
    near = _close(edges, own, other, distance)
    names = np.array(at)
    return list(zip(names[own[near]].tolist(), names[other[near]].tolist(), strict=True))


def _near_boxes(edges: np.ndarray, distance: float):
    low, high = edges[:, :, :2].min(axis=1), edges[:, :, :2].max(axis=1)
    for i in range(len(edges) - 1):
        j = i + 1 + np.flatnonzero((low[i] <= high[i + 1 :] + distance).all(axis=1) & (low[i + 1 :] <= high[i] + distance).all(axis=1))
        if len(j):
            yield np.full(len(j), i), j
