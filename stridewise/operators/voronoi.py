"""Voronoi cells of pedestrians, their neighbourhoods and distances."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.errors import ArgumentValueError
from stridewise.geometry import exprs, kernel, shapes
from stridewise.model import Cutoff, TrajectoryData, WalkableArea, check_trajectory
from stridewise.shipping import partitions, ship

#: Cells nearer than this are neighbours.
CONTACT = 1e-9

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PIECES = pa.list_(pa.list_(_POINT))


def _nested(cells: list[list[np.ndarray]]) -> pa.Array:
    """Cells as an Arrow array of lists of polygons."""
    pieces = [p for cell in cells for p in cell]
    corners = np.concatenate(pieces) if pieces else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], fields=list(_POINT))
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pieces)]), pa.int32()), points)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), inner)


def _padded_nested(px: np.ndarray, py: np.ndarray, count: np.ndarray) -> pa.Array:
    """Padded polygons as an Arrow array of lists of one polygon, or of none if they have no corner."""
    corner = np.arange(px.shape[1]) < count[:, None]
    points = pa.StructArray.from_arrays([pa.array(px[corner]), pa.array(py[corner])], fields=list(_POINT))
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[count > 0])]), pa.int32()), points)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count > 0)]), pa.int32()), inner)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of an Arrow array of cells as padded polygons, and the place of each one's cell."""
    inner = column.flatten()
    points = inner.flatten()
    count = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    corner = np.arange(max(3, int(count.max(initial=0)))) < count[:, None]
    out = []
    for axis in (0, 1):
        filled = np.zeros(corner.shape)
        filled[corner] = points.field(axis).to_numpy(zero_copy_only=False)
        out.append(filled)
    pieces = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return *out, count, np.repeat(np.arange(len(column)), pieces)


def sizes(column: pa.Array) -> np.ndarray:
    """Areas of the cells in an Arrow array."""
    px, py, count, owner = padded(column)
    return np.bincount(owner, kernel.areas(px, py, count), len(column))


def _cells(column: pa.Array) -> list[list[np.ndarray]]:
    inner = column.flatten()
    points = inner.flatten()
    corners = np.stack([points.field(0).to_numpy(zero_copy_only=False), points.field(1).to_numpy(zero_copy_only=False)], axis=1)
    ends = np.cumsum(np.concatenate([[0], inner.value_lengths().to_numpy(zero_copy_only=False)]))
    pieces = [corners[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    outer = np.cumsum(np.concatenate([[0], column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))
    return [pieces[a:b] for a, b in zip(outer[:-1], outer[1:], strict=True)]


def by_frame(batches, frame_column: int):
    """Whole frames of batches that are sorted by frame: tables of one or more frames each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        frames = batch.column(frame_column).to_numpy()
        if held and frames[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        last = frames[-1]
        start = int(np.searchsorted(frames, last, side="left"))
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def individual_voronoi_polygons(
    traj_data: TrajectoryData, walkable_area: WalkableArea, cut_off: Cutoff | None = None, use_blind_points: bool | None = None, with_neighbors: bool = False,
    carried: tuple[str, ...] = (), with_distances: bool = False,
) -> DataFrame:
    """id, frame, polygon (convex pieces), density (1 / area) and, on demand, neighbors (sorted ids of cells that touch it) and distances (to those, in that order).

    carried: further columns of the trajectory's rows that their cells keep, which saves a join with cells, wide as they are.

    Frames are dealt to tasks by hash and computed many at a time; a frame is
    one task's, as its cells depend on each other. Pedestrians at one place
    of a frame share one cell's bounds. Neighbours come from the bisectors
    that cells end at, in the same pass.
    """
    check_trajectory(traj_data)
    with_neighbors = with_neighbors or with_distances
    if use_blind_points is not None:
        warnings.warn("use_blind_points has no effect: cells of any number of pedestrians are computed", DeprecationWarning, stacklevel=2)
    ship(traj_data.data.sparkSession)
    left, low, right, high = walkable_area.bounds
    pieces = [p if shapes.signed_area(p) > 0 else p[::-1] for p in walkable_area.pieces]
    borders = kernel.adjacency(pieces) if len(pieces) > 1 else []
    corners = list(cut_off.corners) if cut_off else None

    def run(batches):
        for table in by_frame(batches, 1):
            ids, frames, xs, ys = (table.column(i).to_numpy() for i in range(4))
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(frames)) + 1, [len(frames)]])
            # what lies outside the area's box is cut off anyway; it grows for pedestrians out there alone
            of = lambda fold, v, edge: fold(fold.reduceat(v, bounds[:-1]), edge)
            box = (of(np.minimum, xs, left), of(np.minimum, ys, low), of(np.maximum, xs, right), of(np.maximum, ys, high))
            pairs: list | None = [] if with_neighbors else None
            px, py, count = kernel.voronoi(xs, ys, box, corners, pairs, bounds)
            if len(pieces) == 1:
                px, py, count = kernel.in_convex(px, py, count, pieces[0])
                nested = _padded_nested(px, py, count)
            else:
                cells = kernel.cells_in_area(xs, ys, px, py, count, pieces, borders)
                nested = _nested(cells)
            with np.errstate(divide="ignore"):
                density = 1.0 / sizes(nested)
            columns = {"id": pa.array(ids), "frame": pa.array(frames), "polygon": nested, "density": pa.array(density)}
            if with_neighbors:
                if len(pieces) == 1:
                    found = kernel.touching_padded(px, py, count, CONTACT, pairs[0])
                else:
                    found = np.array(kernel.touching(cells, CONTACT, pairs[0]), np.int64).reshape(-1, 2).T
                columns["neighbors"], *apart = _near_ids(ids, *found, xs, ys) if with_distances else (_near_ids(ids, *found),)
                if apart:
                    columns["distances"] = apart[0]
            for i, name in enumerate(carried):
                columns[name] = table.column(4 + i).combine_chunks()
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = traj_data.data.select("id", "frame", "x", "y", *carried).where("x is not null and y is not null")
    kinds = "".join(f", `{name}` {kind}" for name, kind in rows.dtypes[4:])
    rows = rows.repartition(partitions(rows), "frame").sortWithinPartitions("frame", "id")
    return rows.mapInArrow(run, f"id long, frame long, polygon {exprs.PIECES}, density double" + ", neighbors array<bigint>" * with_neighbors + ", distances array<double>" * with_distances + kinds)


def _near_ids(ids: np.ndarray, own: np.ndarray, other: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None):
    """Sorted ids of the cells that touch each cell, by the pairs of places of those that do; with places x and y, also how far off they are."""
    row, at = np.concatenate([own, other]), np.concatenate([other, own])
    near = ids[at]
    order = np.lexsort((near, row))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))]), pa.int32())
    found = pa.ListArray.from_arrays(offsets, pa.array(near[order], pa.int64()))
    if x is None:
        return found
    row, at = row[order], at[order]
    dx, dy = x[row] - x[at], y[row] - y[at]
    return found, pa.ListArray.from_arrays(offsets, pa.array(np.sqrt(dx * dx + dy * dy)))


def neighbors(individual_voronoi_data: DataFrame, as_list: bool = True) -> DataFrame:
    """Cells that touch in a frame: (id, frame, neighbors) or, long, (id, frame, neighbor_id).

    Taken from the cells' column ``neighbors`` if they were computed with it;
    else cells are dealt by frame once more and compared. Of cells that were
    computed with distances, the long form has a column ``distance``, too.
    """
    ship(individual_voronoi_data.sparkSession)
    if as_list:
        warnings.warn("lists of neighbours are deprecated; as_list=False gives rows", DeprecationWarning, stacklevel=2)
    if "distances" in individual_voronoi_data.columns and not as_list:
        pairs = F.arrays_zip("neighbors", "distances")
        return individual_voronoi_data.select("id", "frame", F.inline(pairs).alias("neighbor_id", "distance"))
    if "neighbors" in individual_voronoi_data.columns:
        found = individual_voronoi_data.select("id", "frame", "neighbors")
        return found if as_list else found.select("id", "frame", F.explode("neighbors").alias("neighbor_id"))

    def run(batches):
        for table in by_frame(batches, 1):
            ids, frames = table.column(0).to_numpy(), table.column(1).to_numpy()
            cells = _cells(table.column(2).combine_chunks())
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(frames)) + 1, [len(frames)]])
            own, other, at = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for i, j in kernel.touching(cells[a:b], CONTACT):
                    own += [ids[a + i], ids[a + j]]
                    other += [ids[a + j], ids[a + i]]
                    at += [frames[a], frames[a]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(at, pa.int64()), pa.array(other, pa.int64())], names=["id", "frame", "neighbor_id"])

    rows = individual_voronoi_data.select("id", "frame", "polygon")
    rows = rows.repartition(partitions(rows), "frame").sortWithinPartitions("frame", "id")
    pairs = rows.mapInArrow(run, "id long, frame long, neighbor_id long")
    if not as_list:
        return pairs
    lists = pairs.groupBy("id", "frame").agg(F.sort_array(F.collect_list("neighbor_id")).alias("neighbors"))
    none = F.array().cast("array<bigint>")
    return individual_voronoi_data.select("id", "frame").join(lists, ["id", "frame"], "left").select("id", "frame", F.coalesce("neighbors", none).alias("neighbors"))


def neighbor_distance(traj_data: TrajectoryData, neighborhood: DataFrame) -> DataFrame:
    """id, frame, neighbor_id, distance for the long form of a neighbourhood.

    Neighbours of cells that were computed with distances have them already:
    those of the positions that the cells were made of.
    """
    check_trajectory(traj_data)
    if "neighbor_id" not in neighborhood.columns:
        raise ArgumentValueError("distances need neighbours as rows; compute them with as_list=False")
    if "distance" in neighborhood.columns:
        return neighborhood.select("id", "frame", "neighbor_id", "distance")
    place = traj_data.data.select("id", "frame", "x", "y")
    other = place.select(F.col("id").alias("neighbor_id"), "frame", F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    joined = neighborhood.select("id", "frame", "neighbor_id").join(place, ["id", "frame"], "left").join(other, ["neighbor_id", "frame"])
    return joined.select("id", "frame", "neighbor_id", F.sqrt(dx * dx + dy * dy).alias("distance"))
