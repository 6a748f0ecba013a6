"""Balanced shards by histogram sort.

Rows are sorted by the hash of their text, then by that of their other columns,
so that equal texts lie side by side. Boundaries between shards are searched by
counting: each pass sums the exact bytes of the rows between candidate
boundaries, and only ranges that still hold an unsettled boundary are split
further, until every boundary is within a tolerance of its target or between
two rows. Then the rows are exchanged once, straight to their places.

Long texts are placed first. What they leave uneven is filled up by shorter
ones, whose boundaries are searched against what is left to fill.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridewise.llm.common import materialize, release
from stridewise.shared import shared_dir

#: Bytes that a row counts beside those of its text.
ROW_BYTES = 16
#: Bytes of an exchanged partition, about; a shard is cut into as many as it needs, all in order.
PART_BYTES = 128 << 20
#: Rows longer than a partition's share over each of these are placed in passes of their own, longest first.
LONG_SHARES = (16, 64, 256)
#: A boundary is settled within this share of a partition's bytes.
TOLERANCE = 1e-3
#: Candidate boundaries that a pass counts at most, and bits that a pass splits a range by at most.
MOST_PROBES, MOST_BITS = 1 << 18, 12

_BITS, _LOWEST = 64, -(1 << 63)


@dataclass
class Cut:
    """Where the rows below end: those whose key is below, and of those with this very key a share."""

    first: int
    second: int = _LOWEST
    share: float = 0.0
    below: float = 0.0


@dataclass
class _Open:
    """A target that is looked for inside one range of keys; below: bytes of the group before that range."""

    target: float
    group: int
    below: float
    bytes: int = 0
    rows: int = 0
    low: int = 0
    high: int = 0


def _counts(rows: DataFrame, ranges: list[tuple[int, int]] | None, depth: int, bits: int) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
    """By range (group, leading bits): bytes, rows, least and largest key of its parts, in the order of keys.

    rows: group, key, size. ranges: those to look at, None for all.
    """
    if ranges is not None:
        wanted = rows.sparkSession.createDataFrame(ranges, "`group` long, `range` long")
        # at most one row for each boundary
        rows = rows.withColumn("range", F.shiftright("key", _BITS - depth)).join(F.broadcast(wanted), ["group", "range"])
    else:
        rows = rows.withColumn("range", F.lit(0).cast("long"))
    part = F.shiftright("key", _BITS - depth - bits).alias("part")
    found = rows.groupBy("group", "range", part).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    table = found.toPandas().sort_values(["group", "range", "part"])
    return {key: tuple(own[c].to_numpy() for c in ("bytes", "rows", "low", "high")) for key, own in table.groupby(["group", "range"], sort=False)}


def _narrow(rows: DataFrame, wanted: list[tuple[int, float]], tolerance: float) -> tuple[dict[int, tuple[int, float]], dict[int, _Open]]:
    """For each (group, bytes below within it): a key with its exact bytes below, or the one key whose rows hold the target.

    Targets are told by their place in ``wanted``.
    """
    cuts: dict[int, tuple[int, float]] = {}
    stuck: dict[int, _Open] = {}
    active = {k: _Open(target, group, 0.0) for k, (group, target) in enumerate(wanted)}
    depth = 0
    while active:
        ranges = None if not depth and len({a.group for a in active.values()}) == 1 else sorted({(a.group, a.low >> (_BITS - depth) if depth else 0) for a in active.values()})
        bits = max(1, min(MOST_BITS, _BITS - depth, int(math.log2(MOST_PROBES / max(1, len(ranges or [0]))))))
        if ranges is not None and not depth:
            # no leading bits yet: the groups alone tell what to look at
            held = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(g,) for g, _ in ranges], "`group` long")), "group")
            counted = _counts(held, None, 0, bits)
        else:
            counted = _counts(rows, ranges, depth, bits)
        ends = {key: np.concatenate([[0], np.cumsum(own[0])]) for key, own in counted.items()}
        still = {}
        for k, a in active.items():
            key = (a.group, a.low >> (_BITS - depth) if depth else 0)
            if key not in counted:  # no rows at all
                cuts[k] = (_LOWEST, 0.0)
                continue
            sizes, counts, low, high = counted[key]
            end = ends[key]
            inside = a.target - a.below
            at = int(np.clip(np.searchsorted(end, inside, side="right") - 1, 0, len(sizes) - 1))
            near = at if inside - end[at] <= end[at + 1] - inside else at + 1
            if abs(end[near] - inside) <= tolerance or (counts[at] == 1 and low[at] == high[at]):
                # all keys of the parts before are below the first one of the next part
                cuts[k] = (int(low[near]) if near < len(low) else min(int(high[near - 1]) + 1, -_LOWEST - 1), a.below + float(end[near]))
                continue
            found = _Open(a.target, a.group, a.below + float(end[at]), int(sizes[at]), int(counts[at]), int(low[at]), int(high[at]))
            (stuck if low[at] == high[at] else still)[k] = found
        active = still
        depth += bits
    return cuts, stuck


def splitters(rows: DataFrame, targets: list[float], tolerance: float) -> list[Cut]:
    """For each number of bytes (rising) a boundary with about as many below it; rows: first, second (keys) and size.

    Off by the tolerance or half a row at most; rows that agree in both keys
    are cut by a share of them.
    """
    order = list(range(len(targets)))
    outer = rows.select(F.lit(0).cast("long").alias("group"), F.col("first").alias("key"), "size")
    cuts, stuck = _narrow(outer, [(0, targets[k]) for k in order], tolerance)
    found = {k: Cut(key, below=below) for k, (key, below) in cuts.items()}
    if stuck:
        places = list(stuck)
        inner = rows.select(F.col("first").alias("group"), F.col("second").alias("key"), "size")
        cuts, same = _narrow(inner, [(stuck[k].low, stuck[k].target - stuck[k].below) for k in places], tolerance)
        for j, (key, below) in cuts.items():
            own = stuck[places[j]]
            found[places[j]] = Cut(own.low, key, below=own.below + below)
        for j, deep in same.items():
            own = stuck[places[j]]
            share = (deep.target - deep.below) / deep.bytes
            found[places[j]] = Cut(own.low, deep.low, share, own.below + deep.target)
    return [found[k] for k in order]


def fill(loads: np.ndarray, total: float) -> np.ndarray:
    """What each place takes of the total so that the least filled ones come level."""
    if not total:
        return np.zeros(len(loads))
    rising = np.sort(loads)
    room = np.arange(1, len(loads) + 1) * np.append(rising[1:], np.inf) - np.cumsum(rising)
    n = int(np.searchsorted(room, total)) + 1
    return np.maximum(0.0, (total + rising[:n].sum()) / n - loads)


def _places(cuts: list[list[Cut]]):
    """(class, first, second, chance) -> the number of boundaries of its class that a row is not below."""
    tables = [tuple(np.array([getattr(c, name) for c in own], kind) for name, kind in (("first", np.int64), ("second", np.int64), ("share", np.float64))) for own in cuts]

    def run(kind: pd.Series, first: pd.Series, second: pd.Series, chance: pd.Series) -> pd.Series:
        place = np.zeros(len(kind), np.int32)
        for c, (firsts, seconds, shares) in enumerate(tables):
            at = np.flatnonzero(kind.to_numpy() == c)
            key = first.to_numpy()[at]
            place[at] = np.searchsorted(firsts, key, "left")
            # rows with a boundary's very keys
            for value in np.unique(firsts[np.isin(firsts, key)]):
                own, bounds = np.flatnonzero(key == value), np.flatnonzero(firsts == value)
                inner, luck = second.to_numpy()[at[own]], chance.to_numpy()[at[own]]
                for bound in bounds:
                    place[at[own]] += (inner > seconds[bound]) | ((inner == seconds[bound]) & (luck >= shares[bound]))
        return pd.Series(place)

    return F.pandas_udf(run, "int")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text, none if it is null, and ROW_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def write_shards(docs: DataFrame, path: str, shards: int, text: str = "text") -> DataFrame:
    """Write ``docs`` under ``path``, a folder for each shard, and return them with shard, size and slot.

    Shards hold nearly the same number of bytes (text and ROW_BYTES a row):
    boundaries are settled within TOLERANCE of a partition or half a row of
    the shortest class, unless a single row is larger than a shard. Equal
    texts are neighbours: a shard's end parts them only where it must. slot
    counts a shard's rows from 0 in the order of its files.

    A null text has no bytes and is not equal to an empty one. Ids may be null
    or repeat; rows that are the same in all columns are dealt out by share.
    An empty table gives no row. Columns of ``docs`` named shard, size or slot
    are replaced; others stay. Maps cannot be told apart by value and do not
    count among the columns that order equal texts.
    """
    kept = [c for c in docs.columns if c not in ("shard", "size", "slot")]
    told = [c for c in kept if c != text and "map<" not in docs.schema[c].dataType.simpleString()]
    value = F.col(f"`{text}`").cast("string")
    keys = {"__first": F.xxhash64(value), "__second": F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in told]), "size": size_of(value)}
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns(keys)
    slim = materialize(rows.select(F.col("__first").alias("first"), F.col("__second").alias("second"), "size"), "sharding-keys")

    total, longest = slim.agg(F.sum("size"), F.max("size")).first()
    total, longest = total or 0, longest or 0
    parts = max(1, math.ceil(total / (shards * PART_BYTES)))
    each = total / (shards * parts)
    bounds = [each / n for n in LONG_SHARES]
    kind = F.lit(len(bounds))
    for c in reversed(range(len(bounds))):
        kind = F.when(F.col("size") > bounds[c], c).otherwise(kind)
    sums = {r["kind"]: r["bytes"] for r in slim.groupBy(kind.alias("kind")).agg(F.sum("size").alias("bytes")).collect()}
    loads, cuts = np.zeros(shards * parts), []
    for c in range(len(bounds) + 1):
        if not sums.get(c):
            cuts.append([])
            continue
        targets = np.cumsum(fill(loads, float(sums[c])))[:-1]
        found = splitters(slim.where(kind == c), targets.tolist(), TOLERANCE * each)
        cuts.append(found)
        loads += np.diff(np.concatenate([[0.0], [x.below for x in found], [float(sums[c])]]))
    release(slim)

    chance = (F.xxhash64(F.monotonically_increasing_id()) % (1 << 30) + (1 << 30)) / float(1 << 31)
    dealt = rows.withColumn("__part", _places(cuts)(kind, "__first", "__second", chance))
    dealt = dealt.withColumn("shard", F.call_function("div", F.col("__part"), F.lit(parts)).cast("int"))
    dealt = dealt.repartitionById(shards * parts, "__part").sortWithinPartitions("shard", "__first", "__second")
    # the low 33 bits count the rows of a task
    dealt = dealt.withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("__first", "__second")
    dealt.write.partitionBy("shard").parquet(path)
    schema = T.StructType([f for f in dealt.schema.fields if f.name != "shard"] + [T.StructField("shard", T.IntegerType())])
    written = docs.sparkSession.read.schema(schema).parquet(path)
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("shard", "__part").agg(F.count("*").alias("n")).select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    # a row for each exchanged partition, one for about PART_BYTES of the input
    placed = written.join(F.broadcast(starts), ["shard", "__part"])
    return placed.select(*[F.col(f"`{c}`") for c in kept], "shard", "size", (F.col("__start") + F.col("__place")).alias("slot"))


def shard(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """``write_shards`` to a new folder of the shared store."""
    return write_shards(docs, f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}", shards, text)
