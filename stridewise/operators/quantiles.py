"""Exact quantiles of any number of rows, by refining a histogram.

Each pass counts rows in a bounded number of parts of the values' range and
keeps the parts that hold a wanted rank. Values first fall into parts by their
magnitude, then a part is cut evenly between its smallest and its largest
value, so that a few passes tell single values apart. No task and no driver
ever holds more than the counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridewise.shared import materialize, release

#: Parts of a magnitude (a factor of two), and parts that a range is cut into.
FINE, PARTS = 16, 4096
#: A part of so few rows is read as it is.
FEW = 1024


@dataclass
class _Range:
    """A part of the values, by its ends, the rows before it and its own."""

    low: float
    high: float
    before: int
    rows: int


def _magnitude(value: Column) -> Column:
    """A number that never falls as the value rises, and differs by FINE or so for twice the value."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(2000.0)) * F.lit(FINE)).cast("long") + F.lit(1100 * FINE)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def _counted(rows: DataFrame, part: Column) -> list[tuple[float, float, int]]:
    """(smallest, largest value, rows) of each part, in order."""
    found = rows.groupBy(part.alias("part")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    return sorted((r.low, r.high, r.n) for r in found.collect())


def _holding(parts: list[tuple[float, float, int]], before: int, ranks: list[int]) -> dict[int, _Range]:
    out: dict[int, _Range] = {}
    for low, high, n in parts:
        for rank in ranks:
            if before <= rank < before + n:
                out[rank] = _Range(low, high, before, n)
        before += n
    return out


def values_at(rows: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at ranks (from 0) of the doubles ``value`` in ``rows``, none null, NaN sorted last by Spark's order."""
    found: dict[int, float] = {}
    finite = rows.where(~F.isnan("value"))
    held = _holding(_counted(finite, _magnitude(F.col("value"))), 0, ranks)
    found |= {r: float("nan") for r in ranks if r not in held}
    while held:
        settled = {r: h for r, h in held.items() if h.low == h.high}
        found |= {r: h.low for r, h in settled.items()}
        held = {r: h for r, h in held.items() if r not in settled}
        ranges = {(h.low, h.high): h for h in held.values()}
        held_next: dict[int, _Range] = {}
        for (low, high), h in ranges.items():
            own = [r for r, x in held.items() if (x.low, x.high) == (low, high)]
            inside = finite.where((F.col("value") >= F.lit(low)) & (F.col("value") <= F.lit(high)))
            if h.rows <= FEW:
                values = sorted(r.value for r in inside.collect())
                found |= {r: values[r - h.before] for r in own}
                continue
            width = high - low
            if math.isinf(width) or width / PARTS == 0:
                # ends too far apart, or too near, to be cut evenly
                middle = low / 2 + high / 2
                middle = middle if low < middle < high else low
                part = (F.col("value") > F.lit(middle)).cast("long")
            else:
                part = F.floor((F.col("value") - F.lit(low)) / F.lit(width) * F.lit(PARTS)).cast("long")
            held_next |= _holding(_counted(inside, part), h.before, own)
        held = held_next
    return found


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a numeric column, interpolated between the two nearest values as usual; None without values.

    Null values are left out, NaN counts as the largest. The column is written
    to the shared folder, as it is read a few times.
    """
    rows = materialize(df.select(F.col(f"`{column}`").cast("double").alias("value")).where("value is not null"), "quantiles")
    n = rows.count()
    if not n:
        release(rows)
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    at = values_at(rows, ranks)
    release(rows)
    out = []
    for p in places:
        low, high = at[math.floor(p)], at[math.ceil(p)]
        out.append(low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out
