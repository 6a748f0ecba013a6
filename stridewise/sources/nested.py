"""One large JSON document read by many tasks.

The text is read in pieces that end at a closing brace, by byte ranges as Spark
cuts them. A first pass finds, for each range, what it does to a reader that
comes from the left: whether it ends inside a string, and how deep. From these
few numbers each range's beginning is known, so that a second pass can cut out
the members of the document's object where it finds their ends. A member that
lies in several ranges is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewise.shipping import ship

_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_MARKS = re.compile(r'["{]')
_PIECES = "file string, start long, value string"


def _after(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece ends inside a string, and the braces that it opens."""
    at, opened = 0, 0
    while True:
        if inside:
            end = _STRING_END.match(text, at)
            if end is None:
                return True, opened
            at, inside = end.end(), False
        mark = _MARKS.search(text, at)
        if mark is None:
            return False, opened
        at = mark.end()
        if mark.group() == "{":
            opened += 1
        else:
            inside = True


def _ranges(batches) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, start, pieces) of each range of a task; pieces must be used up before the next range."""
    rows = ((f, s, v) for batch in batches for f, s, v in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        name = row[:2]

        def own(first=row, name=name):
            nonlocal row
            row = first
            while row is not None and row[:2] == name:
                yield row[2]
                row = next(rows, None)

        yield *name, own()


def _effects(batches):
    """Pieces -> for each range and each way to come in (outside or inside a string): in_string, depth and least depth after its end."""
    for file, start, pieces in _ranges(batches):
        state = [[False, 0, 0], [True, 0, 0]]
        for text in pieces:
            for s in state:
                s[0], opened = _after(text, s[0])
                s[1] += opened
                if not s[0]:
                    s[1] -= 1  # the brace that ends the piece
                    s[2] = min(s[2], s[1])
        columns = [[file] * 2, [start] * 2, [False, True], *zip(*state, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], names=["file", "start", "came_in", "in_string", "depth", "least"])


@dataclass(frozen=True)
class _Begin:
    """How a range begins: inside a string or not, how deep, and the start of the range that its first member began in."""

    in_string: bool
    depth: int
    group: int


def _begins(effects: list) -> dict[tuple[str, int], _Begin]:
    """From the effects of all ranges; a few numbers for each."""
    by_range: dict[tuple[str, int], dict[bool, object]] = {}
    for r in effects:
        by_range.setdefault((r.file, r.start), {})[r.came_in] = r
    found, file, state = {}, None, _Begin(False, 0, 0)
    for name in sorted(by_range):
        if name[0] != file:
            file, state = name[0], _Begin(False, 0, name[1])
        found[name] = state
        effect = by_range[name][state.in_string]
        # a member ends where the depth falls to 1
        ended = state.depth + effect.least <= 1 or state.depth <= 1 and not state.in_string
        state = _Begin(effect.in_string, state.depth + effect.depth, name[1] if ended else state.group)
    return found


def _members(begins: dict[tuple[str, int], _Begin]):
    """Pieces -> texts of members, whole (group null) or parts of one that began in the range ``group``."""

    def run(batches):
        for file, start, pieces in _ranges(batches):
            begin = begins[file, start]
            inside, depth = begin.in_string, begin.depth
            # the first member may have begun before
            group = begin.group if inside or depth > 1 else None
            held: list[str] = []
            out: list[tuple] = []
            for text in pieces:
                inside, opened = _after(text, inside)
                depth += opened - (not inside)
                held.append(text + "}")
                if not inside and depth <= 1:
                    if depth == 1 or group is not None:
                        out.append((file, group, start, "".join(held)))
                    held, group = [], None
            if held and "".join(held).strip("} \r\n\t"):
                out.append((file, start if group is None else group, start, "".join(held)))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "group", "start", "value"])

    return run


def members(spark: SparkSession, path: str) -> DataFrame:
    """(value): documents of one member each, of the objects that the files under ``path`` hold.

    Files may be larger than any task's memory; a member may not. Members must
    be objects. Text behind the document's object is ignored.
    """
    ship(spark)
    text = spark.read.option("lineSep", "}").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # two rows for each range of bytes that a task reads
    effects = pieces.mapInArrow(_effects, "file string, start long, came_in boolean, in_string boolean, depth long, least long").collect()
    found = pieces.mapInArrow(_members(_begins(effects)), "file string, group long, start long, value string")
    whole = found.where("group is null").select("value")
    parts = found.where("group is not null").groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"))
    joined = whole.unionByName(parts.select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value")))
    inner = F.regexp_replace("value", r"^[\x{FEFF}\s]*[,{]?\s*", "")
    return joined.select(F.concat(F.lit("{"), inner, F.lit("}")).alias("value"))
