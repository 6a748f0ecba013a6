"""Means over many intervals of frames, by running sums.

An interval's mean is the difference of two running sums at its ends, whatever
its length. Running sums are made block by block of frames; sums of whole
blocks are added up apart, one row for each block, in decimals, so that only
the digits of the values of one block bound the digits of a mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block; a task sorts the frames and the ends of one block at a time.
BLOCK = 4096
#: Whole blocks' sums.
EXACT = "decimal(38,12)"
#: What is summed: finite values, their number, and how many NaN and infinite ones there are.
_SUMS = ("sum", "n", "nan", "up", "down")


def _parts(value: Column) -> dict[str, Column]:
    one = lambda condition: F.coalesce(F.when(condition, F.lit(1)).otherwise(F.lit(0)), F.lit(0)).cast("long")
    infinite = F.lit(float("inf"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < infinite)
    return {"sum": F.when(finite, value).otherwise(F.lit(0.0)), "n": one(value.isNotNull()), "nan": one(F.isnan(value)), "up": one(value == infinite), "down": one(value == -infinite)}


def interval_means(values: DataFrame, intervals: DataFrame, column: str, low: str, high: str, result: str) -> DataFrame:
    """``intervals`` with the mean of ``column`` over the frames from ``low`` to ``high``, both included, as ``result``.

    values: (frame, column), any number of rows a frame; missing frames and
    null values count for nothing. An interval without values, an empty one
    and one with a null end have a null mean; NaN and infinite values spread
    to the intervals that hold them, and to no others. Columns of
    ``intervals`` must be ones that can be sorted by.

    Each interval makes two rows, each frame one: nothing grows with the
    lengths of intervals. Both inputs are read once.
    """
    none = lambda kind: F.lit(None).cast(kind)
    frames = values.select("frame", *[c.alias(n) for n, c in _parts(F.col(f"`{column}`").cast("double")).items()])
    frames = frames.where("frame is not null").groupBy("frame").agg(*[F.sum(n).alias(n) for n in _SUMS])

    # an interval asks for the sums before its first frame and up to its last one; without frames, twice for the same
    first, last = F.col(f"`{low}`").cast("long"), F.col(f"`{high}`").cast("long")
    at = lambda frame: F.when(first <= last, frame).otherwise(F.lit(0)).cast("long")
    ends = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), at(first - 1).alias("frame")), F.struct(F.lit(1).alias("sign"), at(last).alias("frame"))))
    own = F.struct(*[F.col(f"`{c}`") for c in intervals.columns])
    asked = intervals.select(own.alias("own"), ends.alias("end")).select("own", "end.sign", "end.frame")

    # inside a block, ends come behind the row of their frame
    rows = frames.select("frame", F.lit(0).alias("kind"), *_SUMS, none("int").alias("sign"), none(asked.schema["own"].dataType).alias("own"))
    rows = rows.unionByName(asked.select("frame", F.lit(1).alias("kind"), *[none("double" if n == "sum" else "long").alias(n) for n in _SUMS], "sign", "own"))
    rows = rows.withColumn("block", F.floor(F.col("frame") / F.lit(BLOCK))).where("block is not null")
    so_far = Window.partitionBy("block").orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("block", "frame", "kind", "sign", "own", *[F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(n) for n in _SUMS])

    # a row for each block: its own sums are those of its last row. Asks for all columns, so that both readers share the rows
    ending = F.max_by(F.struct(*_SUMS), F.struct("frame", "kind", "sign", "own", *_SUMS))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(ending.alias("all")).select("block", F.col("all.sum").cast(EXACT).alias("sum"), *[F.col(f"all.{n}").alias(n) for n in _SUMS[1:]])
    blocks = blocks.select("block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in _SUMS])

    found = rows.where("kind = 1").join(blocks, "block")
    total = {n: F.sum(F.col("sign") * F.col(n)) + F.sum(F.col("sign") * F.col(f"before_{n}")).cast("double" if n == "sum" else "long") for n in _SUMS}
    # equal intervals meet in one group: their mean is the same, and each of them gets a row
    found = found.groupBy("own").agg(*[c.alias(n) for n, c in total.items()], F.count(F.when(F.col("sign") > 0, 1)).cast("int").alias("equal"))
    nan, up, down = (F.col(n) > 0 for n in _SUMS[2:])
    mean = F.when(nan | (up & down), F.lit(float("nan"))).when(up, F.lit(float("inf"))).when(down, F.lit(float("-inf")))
    mean = mean.otherwise(F.col("sum") / F.nullif(F.col("n"), F.lit(0)))
    each = found.select("own", mean.alias("__mean"), F.explode(F.array_repeat(F.lit(0), F.col("equal"))))
    return each.select(*[F.col(f"own.`{c}`") for c in intervals.columns if c != result], F.col("__mean").alias(result))
