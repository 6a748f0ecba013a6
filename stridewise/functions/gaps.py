"""A table function that fills the gaps of tracks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from stridewise.errors import ArgumentValueError

# Spark also asks for the result's schema in a process beside the driver, which has none of the shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ("id", "frame", "x", "y")
_RESULT = StructType([StructField("id", LongType()), StructField("frame", LongType()), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("filled", BooleanType())])


class FillGaps:
    """``fill_gaps(TABLE(positions) PARTITION BY (id) ORDER BY (frame), longest)``: positions and evenly spaced ones in gaps.

    positions has id, frame, x and y, others are left out. Gaps of up to
    ``longest`` missing frames are filled; longer ones stay, as do gaps beside
    rows without a place. Rows without a frame are dropped; of rows with equal
    frames all stay.
    """

    @staticmethod
    def analyze(positions: AnalyzeArgument, longest: AnalyzeArgument) -> AnalyzeResult:
        if not positions.isTable:
            raise ArgumentValueError("fill_gaps takes a table first")
        missing = [c for c in COLUMNS if c not in positions.dataType.fieldNames()]
        if missing:
            raise ArgumentValueError(f"the table of fill_gaps lacks the columns {missing}")
        if not longest.isConstantExpression or longest.value is None or longest.value < 0:
            raise ArgumentValueError("the longest gap of fill_gaps must be a constant from 0 on")
        return AnalyzeResult(_RESULT)

    def __init__(self) -> None:
        self.before = None

    def eval(self, row, longest: int):
        if row["frame"] is None:
            return
        if self.before is not None and None not in (row["x"], row["y"], self.before["x"], self.before["y"]):
            steps = row["frame"] - self.before["frame"]
            if 1 < steps <= longest + 1:
                for k in range(1, steps):
                    yield row["id"], self.before["frame"] + k, *(float(self.before[c] + (row[c] - self.before[c]) * k / steps) for c in "xy"), True
        yield row["id"], row["frame"], row["x"], row["y"], False
        self.before = row


fill_gaps = udtf(FillGaps)
