"""Rows for every frame of a range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_spine(frames: DataFrame) -> DataFrame:
    """One row ``frame`` for each frame from the smallest to the largest one of the data."""
    span = frames.agg(F.min("frame").alias("low"), F.max("frame").alias("high")).where("low is not null")
    return span.select(F.explode(F.sequence("low", "high")).alias("frame"))


def own_spine(values: DataFrame, column: str) -> DataFrame:
    """The spine of a per-frame table's own frames.

    Asks for the same columns as the table's other readers, so that Spark makes
    the rows once and reads their exchange twice.
    """
    row = F.struct("frame", column)
    span = values.agg(F.min(row).alias("low"), F.max(row).alias("high")).where("low is not null")
    return span.select(F.explode(F.sequence("low.frame", "high.frame")).alias("frame"))


def zero_filled(values: DataFrame, frames: DataFrame | None, column: str) -> DataFrame:
    """(frame, column) for each frame of the range of ``frames``, or of ``values`` itself; 0.0 where ``values`` has no row."""
    known = values.select("frame", F.col(column), F.lit(True).alias("__known"))
    filled = F.when(F.col("__known"), F.col(column)).otherwise(F.lit(0.0))
    spine = own_spine(values, column) if frames is None else frame_spine(frames)
    return spine.join(known, "frame", "left").select("frame", filled.alias(column))
