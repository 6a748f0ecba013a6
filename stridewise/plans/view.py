"""A deterministic trajectory over the driver's ``events`` table, and the geometries of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridewise.model import AxisAlignedMeasurementArea, MeasurementArea, MeasurementLine, TrajectoryData, WalkableArea

FRAME_RATE = 10.0
FRAME_STEP = 5
CUTOFF = 0.8
PAIR_CUTOFF = 2.0
WALKABLE = WalkableArea([(-15, 0), (20, 0), (20, 5), (-15, 5)])
AREA = MeasurementArea([(-1.5, 0), (1.5, 0), (1.5, 5), (-1.5, 5)])
#: The grid lies off the lanes' pitch: no edge of a cell runs along its lines, where float noise would decide. Exact in binary.
GRID_SHIFT = 449 / 32768
GRID_AREA = AxisAlignedMeasurementArea(-4 - GRID_SHIFT, GRID_SHIFT, 4 - GRID_SHIFT, 5 + GRID_SHIFT)
LINE = MeasurementLine([(0, 0), (0, 5)])
#: Nobody comes here.
FAR_LINE = MeasurementLine([(19, 0), (19, 5)])
#: The box with a small square taken out, where cells are so wide that it cuts none in two.
OBSTACLE = (15.0, 2.4, 15.2, 2.6)
WITH_OBSTACLE = WalkableArea([(-15, 0), (20, 0), (20, 5), (-15, 5)], [[(15.0, 2.4), (15.2, 2.4), (15.2, 2.6), (15.0, 2.6)]])
#: Its lower wall is the only one that anybody comes near to.
ABOVE_WALL = WalkableArea([(-20, 0.5), (25, 0.5), (25, 9), (-20, 9)])


def jumping(spark: SparkSession, sf_dir: str) -> TrajectoryData:
    """The trajectory with one position of every tenth pedestrian 50 m off."""
    found = trajectory(spark, sf_dir)
    start = F.min("frame").over(Window.partitionBy("id"))
    off = F.when((F.col("id") % 10 == 3) & (F.col("frame") == start + 20), 50.0).otherwise(0.0)
    return TrajectoryData(found.data.withColumn("x", F.col("x") + off), FRAME_RATE)


def with_gaps(spark: SparkSession, sf_dir: str) -> TrajectoryData:
    """The trajectory without some rows of every third pedestrian: two frames and, later on, six."""
    found = trajectory(spark, sf_dir)
    since = F.col("frame") - F.min("frame").over(Window.partitionBy("id"))
    gone = (F.col("id") % 3 == 0) & (since.between(5, 6) | since.between(12, 17))
    return TrajectoryData(found.data.withColumn("gone", gone).where("not gone").drop("gone"), FRAME_RATE)


def trajectory(spark: SparkSession, sf_dir: str) -> TrajectoryData:
    """A user is a pedestrian; even ones walk to the right, odd ones to the left, twenty at a time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    events = events.withColumn("k", k)
    walk = F.expr("CASE WHEN user_id % 2 = 0 THEN -10 + 0.25D * k ELSE 12 - 0.25D * k END")
    data = events.select(
        F.col("user_id").alias("id"),
        F.expr("(user_id div 20) * 6 + k").cast("long").alias("frame"),
        (walk + F.expr("((CAST(round(value * 100) AS BIGINT) % 21) - 10) / 100.0D")).alias("x"),
        F.expr("(user_id % 20) * 0.25D + 0.125D + ((event_id % 11) - 5) / 100.0D").alias("y"),
    )
    return TrajectoryData(data, FRAME_RATE)


def cells(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    from stridewise.operators.voronoi import individual_voronoi_polygons

    return individual_voronoi_polygons(trajectory(spark, sf_dir), WALKABLE, **options)


#: The same rows in DuckDB, to open a WITH clause.
SQL = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
t AS (SELECT user_id AS id, (user_id // 20) * 6 + k AS frame,
  (CASE WHEN user_id % 2 = 0 THEN -10 + 0.25::DOUBLE * k ELSE 12 - 0.25::DOUBLE * k END) + ((CAST(round(value * 100) AS BIGINT) % 21) - 10) / 100.0::DOUBLE AS x,
  (user_id % 20) * 0.25::DOUBLE + 0.125::DOUBLE + ((event_id % 11) - 5) / 100.0::DOUBLE AS y FROM e),
spine AS (SELECT unnest(generate_series(min(frame), max(frame))) AS frame FROM t)
"""
