"""Pair distances and the pair-distribution function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridewise.errors import ArgumentValueError
from stridewise.model import TrajectoryData, check_trajectory

#: Hex digits of a key by which rows are dealt to buckets when they are numbered.
BUCKET_DIGITS = 3


def _crowded(data: DataFrame) -> DataFrame:
    """frame, rows of the frames with more than one pedestrian."""
    return data.groupBy("frame").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("frame", "rows")


def pair_distances(data: DataFrame, cutoff: float | None = None) -> DataFrame:
    """distance of each pair of rows (rid, frame, x, y) of a frame; frames whose rows are one pedestrian have none.

    With a cutoff, only pairs as near as that: rows meet in square bins as wide
    as the cutoff, each with those of its own bin and of four neighbours, so
    that a crowded frame is many groups and the work grows with near pairs.
    """
    rows = data.select("frame", "rid", "x", "y").join(_crowded(data).select("frame"), "frame")
    on = ["frame"]
    if cutoff is not None:
        width = F.lit(float(cutoff))
        rows = rows.where("x is not null and y is not null").withColumns({"bin_x": F.floor(F.col("x") / width), "bin_y": F.floor(F.col("y") / width)})
        on = ["frame", "bin_x", "bin_y"]
    a, b = (rows.select(*on, *[F.col(c).alias(f"{c}_{side}") for c in ("rid", "x", "y")]) for side in "ab")
    once = F.col("rid_a") < F.col("rid_b")
    if cutoff is not None:
        # the bin itself and those that come behind it: each pair of bins meets once
        steps = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
        offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
        a = a.withColumn("step", offsets).withColumns({"bin_x": F.col("bin_x") + F.col("step.i"), "bin_y": F.col("bin_y") + F.col("step.j")})
        once = once | (F.col("step.i") != 0) | (F.col("step.j") != 0)
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    found = a.join(b, on).where(once).select(F.sqrt(dx * dx + dy * dy).alias("distance"))
    return found if cutoff is None else found.where(F.col("distance") <= width)


def pair_histogram(traj_data: TrajectoryData, radius_bin_size: float, cutoff: float | None = None) -> DataFrame:
    """(bin, n): pairs of a frame with a distance in (bin - 1, bin] times the bin size; bin 0: at one place.

    cutoff: the largest distance that is looked for; bins beyond it are left
    out, and the one that it lies in holds the pairs up to it.
    """
    check_trajectory(traj_data)
    _check_cutoff(cutoff)
    return _histogram(traj_data.data.withColumn("rid", F.col("id")), radius_bin_size, cutoff)


def _check_cutoff(cutoff: float | None) -> None:
    if cutoff is not None and not 0 < cutoff < float("inf"):
        raise ArgumentValueError("the cutoff of pair distances must be a positive number")


def _histogram(data: DataFrame, size: float, cutoff: float | None = None) -> DataFrame:
    return pair_distances(data, cutoff).groupBy(F.ceil(F.col("distance") / F.lit(float(size))).alias("bin")).agg(F.count("*").alias("n"), F.max("distance").alias("farthest"))


def _numbered(data: DataFrame, key: Column) -> DataFrame:
    """data with ``place``, a number from 0 on in the order of a hex key, counted bucket by bucket."""
    keyed = data.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    # 16 ** BUCKET_DIGITS rows at most
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "rid")) - 1
    return keyed.withColumn("within", within).join(F.broadcast(before), "bucket").withColumn("place", F.col("before") + F.col("within")).drop("key", "bucket", "before", "within")


def _shuffled(seed: int) -> Column:
    """Where the seed puts a row: the digest of both, which any SQL engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(seed), "id", "frame", "copy").cast("binary"))


def _totals(histogram: DataFrame, data: DataFrame, cutoff: float | None, name: str) -> DataFrame:
    """One row: the number of pairs of all distances, those that were found, and the largest distance among them."""
    found = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_found"), F.max("farthest").alias(f"{name}_farthest"))
    if cutoff is None:
        return found.withColumn(f"{name}_total", F.col(f"{name}_found"))
    # pairs need not be formed to be counted
    pairs = _crowded(data).agg(F.coalesce(F.sum(F.expr("rows * (rows - 1) div 2")), F.lit(0)).alias(f"{name}_total"))
    # one row each
    return found.join(F.broadcast(pairs), how="cross")


def pair_distribution_function(traj_data: TrajectoryData, radius_bin_size: float, randomisation_stacking: int = 1, seed: int = 0, cutoff: float | None = None) -> DataFrame:
    """(r, g): pair distances over those with shuffled frames, by right ends of bins; sorted by r.

    g is NaN or infinite where the shuffled data have no pair: that stands for a
    warning. The shuffle is a fixed function of the seed. With a cutoff, the
    values up to it are the same and the others are left out; only near pairs
    are formed.
    """
    check_trajectory(traj_data)
    _check_cutoff(cutoff)
    data = traj_data.data.select("id", "frame", "x", "y")
    if cutoff is not None:
        data = data.where("x is not null and y is not null")
    numbered = data.withColumn("rid", F.xxhash64("id", "frame"))
    own = _histogram(numbered, radius_bin_size, cutoff)
    stacked = data.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(randomisation_stacking)))).withColumn("rid", F.xxhash64("id", "frame", "copy"))
    rows = _numbered(stacked, _shuffled(seed)).select("place", "id", "rid", "x", "y")
    labels = _numbered(stacked, _shuffled(seed + 1)).select("place", "frame")
    shuffled = rows.join(labels, "place")
    random = _histogram(shuffled, radius_bin_size, cutoff)
    size = F.lit(float(radius_bin_size))
    both = own.select("bin", F.col("n").alias("own")).join(random.select("bin", F.col("n").alias("random")), "bin", "full")
    totals = _totals(own, numbered, cutoff, "own")
    last = F.ceil(F.col("own_farthest") / size).cast("int") - 1
    if cutoff is not None:
        # bins up to the cutoff are whole; where pairs lie beyond it, so do later bins
        whole = F.floor(F.lit(float(cutoff)) / size).cast("int")
        last = F.when(F.col("own_found") < F.col("own_total"), whole).otherwise(F.least(whole, last))
    bins = totals.select(F.explode(F.sequence(F.lit(1), F.coalesce(last, F.lit(0)))).alias("bin")).where(F.col("bin") >= 1)
    # the totals are one row each
    joined = bins.join(both, "bin", "left").join(F.broadcast(totals), how="cross").join(F.broadcast(_totals(random, shuffled, cutoff, "random")), how="cross")
    share = lambda name: F.coalesce(name, F.lit(0)) / F.nullif(F.col(f"{name}_total"), F.lit(0))
    ratio = F.when(share("random") > 0, share("own") / F.nullif(share("random"), F.lit(0.0))).when(share("own") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return joined.select((F.col("bin") * size).alias("r"), ratio.alias("g")).orderBy("r")
