"""Masks and radial integration of detector frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["row", "col"]


def dark_hot(frames: DataFrame, dark_below: float, hot_above: float) -> DataFrame:
    """(row, col, dark, hot): dark if it is so in all frames, hot if in any."""
    return frames.groupBy(*PIXEL).agg(F.bool_and(F.col("counts") < dark_below).alias("dark"), F.bool_or(F.col("counts") > hot_above).alias("hot"))


def valid_pixels(frames: DataFrame, dark_below: float, hot_above: float) -> DataFrame:
    """Pixels that are neither dark nor hot, with one shuffle of partial flags."""
    return dark_hot(frames, dark_below, hot_above).where(~F.col("dark") & ~F.col("hot")).select(*PIXEL)


def merge_masks(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    if how == "intersect":
        return a.select(*PIXEL).intersect(b.select(*PIXEL))
    if how == "union":
        return a.select(*PIXEL).union(b.select(*PIXEL)).distinct()
    raise ValueError(f"how is intersect or union, not {how}")


def without_pixels(mask: DataFrame, removed: DataFrame) -> DataFrame:
    return mask.join(removed.select(*PIXEL).distinct(), PIXEL, "left_anti")


def ring(cy: float, cx: float, step: float = 1.0) -> Column:
    return F.floor(radius(cy, cx) / step).cast("int")


def radius(cy: float, cx: float) -> Column:
    y, x = F.col("row") - cy, F.col("col") - cx
    return F.sqrt(y * y + x * x)


def sector(cy: float, cx: float, sectors: int) -> Column:
    turn = 2 * math.pi
    angle = F.pmod(F.atan2(F.col("row") - cy, F.col("col") - cx), F.lit(turn))
    return F.least(F.floor(angle / (turn / sectors)), F.lit(sectors - 1)).cast("int")


def bins(mask: DataFrame, cy: float, cx: float, step: float, sectors: int) -> DataFrame:
    """integ_bin(r_bin, seg, row, col) of the valid pixels."""
    return mask.select(ring(cy, cx, step).alias("r_bin"), sector(cy, cx, sectors).alias("seg"), *PIXEL)


def integrate(frames: DataFrame, bin_pixels: DataFrame, key: list[str], r_bins: int, sectors: int) -> DataFrame:
    """(key..., r_bin, seg, mean, std, n) for every bin; -1 for both where it has no pixel, std 0 for one.

    ``bin_pixels`` has one row for each pixel of a detector, joined by broadcast
    as the planner sees fit; frames are aggregated once.
    """
    spark = frames.sparkSession
    sums = frames.join(bin_pixels, PIXEL).groupBy(*key, "r_bin", "seg")
    sums = sums.agg(F.avg("counts").alias("m"), F.coalesce(F.stddev_samp("counts"), F.lit(0.0)).alias("s"), F.count("counts").alias("k"))
    every = spark.range(r_bins * sectors).select(F.expr(f"CAST(id div {sectors} AS INT)").alias("r_bin"), (F.col("id") % sectors).cast("int").alias("seg"))
    full = frames.select(*key).distinct().crossJoin(F.broadcast(every))
    out = full.join(sums, [*key, "r_bin", "seg"], "left")
    return out.select(*key, "r_bin", "seg", F.coalesce("m", F.lit(-1.0)).alias("mean"), F.coalesce("s", F.lit(-1.0)).alias("std"), F.coalesce("k", F.lit(0)).alias("n"))


def tune_mask(frames: DataFrame, cy: float, cx: float, times: float) -> DataFrame:
    """Pixels within ``times`` ring deviations of the ring's mean, itself a running median over three rings."""
    pixel = frames.groupBy(*PIXEL).agg(F.avg("counts").alias("v")).withColumn("ring", ring(cy, cx))
    rings = pixel.groupBy("ring").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    w = Window.orderBy("ring").rowsBetween(-1, 1)
    rings = rings.withColumn("m", F.percentile("m", 0.5).over(w))
    met = pixel.join(F.broadcast(rings), "ring")
    return met.where(F.abs(F.col("v") - F.col("m")) <= times * F.col("s") + 1e-9).select(*PIXEL)


def centre_costs(frames: DataFrame, centres: DataFrame) -> DataFrame:
    """(cy, cx, cost) of candidate centres: mean over rings of the ring's deviation over its size.

    Frames shrink to one row a pixel before the candidates multiply them.
    """
    pixel = frames.groupBy(*PIXEL).agg(F.avg("counts").alias("v"))
    rows = pixel.crossJoin(F.broadcast(centres))
    y, x = F.col("row") - F.col("cy"), F.col("col") - F.col("cx")
    rows = rows.withColumn("ring", F.floor(F.sqrt(y * y + x * x)))
    rings = rows.groupBy("cy", "cx", "ring").agg((F.coalesce(F.stddev_samp("v"), F.lit(0.0)) / F.count("v")).alias("c"))
    return rings.groupBy("cy", "cx").agg(F.avg("c").alias("cost"))
