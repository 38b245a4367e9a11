"""Analysis of scanning patterns: background, folding, Fourier coefficients, slopes, peaks.

Patterns are (key..., r, seg, i, n) rows with -1 for missing intensities and n
pixels behind each. A point's pattern is bounded by the detector's bins, so
groups and windows by point stay small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def known(i: str = "i") -> Column:
    return F.col(i) >= 0


def background(patterns: DataFrame) -> DataFrame:
    """(r, seg, bgr): mean over points of the known intensities, -1 if there are none."""
    return patterns.groupBy("r", "seg").agg(F.coalesce(F.avg(F.when(known(), F.col("i"))), F.lit(-1.0)).alias("bgr"))


def drop_outliers(rows: DataFrame, value: str, deviation: float, passes: int = 5) -> DataFrame:
    """Rows within a relative deviation of the median, in up to ``passes`` passes; the first allows twice that.

    A driver loop: each pass collects one median. It ends when a pass after
    the first removes nothing.
    """
    size = rows.count()
    for number in range(passes):
        middle = rows.agg(F.percentile(value, 0.5)).first()[0]
        if middle is None:
            return rows
        allowed = deviation * (2 if number == 0 else 1)
        rows = rows.where(F.abs(F.col(value) / F.lit(middle) - 1) <= allowed)
        left = rows.count()
        if number and left == size:
            break
        size = left
    return rows


def subtract_background(patterns: DataFrame, bgr: DataFrame) -> DataFrame:
    """i minus bgr where both are known; other intensities stay."""
    both = known() & (F.col("bgr") >= 0)
    return patterns.join(bgr, ["r", "seg"], "left").withColumn("i", F.when(both, F.col("i") - F.col("bgr")).otherwise(F.col("i"))).drop("bgr")


def weighted(condition: Column) -> Column:
    """Mean of i by pixels where the condition holds, null if it nowhere does."""
    return F.try_divide(F.sum(F.when(condition, F.col("i") * F.col("n"))), F.sum(F.when(condition, F.col("n"))).cast("double"))


def symmetric(patterns: DataFrame, key: list[str], transmission: Column) -> DataFrame:
    """(key..., r, s): mean over segments by pixels, negative to zero, over the transmission."""
    mean = patterns.groupBy(*key, "r").agg(F.greatest(F.lit(0.0), F.coalesce(weighted(known()), F.lit(0.0))).alias("m"))
    return mean.select(*key, "r", (F.col("m") / (transmission + EPS)).alias("s"))


def fold(patterns: DataFrame, key: list[str], segments: int = 8) -> DataFrame:
    """(key..., r, seg, i, n): segment k joined with k + half. One missing: the other; both: -1."""
    half = segments // 2
    folded = patterns.groupBy(*key, "r", (F.col("seg") % half).alias("half"))
    out = folded.agg(F.coalesce(weighted(known()), F.lit(-1.0)).alias("i"), F.sum(F.when(known(), F.col("n")).otherwise(0)).cast("int").alias("n"))
    return out.withColumnRenamed("half", "seg")


def fill_gaps(patterns: DataFrame, key: list[str]) -> DataFrame:
    """Missing values repaired along the linear index (r, seg), which runs on from one radius to the next.

    A single gap becomes the pixel-weighted mean of its neighbours; what is
    still missing takes the last value before, then the first after, then 0.
    """
    w = Window.partitionBy(*key).orderBy("r", "seg")
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    nb, na = F.lag("n").over(w), F.lead("n").over(w)
    rows = patterns.withColumn("v", F.when(known(), F.col("i")))
    single = F.col("v").isNull() & before.isNotNull() & after.isNotNull()
    rows = rows.withColumn("u", F.when(single, (before * nb + after * na) / (nb + na)).otherwise(F.col("v")))
    last = F.last("u", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("u", F.coalesce(last, F.first("u", True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0)))
    return rows.select(*key, "r", "seg", F.col("u").alias("i"), "n")


def asymmetry(patterns: DataFrame, key: list[str], segments: int = 8) -> DataFrame:
    """(key..., d): mean over radii of (I_0 - I_half) / (I_0 + I_half) where both are known."""
    half = segments // 2
    pair = patterns.groupBy(*key, "r").agg(
        F.max(F.when((F.col("seg") == 0) & known(), F.col("i"))).alias("a"), F.max(F.when((F.col("seg") == half) & known(), F.col("i"))).alias("b")
    )
    return pair.groupBy(*key).agg(F.coalesce(F.avg(F.try_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b"))), F.lit(0.0)).alias("d"))


def over_ranges(patterns: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """(key..., range_id, seg, i): pixel-weighted means over (range_id, r_from, r_to) rows, ends included.

    Radii are few, so ranges become lists of radii and the range join an
    equality join.
    """
    radii = ranges.select("range_id", F.explode(F.sequence("r_from", "r_to")).alias("r"))
    met = patterns.where(known()).join(F.broadcast(radii), "r")
    total, pixels = F.sum(F.col("i") * F.col("n")), F.sum("n")
    return met.groupBy(*key, "range_id", "seg").agg((total / (pixels + EPS)).alias("i"))


def power_background(profiles: DataFrame, key: list[str], first: int, last: int, far: int, close: int, power: float | None) -> DataFrame:
    """(key..., p, i0, i1): I0 + I1 * r^-p through the means of the patches on both sides of first..last.

    ``power`` None fits it to the two means, held to [-0.1, 4.1].
    """
    left = (first - far + first - close) / 2
    right = (last + close + last + far) / 2
    mean = lambda a, b: F.avg(F.when(F.col("r").between(a, b), F.col("s")))
    rows = profiles.groupBy(*key).agg(mean(first - far, first - close).alias("a"), mean(last + close, last + far).alias("b"))
    if power is None:
        fitted = -F.ln(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("a") / F.col("b"))) / math.log(left / right)
        rows = rows.withColumn("p", F.greatest(F.lit(-0.1), F.least(F.lit(4.1), F.coalesce(fitted, F.lit(0.0)))))
    else:
        rows = rows.withColumn("p", F.lit(float(power)))
    span = F.pow(F.lit(left), -F.col("p")) - F.pow(F.lit(right), -F.col("p"))
    rows = rows.withColumn("i1", F.when(F.abs(span) > 1e-30, (F.col("a") - F.col("b")) / span).otherwise(0.0))
    flat = F.abs(span) <= 1e-30
    return rows.select(*key, "p", F.when(flat, (F.col("a") + F.col("b")) / 2).otherwise(F.col("b") - F.col("i1") * F.pow(F.lit(right), -F.col("p"))).alias("i0"), "i1")


def fourier(patterns: DataFrame, key: list[str], segments: int = 8) -> DataFrame:
    """(key..., f1, f2, phase, dev) of half a detector: F0 / n, 2 |F1| / n, arg F1, residual RMS.

    The residual leaves out bins 0, 1 and the last; by Parseval's theorem it
    needs no inverse transform. Missing values count as zero.
    """
    v = F.when(known(), F.col("i")).otherwise(0.0)
    at = F.col("seg") * (2 * math.pi / segments)
    rows = patterns.groupBy(*key).agg(F.sum(v).alias("f0"), F.sum(v * F.cos(at)).alias("re"), F.sum(-v * F.sin(at)).alias("im"), F.sum(v * v).alias("sq"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    rest = F.greatest(F.lit(0.0), segments * F.col("sq") - F.col("f0") * F.col("f0") - 2 * power)
    return rows.select(
        *key, (F.col("f0") / segments).alias("f1"), (2 * F.sqrt(power) / segments).alias("f2"), F.atan2("im", "re").alias("phase"), (F.sqrt(rest) / segments).alias("dev")
    )


def orientation(phase: Column, first_deg: float) -> Column:
    """The angle of the phase in degrees, offset to the first segment's centre, in [-90, 90)."""
    angle = -(phase / math.pi * 90) + first_deg
    return F.pmod(angle + 90, F.lit(180.0)) - 90


def degree(f1: str = "f1", f2: str = "f2") -> Column:
    return F.col(f2) / (F.col(f1) + 1e-6)


def log_slope(profiles: DataFrame, key: list[str]) -> DataFrame:
    """(key..., slope): least squares of ln s on ln r over positive s, 0 for fewer than two."""
    positive = profiles.where((F.col("s") > 0) & (F.col("r") > 0))
    slope = F.coalesce(F.regr_slope(F.ln("s"), F.ln(F.col("r").cast("double"))), F.lit(0.0))
    return profiles.select(*key).distinct().join(positive.groupBy(*key).agg(slope.alias("slope")), key, "left").select(*key, F.coalesce("slope", F.lit(0.0)).alias("slope"))


def simple_peak(profiles: DataFrame, key: list[str], length: int) -> DataFrame:
    """(key..., pos, top, left, right): the highest place and the half-height crossings on both sides.

    Places run from 1 to ``length``. A crossing is interpolated between its
    neighbours, extrapolated where none lies inside, and held to the ends.
    """
    w = Window.partitionBy(*key)
    rows = profiles.withColumn("top", F.max("s").over(w)).withColumn("pos", F.min(F.when(F.col("s") == F.col("top"), F.col("r"))).over(w))
    low = F.col("s") <= F.col("top") / 2
    rows = rows.withColumn("l", F.coalesce(F.max(F.when(low & (F.col("r") < F.col("pos")), F.col("r"))).over(w), F.lit(1)))
    rows = rows.withColumn("u", F.coalesce(F.min(F.when(low & (F.col("r") > F.col("pos")), F.col("r"))).over(w), F.lit(length)))
    at = lambda c, step=0: F.max(F.when(F.col("r") == F.col(c) + step, F.col("s")))
    rows = rows.groupBy(*key, "pos", "top", "l", "u").agg(at("l").alias("l0"), at("l", 1).alias("l1"), at("u").alias("u0"), at("u", -1).alias("u1"))
    half = F.col("top") / 2
    left = F.col("l") + F.coalesce(F.try_divide(half - F.col("l0"), F.col("l1") - F.col("l0")), F.lit(0.0))
    right = F.col("u") + F.coalesce(F.try_divide(half - F.col("u0"), F.col("u0") - F.col("u1")), F.lit(0.0))
    left = F.least(F.lit(float(length)), F.greatest(F.lit(1.0), left))
    right = F.when(right + 1 >= length, F.lit(float(length))).otherwise(F.greatest(F.lit(1.0), right))
    return rows.select(*key, "pos", "top", left.alias("left"), right.alias("right"))


def transmission_level(rows: DataFrame, value: str, bins: int = 1 << 20, share: float = 0.99) -> DataFrame:
    """One row (norm): the lower edge of the first of ``bins`` at which more than ``share`` of all values lie.

    Counted by bin before the running sum, which so sees at most ``bins`` rows.
    """
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("total"))
    ends = ends.withColumn("step", (F.col("high") - F.col("low")) / (bins - 1))
    placed = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    counts = placed.groupBy(F.round((F.col(value) - F.col("low")) / F.col("step")).cast("long").alias("bin"), "low", "step", "total").agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(Window.orderBy("bin"))
    over = counts.withColumn("run", running).where(F.col("run") > share * F.col("total"))
    return over.agg(F.min(F.struct("bin", "low", "step")).alias("b")).select((F.col("b.bin") * F.col("b.step") + F.col("b.low")).alias("norm"))


def snake_x(x: str, y: str, nx: int) -> Column:
    """Every second line of a snake scan runs backwards."""
    return F.when(F.col(y) % 2 == 1, nx - 1 - F.col(x)).otherwise(F.col(x))
