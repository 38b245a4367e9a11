"""Queries of array and image helpers: interpolation, windows, bases, patches, components, exports."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from scatterlake.plans.derive import CURVE, curves
from scatterlake.plans.grid import rounded
from scatterlake.plans.pattern import PAT, PROFILE, profiles
from scatterlake.plans.registry import query
from scatterlake.session import table, work_path
from scatterlake.sources.standins import FRAME_SQL, frames

FR = f"WITH frame AS ({FRAME_SQL})"


@query("intensity_calib", f"""{PAT}, {PROFILE}, e AS (SELECT r, avg(s) AS i, 0.1 * stddev_samp(s) AS err FROM profile GROUP BY r), n AS (SELECT r * 1e-1 AS q, i, err, lead(r * 1e-1) OVER (ORDER BY r) AS q2, lead(i) OVER (ORDER BY r) AS i2, lead(err) OVER (ORDER BY r) AS err2 FROM e),
g AS (SELECT 15e-2 + range * 5e-2 AS q, 3 + 1e-1 * range AS g, 2e-1 AS ge FROM range(13)), m AS (SELECT g.q, g, ge, (i + (i2 - i) * (g.q - n.q) / (q2 - n.q)) / cos(2 * asin(0.9116e0 * g.q / (4 * pi()))) ** 3 AS x, (err + (err2 - err) * (g.q - n.q) / (q2 - n.q)) / cos(2 * asin(0.9116e0 * g.q / (4 * pi()))) ** 3 AS xe FROM g JOIN n ON g.q >= n.q - 1e-9 AND g.q < q2 - 1e-9)
SELECT count(*) AS n, round(sum(g * x / (ge ** 2 + xe ** 2)) / sum(x ** 2 / (ge ** 2 + xe ** 2)), 9) AS scale FROM m""")
def intensity_calib(spark, sf_dir):
    """Scale between a measured curve and a standard, by inverse variances.

    The measured curve is interpolated onto the standard's q; its steps are
    equal, so the interval of a q is a division and the join an equality.
    """
    e = profiles(spark, sf_dir).groupBy("r").agg(F.avg("s").alias("i"), (0.1 * F.stddev_samp("s")).alias("err"))
    w = Window.orderBy("r")  # one row for each radius
    n = e.select("r", "i", "err", F.lead("i").over(w).alias("i2"), F.lead("err").over(w).alias("err2")).where(F.col("i2").isNotNull())
    q = 0.15 + F.col("id") * 0.05
    g = spark.range(13).select(q.alias("q"), (3 + 0.1 * F.col("id")).alias("g"), F.floor((q + 1e-9) / 0.1).cast("int").alias("r"))
    part = (F.col("q") - F.col("r") * 0.1) / 0.1
    tilt = F.pow(F.cos(2 * F.asin(0.9116 * F.col("q") / (4 * math.pi))), 3)
    m = g.join(n, "r").select("g", ((F.col("i") + (F.col("i2") - F.col("i")) * part) / tilt).alias("x"), ((F.col("err") + (F.col("err2") - F.col("err")) * part) / tilt).alias("xe"))
    v = 0.04 + F.col("xe") * F.col("xe")
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("g") * F.col("x") / v) / F.sum(F.col("x") ** 2 / v), 9).alias("scale"))


AFFINE_SQL = "SELECT event_id, 1 + event_id % 50 / 50e0 AS sx, 1 + event_id % 80 / 80e0 AS sy, value - 75e0 * floor(value / 75e0) AS angle, event_id % 100 / 100e0 AS shear FROM events WHERE value IS NOT NULL"


@query("affine_parts", f"SELECT event_id, round(sx, 9) AS sx, round(sy, 9) AS sy, round(angle, 9) + 0.0 AS angle, round(shear, 9) + 0.0 AS shear FROM ({AFFINE_SQL})")
def affine_parts(spark, sf_dir):
    """Matrices composed of each event's rotation, shear and scales, and taken apart again."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).withColumn("angle", F.col("value") - 75.0 * F.floor(F.col("value") / 75.0))
    a, shear, sx, sy = F.radians("angle"), i % 100 / 100, 1 + i % 50 / 50, 1 + i % 80 / 80
    m = e.select(
        "event_id",
        (F.cos(a) * sx).alias("m11"), ((F.cos(a) * shear - F.sin(a)) * sy).alias("m12"),
        (F.sin(a) * sx).alias("m21"), ((F.sin(a) * shear + F.cos(a)) * sy).alias("m22"),
    )
    angle = F.atan2("m21", "m11")
    det = F.col("m11") * F.col("m22") - F.col("m12") * F.col("m21")
    wide = F.sqrt(F.col("m11") ** 2 + F.col("m21") ** 2)
    high = det / wide
    lean = (F.col("m11") * F.col("m12") + F.col("m21") * F.col("m22")) / wide / high
    return rounded(m.select("event_id", wide.alias("sx"), high.alias("sy"), F.degrees(angle).alias("angle"), lean.alias("shear")), ["event_id"], ["sx", "sy", "angle", "shear"], 9)


@query("taper", f"WITH {CURVE} SELECT vec_id, k, round(v * CASE WHEN k < 8 THEN (1 - cos(pi() * (k + 5e-1) / 8)) / 2 WHEN k >= 56 THEN (1 - cos(pi() * (63.5e0 - k) / 8)) / 2 ELSE 1 END, 9) + 0.0 AS v FROM curve")
def taper(spark, sf_dir):
    """Curves under a window with a Hann edge of eight samples on both sides."""
    edge = 8
    near = F.least(F.col("k") + 0.5, 63.5 - F.col("k"))
    w = F.when(near < edge, (1 - F.cos(math.pi * near / edge)) / 2).otherwise(1.0)
    return rounded(curves(spark, sf_dir).select("vec_id", "k", (F.col("v") * w).alias("v")), ["vec_id", "k"], ["v"], 9)


LEGENDRE = {1: "x", 2: "(3 * x ** 2 - 1) / 2", 3: "(5 * x ** 3 - 3 * x) / 2", 4: "(35 * x ** 4 - 30 * x ** 2 + 3) / 8"}


@query("legendre", f"WITH {CURVE} SELECT vec_id, " + ", ".join(f"round(sum(v * {p}) * {2 * n + 1}e0 / 64, 9) + 0.0 AS c{n}" for n, p in LEGENDRE.items()) + " FROM (SELECT *, (k + 5e-1) / 32 - 1 AS x FROM curve) GROUP BY vec_id")
def legendre(spark, sf_dir):
    """The first coefficients of each curve in the Legendre basis, by the recurrence (n + 1) P_n+1 = (2 n + 1) x P_n - n P_n-1."""
    x = (F.col("k") + 0.5) / 32 - 1
    p = [F.lit(1.0), x]
    for n in (1, 2, 3):
        p.append(((2 * n + 1) * x * p[n] - n * p[n - 1]) / (n + 1))
    out = [(F.sum(F.col("v") * p[n]) * (2 * n + 1) / 64).alias(f"c{n}") for n in (1, 2, 3, 4)]
    return rounded(curves(spark, sf_dir).groupBy("vec_id").agg(*out), ["vec_id"], [f"c{n}" for n in (1, 2, 3, 4)], 9)


@query("image_gradient", f"{FR} SELECT vec_id, row, col, (lead(counts) OVER w - lag(counts) OVER w) / 2 AS dx FROM frame WINDOW w AS (PARTITION BY vec_id, row ORDER BY col)")
def image_gradient(spark, sf_dir):
    """Central differences along the rows, null at the ends."""
    w = Window.partitionBy("vec_id", "row").orderBy("col")
    return frames(spark, sf_dir).select("vec_id", "row", "col", ((F.lead("counts").over(w) - F.lag("counts").over(w)) / 2).alias("dx"))


@query("unbin", f"{FR} SELECT vec_id, CAST(row * 2 + a.range AS INTEGER) AS row, CAST(col * 2 + b.range AS INTEGER) AS col, counts FROM frame, range(2) a, range(2) b")
def unbin(spark, sf_dir):
    """Each pixel repeated 2 x 2."""
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    rows = frames(spark, sf_dir).withColumn("o", F.explode(cells))
    return rows.select("vec_id", (F.col("row") * 2 + F.col("o.a")).alias("row"), (F.col("col") * 2 + F.col("o.b")).alias("col"), "counts")


@query("resample", f"WITH {CURVE}, n AS (SELECT *, lead(v) OVER (PARTITION BY vec_id ORDER BY k) AS v2 FROM curve) SELECT vec_id, CAST(k * 2 + h.range AS INTEGER) AS k, round(CASE h.range WHEN 0 THEN v ELSE (v + v2) / 2 END, 6) + 0.0 AS v FROM n, range(2) h WHERE h.range = 0 OR v2 IS NOT NULL")
def resample(spark, sf_dir):
    """Linear interpolation at half steps."""
    w = Window.partitionBy("vec_id").orderBy("k")
    rows = curves(spark, sf_dir).withColumn("v2", F.lead("v").over(w))
    points = F.array(F.struct(F.lit(0).alias("h"), F.col("v").alias("v")), F.struct(F.lit(1).alias("h"), ((F.col("v") + F.col("v2")) / 2).alias("v")))
    rows = rows.select("vec_id", "k", F.explode(points).alias("p")).where(F.col("p.v").isNotNull())
    return rounded(rows.select("vec_id", (F.col("k") * 2 + F.col("p.h")).alias("k"), F.col("p.v").alias("v")), ["vec_id", "k"], ["v"])


@query("unwrap", f"WITH {CURVE}, d AS (SELECT vec_id, k, v * 20 AS a, v * 20 - lag(v * 20) OVER (PARTITION BY vec_id ORDER BY k) AS d FROM curve), c AS (SELECT vec_id, k, first_value(a) OVER w AS a0, sum(coalesce(d + pi() - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi(), 0)) OVER w AS s FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, k, round(a0 + s, 6) + 0.0 AS phase FROM c")
def unwrap(spark, sf_dir):
    """A phase along each curve: the running sum of wrapped differences."""
    w = Window.partitionBy("vec_id").orderBy("k")
    rows = curves(spark, sf_dir).withColumn("a", F.col("v") * 20)
    d = F.col("a") - F.lag("a").over(w)
    rows = rows.withColumn("d", F.coalesce(F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi, F.lit(0.0)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return rounded(rows.withColumn("phase", F.first("a").over(run) + F.sum("d").over(run)), ["vec_id", "k"], ["phase"])


@query("patch_add", f"{FR} SELECT CAST(row + round(sin(vec_id) * 3) + 3 AS INTEGER) AS y, CAST(col + round(cos(vec_id) * 3) + 3 AS INTEGER) AS x, sum(counts) AS total, count(*) AS n FROM frame GROUP BY ALL")
def patch_add(spark, sf_dir):
    """Frames added to one canvas at rounded offsets: partial sums shrink them before the shuffle."""
    place = lambda axis, f: (F.col(axis) + F.round(f("vec_id") * 3) + 3).cast("int")
    rows = frames(spark, sf_dir).select(place("row", F.sin).alias("y"), place("col", F.cos).alias("x"), "counts")
    return rows.groupBy("y", "x").agg(F.sum("counts").alias("total"), F.count(F.lit(1)).alias("n"))


@query("bright_parts", f"""WITH RECURSIVE frame AS ({FRAME_SQL}), b AS (SELECT vec_id, row, col FROM frame WHERE counts > 60),
reach AS (SELECT vec_id, row, col, row * 8 + col AS root FROM b UNION SELECT n.vec_id, n.row, n.col, reach.root FROM reach JOIN b n ON n.vec_id = reach.vec_id AND abs(n.row - reach.row) + abs(n.col - reach.col) = 1),
c AS (SELECT vec_id, row, col, min(root) AS part FROM reach GROUP BY ALL), s AS (SELECT vec_id, part, count(*) AS size FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY size DESC, part) AS p FROM s) SELECT vec_id, CAST(part AS INTEGER) AS part, size FROM r WHERE p <= 2""")
def bright_parts(spark, sf_dir):
    """The two largest connected parts of the bright pixels of each frame, labelled by their least place.

    Frames are bounded, so each is labelled in place by numpy on Arrow batches.
    """
    bright = frames(spark, sf_dir).where("counts > 60").groupBy("vec_id").agg(F.collect_list(F.col("row") * 8 + F.col("col")).alias("k"))

    def label(batches):
        for b in batches:
            out = []
            for i, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.full((10, 10), 99)
                inside = np.zeros((10, 10), bool)
                for k in places:
                    part[k // 8 + 1, k % 8 + 1] = k
                    inside[k // 8 + 1, k % 8 + 1] = True
                while True:
                    near = np.minimum.reduce([np.roll(part, s, a) for s in (1, -1) for a in (0, 1)])
                    new = np.where(inside, np.minimum(part, near), 99)
                    if (new == part).all():
                        break
                    part = new
                names, sizes = np.unique(part[inside], return_counts=True)
                out += [(i, int(names[j]), int(sizes[j])) for j in np.lexsort((names, -sizes))[:2]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["vec_id", "part", "size"])

    return bright.mapInArrow(label, "vec_id long, part int, size long")


@query("export_text", f"{PAT}, {PROFILE} SELECT vec_id, r, round(s, 6) AS s FROM profile")
def export_text(spark, sf_dir):
    """Profiles written as text, one folder for each hundred points, and read back."""
    path = work_path(spark, "export")
    rows = rounded(profiles(spark, sf_dir), ["vec_id", "r"], ["s"]).withColumn("part", F.expr("vec_id div 100"))
    rows.write.partitionBy("part").option("header", True).csv(path)
    return spark.read.schema("vec_id long, r int, s double").option("header", True).csv(path).select("vec_id", "r", "s")
