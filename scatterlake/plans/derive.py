"""Derived results, volume masks, segmentation and fluorescence spectra."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from scatterlake.operators import geometry as G
from scatterlake.operators import model as M
from scatterlake.operators import project as P
from scatterlake.operators.ranks import ranked
from scatterlake.plans.grid import EXP_SQL, SIMPSON_SQL, exponents, rounded
from scatterlake.plans.registry import query
from scatterlake.session import table
from scatterlake.sources import samples
from scatterlake.sources.standins import FRAME_SQL, PATTERN_SQL, frames, patterns

VOX = f"WITH voxel AS ({samples.VOXEL_SQL})"
NY = samples.NY_SQL
SQ = "(a2 * a2 + a4 * a4 + a6 * a6)"


def voxels(spark, sf_dir):
    return samples.volume(spark, sf_dir).rows


def anisotropy():
    high = sum((F.col(c) * F.col(c) for c in ("a4", "a6")), F.col("a2") * F.col("a2"))
    return high / (high + F.col("a0") * F.col("a0"))


@query("doo", f"{VOX} SELECT iy, ix, iz, round({SQ} / (a0 * a0 + {SQ}) * mask, 9) AS doo FROM voxel")
def doo(spark, sf_dir):
    return rounded(voxels(spark, sf_dir).withColumn("doo", anisotropy() * F.col("mask")), ["iy", "ix", "iz"], ["doo"], 9)


@query("a_ratio", f"{VOX} SELECT iy, ix, iz, round({SQ} / (a0 * a0 + {SQ}), 9) AS ratio FROM voxel")
def a_ratio(spark, sf_dir):
    return rounded(voxels(spark, sf_dir).withColumn("ratio", anisotropy()), ["iy", "ix", "iz"], ["ratio"], 9)


Y = "(a0 * 0.5 / sqrt(pi()) + a2 * sqrt(5 / pi()) * (0.75 * c ** 2 - 0.25) + a4 * sqrt(1 / pi()) * (9e0 / 16 - 45e0 / 8 * c ** 2 + 105e0 / 16 * c ** 4) + a6 * sqrt(13 / pi()) * (-5e0 / 32 + 105e0 / 32 * c ** 2 - 315e0 / 32 * c ** 4 + 231e0 / 32 * c ** 6))"


@query("doa_sh", f"{VOX}, node AS ({SIMPSON_SQL}) SELECT iy, ix, iz, round((3 * sum(w * sin(t) * c * c * {Y} ** 2) / sum(w * sin(t) * {Y} ** 2) - 1) / 2, 6) AS doa FROM voxel, (SELECT *, cos(t) AS c FROM node) GROUP BY iy, ix, iz")
def doa_sh(spark, sf_dir):
    rows = voxels(spark, sf_dir).withColumn("doa", M.harmonic_order())
    return rounded(rows, ["iy", "ix", "iz"], ["doa"])


@query("doa_exp", f"WITH node AS ({SIMPSON_SQL}), {EXP_SQL} SELECT vec_id, round((3 * sum(w * sin(t) * cos(t) ** 2 * exp(-b * sin(t) ** 2)) / sum(w * sin(t) * exp(-b * sin(t) ** 2)) - 1) / 2, 6) + 0.0 AS doa FROM e, node GROUP BY vec_id")
def doa_exp(spark, sf_dir):
    b = F.col("B")
    rows = exponents(spark, sf_dir).select("vec_id", M.nematic_order(lambda x: F.exp(-b * F.sin(x) * F.sin(x))).alias("doa"))
    return rounded(rows, ["vec_id"], ["doa"])


@query("angles_pi", f"{VOX} SELECT iy, ix, iz, round(4 * theta - pi() * floor(4 * theta / pi()), 6) AS theta, round(9 * phi - pi() * floor(9 * phi / pi()), 6) AS phi FROM voxel")
def angles_pi(spark, sf_dir):
    pi = F.lit(math.pi)
    rows = voxels(spark, sf_dir).select("iy", "ix", "iz", F.pmod(4 * F.col("theta"), pi).alias("theta"), F.pmod(9 * F.col("phi"), pi).alias("phi"))
    return rounded(rows, ["iy", "ix", "iz"], ["theta", "phi"])


@query("vtk_vectors", f"{VOX}, m AS (SELECT *, {SQ} / (a0 * a0 + {SQ}) AS m FROM voxel) SELECT iy, ix, iz, round(CASE WHEN m BETWEEN 0.1 AND 0.14 THEN m * sin(theta) * sin(phi) ELSE 0 END, 9) + 0.0 AS vy, round(CASE WHEN m BETWEEN 0.1 AND 0.14 THEN m * sin(theta) * cos(phi) ELSE 0 END, 9) + 0.0 AS vx, round(CASE WHEN m BETWEEN 0.1 AND 0.14 THEN m * cos(theta) ELSE 0 END, 9) + 0.0 AS vz FROM m")
def vtk_vectors(spark, sf_dir):
    """Orientation vectors of the length of the anisotropy; outside the thresholds zero."""
    rows = voxels(spark, sf_dir).select("iy", "ix", "iz", *G.axis_columns(), anisotropy().alias("m"))
    length = F.when(F.col("m").between(0.1, 0.14), F.col("m")).otherwise(0.0)
    out = rows.select("iy", "ix", "iz", *((length * F.col(f"u{c}")).alias(f"v{c}") for c in "yxz"))
    return rounded(out, ["iy", "ix", "iz"], ["vy", "vx", "vz"], 9)


TENSOR = "SELECT iy, ix, iz, a0 + 1 AS xx, a0 AS yy, a2 + 2 AS zz, a4 / 2 AS xy, a6 AS xz, a4 / 4 AS yz FROM voxel"


def tensors(spark, sf_dir):
    return voxels(spark, sf_dir).select(
        "iy", "ix", "iz", (F.col("a0") + 1).alias("xx"), F.col("a0").alias("yy"), (F.col("a2") + 2).alias("zz"),
        (F.col("a4") / 2).alias("xy"), F.col("a6").alias("xz"), (F.col("a4") / 4).alias("yz"),
    )


@query("frac_aniso", f"{VOX}, t AS ({TENSOR}) SELECT iy, ix, iz, round(sqrt(greatest(0, 1.5 * (1 - (xx + yy + zz) ** 2 / 3 / (xx ** 2 + yy ** 2 + zz ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2))))), 9) AS fa FROM t")
def frac_aniso(spark, sf_dir):
    """From the trace and the squared norm: no eigenvalue is needed."""
    c = F.col
    trace = c("xx") + c("yy") + c("zz")
    norm = c("xx") ** 2 + c("yy") ** 2 + c("zz") ** 2 + 2 * (c("xy") ** 2 + c("xz") ** 2 + c("yz") ** 2)
    fa = F.sqrt(F.greatest(F.lit(0.0), 1.5 * (1 - trace * trace / 3 / norm)))
    return rounded(tensors(spark, sf_dir).withColumn("fa", fa), ["iy", "ix", "iz"], ["fa"], 9)


def eigenvalues():
    """l1 >= l2 >= l3 of a symmetric 3 x 3 tensor in closed form, as columns."""
    c = F.col
    q = (c("xx") + c("yy") + c("zz")) / 3
    off = c("xy") ** 2 + c("xz") ** 2 + c("yz") ** 2
    p = F.sqrt(((c("xx") - q) ** 2 + (c("yy") - q) ** 2 + (c("zz") - q) ** 2 + 2 * off) / 6)
    x, y, z = c("xx") - q, c("yy") - q, c("zz") - q
    det = x * (y * z - c("yz") ** 2) - c("xy") * (c("xy") * z - c("yz") * c("xz")) + c("xz") * (c("xy") * c("yz") - y * c("xz"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det / 2, p**3), F.lit(1.0))))) / 3
    l1 = q + 2 * p * F.cos(angle)
    l3 = q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return l1, 3 * q - l1 - l3, l3


EIGEN_SQL = """SELECT iy, ix, iz, q + 2 * p * cos(f) AS l1, 3 * q - (q + 2 * p * cos(f)) - (q + 2 * p * cos(f + 2 * pi() / 3)) AS l2, q + 2 * p * cos(f + 2 * pi() / 3) AS l3 FROM (
  SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz ** 2) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / 2 / p ** 3))) / 3 AS f
  FROM (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM t))"""


@query("tensor_to_sh", f"{VOX}, t AS ({TENSOR}), e AS ({EIGEN_SQL}) SELECT iy, ix, iz, round(sqrt(greatest(l1, 0)), 6) AS s1, round(sqrt(greatest(l2, 0)), 6) AS s2, round(sqrt(greatest(l3, 0)), 6) AS s3, CASE WHEN l1 - l2 >= l2 - l3 THEN 1 ELSE 3 END AS axis FROM e")
def tensor_to_sh(spark, sf_dir):
    """Roots of the non-negative eigenvalues; the axis is the end of the larger gap."""
    l1, l2, l3 = eigenvalues()
    rows = tensors(spark, sf_dir).select("iy", "ix", "iz", l1.alias("l1"), l2.alias("l2"), l3.alias("l3"))
    axis = F.when(F.col("l1") - F.col("l2") >= F.col("l2") - F.col("l3"), 1).otherwise(3)
    rows = rows.select("iy", "ix", "iz", axis.alias("axis"), *(F.sqrt(F.greatest(F.col(f"l{k}"), F.lit(0.0))).alias(f"s{k}") for k in (1, 2, 3)))
    return rounded(rows, ["iy", "ix", "iz", "axis"], ["s1", "s2", "s3"])


@query("eig_field")
def eig_field(spark, sf_dir):
    """The first eigenvector times its eigenvalue within thresholds, by numpy on Arrow batches.

    Signs of eigenvectors are free, so no SQL oracle; the largest component is made positive.
    """
    import numpy as np
    import pyarrow as pa

    def solve(batches):
        for b in batches:
            c = {n: b.column(n).to_numpy() for n in b.schema.names}
            m = np.stack([np.stack([c[x] for x in r], -1) for r in (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))], -2)
            values, vectors = np.linalg.eigh(m)
            top = vectors[..., -1]
            top = top * np.sign(np.take_along_axis(top, np.abs(top).argmax(-1)[:, None], -1)) * np.where((values[:, -1] > 1) & (values[:, -1] < 4), values[:, -1], 0)[:, None]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("iy", "ix", "iz")), *(pa.array(top[:, k]) for k in range(3))], ["iy", "ix", "iz", "vx", "vy", "vz"])

    return tensors(spark, sf_dir).mapInArrow(solve, "iy int, ix int, iz int, vx double, vy double, vz double")


@query("angle_err", f"{VOX} SELECT iy, ix, iz, round(least(abs(phi - 3 * theta), abs(pi() - abs(phi - 3 * theta))), 6) AS err FROM voxel")
def angle_err(spark, sf_dir):
    d = F.abs(F.col("phi") - 3 * F.col("theta"))
    return rounded(voxels(spark, sf_dir).withColumn("err", F.least(d, F.abs(math.pi - d))), ["iy", "ix", "iz"], ["err"])


@query("valid_summary", f"{VOX} SELECT param, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM (UNPIVOT (SELECT a0, a2, theta FROM voxel WHERE mask = 1) ON a0, a2, theta INTO NAME param VALUE v) GROUP BY param")
def valid_summary(spark, sf_dir):
    rows = voxels(spark, sf_dir).where(F.col("mask") == 1).select(F.expr("stack(3, 'a0', a0, 'a2', a2, 'theta', theta) AS (param, v)"))
    return rows.groupBy("param").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("run_summary", "SELECT event_type AS run, round(arg_max(value, event_id), 6) AS last_loss, count(*) AS iterations, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS seconds FROM events GROUP BY event_type")
def run_summary(spark, sf_dir):
    """Last loss, iterations and time of every run; event types stand in for runs."""
    e = table(spark, sf_dir, "events")
    seconds = F.unix_timestamp(F.date_trunc("second", F.max("ts"))) - F.unix_timestamp(F.date_trunc("second", F.min("ts")))
    return e.groupBy(F.col("event_type").alias("run")).agg(F.round(F.max_by("value", "event_id"), 6).alias("last_loss"), F.count(F.lit(1)).alias("iterations"), seconds.alias("seconds"))


# --- volume and projection masks ------------------------------------------------
@query("otsu", f"""{VOX}, e AS (SELECT min(a0) AS lo, max(a0) AS hi FROM voxel), h AS (SELECT least(199, CAST(floor((a0 - lo) / (hi - lo) * 200) AS INTEGER)) AS b, count(*) AS c FROM voxel, e GROUP BY b),
r AS (SELECT b, sum(c) OVER (ORDER BY b) AS w0, sum(c * b) OVER (ORDER BY b) AS m0, sum(c) OVER () AS w, sum(c * b) OVER () AS m FROM h), v AS (SELECT b, w0 * (w - w0) * (m0 / w0 - (m - m0) / nullif(w - w0, 0)) ** 2 AS s FROM r)
SELECT CAST(min(b) AS INTEGER) AS bin FROM v WHERE s >= (SELECT max(s) FROM v) * (1 - 1e-9)""")
def otsu(spark, sf_dir):
    """The threshold bin of 200 that separates best: running sums over at most 200 rows."""
    v = voxels(spark, sf_dir)
    ends = F.broadcast(v.agg(F.min("a0").alias("lo"), F.max("a0").alias("hi")))
    b = F.least(F.lit(199), F.floor((F.col("a0") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 200).cast("int"))
    h = v.crossJoin(ends).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    run, whole = Window.orderBy("b"), Window.partitionBy()
    r = h.select("b", F.sum("c").over(run).alias("w0"), F.sum(F.col("c") * F.col("b")).over(run).alias("m0"), F.sum("c").over(whole).alias("w"), F.sum(F.col("c") * F.col("b")).over(whole).alias("m"))
    gap = F.col("m0") / F.col("w0") - F.try_divide((F.col("m") - F.col("m0")).cast("double"), F.col("w") - F.col("w0"))
    r = r.withColumn("s", F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap)
    best = F.broadcast(r.agg(F.max("s").alias("top")))
    return r.crossJoin(best).where(F.col("s") >= F.col("top") * (1 - 1e-9)).agg(F.min("b").alias("bin"))


def _smooth(df, value, bounds):
    for axis, ends in bounds.items():
        others = [c for c in ("slab", "iy", "ix", "iz") if c != axis and c in df.columns]
        df = P.stencil(df, [axis], [value], [(-1, 0.25), (0, 0.5), (1, 0.25)], {axis: ends}, others)
    return df


@query("mask3d", f"""{VOX}, k(o, w) AS (VALUES (-1, 25e-2), (0, 5e-1), (1, 25e-2)), s AS (SELECT v.iy + a.o AS iy, v.ix + b.o AS ix, v.iz + c.o AS iz, sum(a0 * mask * a.w * b.w * c.w) AS f FROM voxel v, k a, k b, k c GROUP BY ALL),
m AS (SELECT iy, ix, iz, CASE WHEN f > 0.5 THEN 1e0 ELSE 0e0 END AS f FROM s WHERE iy BETWEEN 1 AND {NY} AND ix BETWEEN 1 AND 8 AND iz BETWEEN 1 AND 8),
t AS (SELECT v.iy + a.o AS iy, v.ix + b.o AS ix, v.iz + c.o AS iz, sum(f * a.w * b.w * c.w) AS f FROM m v, k a, k b, k c GROUP BY ALL)
SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, CAST(iz AS INTEGER) AS iz, CASE WHEN f > 0.5 THEN 1 ELSE 0 END AS mask FROM t WHERE iy BETWEEN 1 AND {NY} AND ix BETWEEN 1 AND 8 AND iz BETWEEN 1 AND 8""")
def mask3d(spark, sf_dir):
    """Smooth, cut, smooth again, cut at one half."""
    v = samples.volume(spark, sf_dir, halo=2, each=2_048)
    rows = _smooth(v.rows.select("slab", "iy", "ix", "iz", (F.col("a0") * F.col("mask")).alias("f")), "f", v.bounds)
    # of the halo, the first smoothing leaves one slice right, which the second one needs
    rows = _smooth(rows.withColumn("f", F.when(F.col("f") > 0.5, 1.0).otherwise(0.0)), "f", v.bounds).where(P.own())
    return rows.select("iy", "ix", "iz", F.when(F.col("f") > 0.5, 1).otherwise(0).alias("mask"))


@query("needle_mask", f"""{VOX}, m AS (SELECT iy, ix, iz, CASE WHEN a0 > 1.1 AND NOT (iy <= 2 AND ix >= 8) THEN 1 ELSE 0 END AS m FROM voxel),
o AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(3) a, range(3) b),
d AS (SELECT a.iy, a.ix, a.iz, max(b.m) AS m FROM (SELECT iy, ix, iz, iy + dy AS ny, ix + dx AS nx FROM m, o) a JOIN m b ON b.iy = a.ny AND b.ix = a.nx AND b.iz = a.iz GROUP BY ALL),
e AS (SELECT a.iy, a.ix, a.iz, min(b.m) AS m FROM (SELECT iy, ix, iz, iy + dy AS ny, ix + dx AS nx FROM d, o) a JOIN d b ON b.iy = a.ny AND b.ix = a.nx AND b.iz = a.iz GROUP BY ALL) SELECT * FROM e""")
def needle_mask(spark, sf_dir):
    """Threshold, keep-out box, then closing: the largest and then the least of each 3 x 3 neighbourhood."""
    box = (F.col("iy") <= 2) & (F.col("ix") >= 8)
    v = samples.volume(spark, sf_dir)
    rows = v.rows.select("iy", "ix", "iz", F.when((F.col("a0") > 1.1) & ~box, 1).otherwise(0).alias("m"))
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    for pick in (F.max, F.min):
        moved = rows.withColumn("o", F.explode(around)).select((F.col("iy") + F.col("o.a")).alias("iy"), (F.col("ix") + F.col("o.b")).alias("ix"), "iz", "m")
        rows = moved.where(F.col("iy").between(*v.bounds["iy"]) & F.col("ix").between(*v.bounds["ix"])).groupBy("iy", "ix", "iz").agg(pick("m").alias("m"))
    return rows


PATS = f"WITH pattern AS ({PATTERN_SQL}), frame AS ({FRAME_SQL})"


@query("air_norm", f"{PATS}, a AS (SELECT seg, median(i) AS air FROM pattern WHERE i >= 0 AND vec_id % 10 IN (0, 9) GROUP BY seg) SELECT vec_id, r, seg, round(i / air, 6) AS i FROM pattern JOIN a USING (seg) WHERE i >= 0")
def air_norm(spark, sf_dir):
    """Each segment over the median of the edge columns."""
    p = patterns(spark, sf_dir).where(F.col("i") >= 0)
    air = p.where((F.col("vec_id") % 10).isin(0, 9)).groupBy("seg").agg(F.percentile("i", 0.5).alias("air"))
    return rounded(p.join(F.broadcast(air), "seg").withColumn("i", F.col("i") / F.col("air")), ["vec_id", "r", "seg"], ["i"])


@query("diode_filter", f"{PATS}, o AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(3) a, range(3) b) SELECT t.vec_id, t.row, t.col, round(median(f.counts), 6) AS v FROM frame t, o JOIN frame f ON f.vec_id = t.vec_id AND f.row = greatest(0, least(7, t.row + dy)) AND f.col = greatest(0, least(7, t.col + dx)) GROUP BY ALL")
def diode_filter(spark, sf_dir):
    """3 x 3 median with the edge replicated, from each frame's own array."""
    f = frames(spark, sf_dir)
    packed = f.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct((F.col("row") * 8 + F.col("col")).alias("k"), "counts"))).alias("f"))
    rows = packed.select("vec_id", "f", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    row, col = F.expr("CAST(k div 8 AS INT)"), F.col("k") % 8
    hold = lambda v: F.greatest(F.lit(0), F.least(F.lit(7), v))
    near = F.array_sort(F.array(*(F.get(F.col("f"), hold(row + a) * 8 + hold(col + b))["counts"] for a in (-1, 0, 1) for b in (-1, 0, 1))))
    return rows.select("vec_id", row.alias("row"), col.alias("col"), F.round(F.get(near, F.lit(4)), 6).alias("v"))


@query("sector_avg", f"{PATS} SELECT vec_id, r, CAST(seg // 2 AS INTEGER) AS pair, round(sum(i * n) / sum(n), 6) AS i FROM pattern WHERE i >= 0 GROUP BY ALL")
def sector_avg(spark, sf_dir):
    p = patterns(spark, sf_dir).where(F.col("i") >= 0)
    mean = F.sum(F.col("i") * F.col("n")) / F.sum("n")
    return rounded(p.groupBy("vec_id", "r", F.expr("CAST(seg div 2 AS INT)").alias("pair")).agg(mean.alias("i")), ["vec_id", "r", "pair"], ["i"])


@query("pad", f"{PATS}, e AS (SELECT vec_id, CAST(a.range AS INTEGER) AS row, CAST(b.range AS INTEGER) AS col FROM (SELECT DISTINCT vec_id FROM frame), range(9) a, range(10) b) SELECT vec_id, row, col, coalesce(counts, 1) AS v FROM e LEFT JOIN frame USING (vec_id, row, col)")
def pad(spark, sf_dir):
    """To 9 x 10, the width even, filled with 1."""
    f = frames(spark, sf_dir)
    grid = spark.range(90).select(F.expr("CAST(id div 10 AS INT)").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    full = f.select("vec_id").distinct().crossJoin(F.broadcast(grid))
    return full.join(f, ["vec_id", "row", "col"], "left").select("vec_id", "row", "col", F.coalesce("counts", F.lit(1.0)).alias("v"))


@query("plan_tilts", f"WITH pose AS ({samples.POSE_SQL}) SELECT p, round(rot_x, 6) AS tilt, CAST(ceil(pi() * 30 / 2 * cos(radians(rot_x))) AS INTEGER) AS projections FROM pose")
def plan_tilts(spark, sf_dir):
    """Projections for the tilt of each pose: the count at zero tilt, pi n / 2, shrinks with its cosine."""
    count = F.ceil(math.pi * 30 / 2 * F.cos(F.radians("rot_x"))).cast("int")
    return samples.poses(spark, sf_dir).select("p", F.round("rot_x", 6).alias("tilt"), count.alias("projections"))


# --- segmentation ------------------------------------------------------------------
CURVE = "curve AS (SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings))"


def curves(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


@query("curve_prep", f"WITH {CURVE}, s AS (SELECT vec_id, k, avg(v) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM curve), d AS (SELECT *, s - lag(s) OVER w AS d1 FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, k, round(s, 6) + 0.0 AS s, round(d1, 6) + 0.0 AS d1, round(d1 - lag(d1) OVER (PARTITION BY vec_id ORDER BY k), 6) + 0.0 AS d2 FROM d")
def curve_prep(spark, sf_dir):
    """Five-point moving average with shrinking ends, first and second difference."""
    w = Window.partitionBy("vec_id").orderBy("k")
    rows = curves(spark, sf_dir).withColumn("s", F.avg("v").over(w.rowsBetween(-2, 2)))
    rows = rows.withColumn("d1", F.col("s") - F.lag("s").over(w))
    rows = rows.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    return rounded(rows, ["vec_id", "k"], ["s", "d1", "d2"])


@query("zero_cross", f"WITH {CURVE}, n AS (SELECT *, coalesce(lead(v) OVER w, first_value(v) OVER w) AS next FROM curve WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, k, round(v, 6) + 0.0 AS v FROM n WHERE v * next <= 0")
def zero_cross(spark, sf_dir):
    """Sign changes, the last point followed by the first."""
    w = Window.partitionBy("vec_id").orderBy("k")
    rows = curves(spark, sf_dir).withColumn("next", F.coalesce(F.lead("v").over(w), F.first("v").over(w)))
    return rounded(rows.where(F.col("v") * F.col("next") <= 0), ["vec_id", "k"], ["v"])


@query("pca")
def pca(spark, sf_dir):
    """Components of the uncentred second moments: they are summed in one pass, 64 x 64 at the driver.

    (component, share, k, weight), the largest weight of a component positive.
    """
    import numpy as np
    import pyarrow as pa

    size = 64

    def moments(batches):
        total = np.zeros((size, size))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["k", "v"])

    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == size).select("embedding")
    sums = rows.mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros(size * size)
    m[sums["k"]] = sums["v"]
    values, vectors = np.linalg.eigh(m.reshape(size, size))
    out = []
    for c in range(8):
        v = vectors[:, -1 - c]
        v = v * np.sign(v[np.abs(v).argmax()])
        out += [(c, float(values[-1 - c] / values.sum()), k, float(x)) for k, x in enumerate(v)]
    return spark.createDataFrame(out, "component int, share double, k int, weight double")


@query("kmeans")
def kmeans(spark, sf_dir):
    """(vec_id, cluster) by k-means++ with the best silhouette over k = 2..6, seeded."""
    from pyspark import StorageLevel
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    rows = rows.persist(StorageLevel.DISK_ONLY)  # read by every fit; released before the winner labels the table
    best = None
    for k in range(2, 7):
        model = KMeans(k=k, seed=7, initMode="k-means||").fit(rows)
        score = ClusteringEvaluator().evaluate(model.transform(rows))
        if best is None or score > best[0]:
            best = (score, model)
    rows.unpersist()
    return best[1].transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query("rep_signals", f"""WITH {CURVE}, c AS (SELECT label, k, avg(v) AS m FROM curve JOIN embeddings USING (vec_id) GROUP BY label, k), d AS (SELECT vec_id, sum(dist) AS t FROM (SELECT vec_id, c.label, sqrt(sum((v - m) ** 2)) AS dist FROM curve JOIN c USING (k) GROUP BY vec_id, c.label) GROUP BY vec_id),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(t, 9) DESC, vec_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM d JOIN embeddings USING (vec_id)) SELECT label, k, round(median(v), 6) + 0.0 AS v FROM curve JOIN r USING (vec_id) WHERE p <= ceil(n / 5) GROUP BY label, k""")
def rep_signals(spark, sf_dir):
    """The fifth of each cluster that is farthest from all centroids together, and its median curve."""
    rows = curves(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    centroids = rows.join(labels, "vec_id").groupBy("label", "k").agg(F.avg("v").alias("m"))
    square = F.sum((F.col("v") - F.col("m")) ** 2)
    far = rows.join(P.checked_broadcast(centroids), "k").groupBy("vec_id", "label").agg(F.sqrt(square).alias("d")).groupBy("vec_id").agg(F.sum("d").alias("t"))
    places = ranked(far.join(labels, "vec_id").withColumn("t", F.round("t", 9)), "label", [F.desc("t"), F.asc("vec_id")])
    chosen = places.where(F.col("p") <= F.ceil(F.col("n") / 5)).select("vec_id", "label")
    return rounded(rows.join(chosen, "vec_id").groupBy("label", "k").agg(F.percentile("v", 0.5).alias("v")), ["label", "k"], ["v"])


# --- fluorescence ---------------------------------------------------------------------
@query("dead_time", f"{PATS} SELECT vec_id, row AS detector, col AS channel, round(counts * (1 + (vec_id % 7) / 1e2) / (1 - row / 1e2), 6) AS c FROM frame")
def dead_time(spark, sf_dir):
    """Counts x real / live, keyed by point and detector."""
    f = frames(spark, sf_dir)
    timing = f.select("vec_id", "row").distinct().withColumn("real", 1 + (F.col("vec_id") % 7) / 100).withColumn("live", 1 - F.col("row") / 100)
    rows = f.join(timing, ["vec_id", "row"]).withColumn("c", F.col("counts") * F.col("real") / F.col("live"))
    return rounded(rows.select("vec_id", F.col("row").alias("detector"), F.col("col").alias("channel"), "c"), ["vec_id", "detector", "channel"], ["c"])


@query("calib_fit", f"{PATS}, s AS (SELECT row, col, sum(counts) AS t FROM frame GROUP BY row, col), p AS (SELECT row, min(col) AS ch FROM (SELECT *, max(t) OVER (PARTITION BY row) AS top FROM s) WHERE t = top GROUP BY row) SELECT round(regr_slope(row * 1.5 + 2, ch), 6) + 0.0 AS gain, round(regr_intercept(row * 1.5 + 2, ch), 6) + 0.0 AS zero FROM p")
def calib_fit(spark, sf_dir):
    """A line from the strongest channel of each detector to a known energy."""
    total = frames(spark, sf_dir).groupBy("row", "col").agg(F.sum("counts").alias("t"))
    peak = total.groupBy("row").agg(F.min(F.struct((-F.col("t")).alias("t"), "col")).alias("p"))
    energy, channel = F.col("row") * 1.5 + 2, F.col("p.col").cast("double")
    return rounded(peak.agg(F.regr_slope(energy, channel).alias("gain"), F.regr_intercept(energy, channel).alias("zero")), [], ["gain", "zero"])


LINES = [("Fe Ka", 6.404), ("Cu Ka", 8.048), ("Zn Ka", 8.639), ("Ca Ka", 3.692), ("S Ka", 2.308)]


@query("line_id", "WITH l(n, name, e) AS (VALUES (0, 'Fe Ka', 6.404), (1, 'Cu Ka', 8.048), (2, 'Zn Ka', 8.639), (3, 'Ca Ka', 3.692), (4, 'S Ka', 2.308)), p AS (SELECT event_id, 2 + value - 7 * floor(value / 7) AS x FROM events WHERE value IS NOT NULL), d AS (SELECT event_id, name, row_number() OVER (PARTITION BY event_id ORDER BY abs(x - e), n) AS r FROM p, l) SELECT event_id, name FROM d WHERE r = 1")
def line_id(spark, sf_dir):
    """The nearest known line to each event's energy (its value folded to 2-9), the first on ties; known lines are a fixed list."""
    known = F.array(*(F.struct(F.abs(F.col("x") - e).alias("d"), F.lit(n).alias("n"), F.lit(name).alias("name")) for n, (name, e) in enumerate(LINES)))
    energy = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).select("event_id", (2 + F.col("value") - 7 * F.floor(F.col("value") / 7)).alias("x"))
    return energy.select("event_id", F.array_min(known)["name"].alias("name"))


@query("band_map", f"{PATS}, b(band, centre, width) AS (VALUES ('a', 10, 5), ('b', 31, 9), ('c', 60, 4)) SELECT vec_id, band, sum(counts) AS total FROM frame JOIN b ON row * 8 + col BETWEEN centre - round(width / 2) AND centre + round(width / 2) GROUP BY vec_id, band")
def band_map(spark, sf_dir):
    """Channels centre +- round(width / 2) summed by point: each band becomes its list of channels."""
    bands = spark.createDataFrame([("a", 10, 5), ("b", 31, 9), ("c", 60, 4)], "band string, centre int, width int")
    half = F.round(F.col("width") / 2).cast("int")
    channels = bands.select("band", F.explode(F.sequence(F.col("centre") - half, F.col("centre") + half)).alias("ch"))
    rows = frames(spark, sf_dir).select("vec_id", (F.col("row") * 8 + F.col("col")).alias("ch"), "counts")
    return rows.join(F.broadcast(channels), "ch").groupBy("vec_id", "band").agg(F.sum("counts").alias("total"))
