"""Queries over the sample volume and the stage's poses: geometry, models, projections, errors, gradients.

The volume is read from ``embeddings`` and grows with it (sources/samples.py);
few projections of the instrument's geometry look at it.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scatterlake.operators import geometry as G
from scatterlake.operators import model as M
from scatterlake.operators import project as P
from scatterlake.plans.registry import query
from scatterlake.session import table
from scatterlake.sources import generate, samples
from scatterlake.sources.samples import COLUMNS as IX
from scatterlake.sources.samples import NY_SQL as NY
from scatterlake.sources.samples import SIDE

NP, SEG = 4, 8
R = 6  # decimals that are compared
ORDERS = (0, 2, 4, 6)
S = [f"s{k}" for k in range(SEG)]


def rounded(df, keys, values, places=R):
    return df.select(*keys, *((F.round(F.col(v), places) + F.lit(0.0)).alias(v) for v in values))


# --- DuckDB building blocks, written apart from the Spark side ---------------
PROJ_SQL = f"SELECT CAST(range AS INTEGER) AS p, 11e0 * range AS rot_x, 23e0 * range AS rot_y, 25e-2 * range AS dx, -125e-3 * range AS dy FROM range({NP})"
ROT_SQL = """SELECT p, dx, dy, cos(b) AS r11, 0e0 AS r12, sin(b) AS r13, sin(a) * sin(b) AS r21, cos(a) AS r22, -sin(a) * cos(b) AS r23,
  -cos(a) * sin(b) AS r31, sin(a) AS r32, cos(a) * cos(b) AS r33 FROM (SELECT *, radians(rot_x) AS a, radians(rot_y) AS b FROM proj)"""
SEG_SQL = f"SELECT CAST(range AS INTEGER) AS seg, radians(11.25e0 + 22.5e0 * range) AS phi_det, pi() / 2 AS theta_det FROM range({SEG})"
Q_SQL = """SELECT p, seg, r11 * bx + r21 * by_ + r31 * bz AS qx, r12 * bx + r22 * by_ + r32 * bz AS qy, r13 * bx + r23 * by_ + r33 * bz AS qz
  FROM rot, (SELECT seg, sin(theta_det) * cos(phi_det) AS bx, sin(theta_det) * sin(phi_det) AS by_, cos(theta_det) AS bz FROM seg)"""
MODEL_SQL = """SELECT iy, ix, iz, p, seg, c, amp, amp * amp AS i FROM (
  SELECT *, a0 * 0.5 / sqrt(pi()) + a2 * sqrt(5 / pi()) * (0.75 * c * c - 0.25)
   + a4 * sqrt(1 / pi()) * (9e0 / 16 - 45e0 / 8 * c ** 2 + 105e0 / 16 * c ** 4)
   + a6 * sqrt(13 / pi()) * (-5e0 / 32 + 105e0 / 32 * c ** 2 - 315e0 / 32 * c ** 4 + 231e0 / 32 * c ** 6) AS amp
  FROM (SELECT v.*, q.p, q.seg, sin(theta) * cos(phi) * qx + sin(theta) * sin(phi) * qy + cos(theta) * qz AS c FROM voxel v, q))"""
POINT_SQL = f"""SELECT v.iy, v.ix, v.iz, r.p, r11 * x + r12 * y + r13 * z + {(IX + 1) // 2} - dx AS xp, r21 * x + r22 * y + r23 * z + ({NY} + 1) // 2 - dy AS yp
  FROM (SELECT *, ix - {(SIDE + 1) // 2} AS x, iy - ({NY} + 1) // 2 AS y, iz - {(SIDE + 1) // 2} AS z FROM voxel) v, rot r"""
TAP_SQL = """SELECT *, CAST(floor(xp) AS INTEGER) + ox AS px, CAST(floor(yp) AS INTEGER) + oy AS py,
  (CASE ox WHEN 1 THEN xp - floor(xp) ELSE 1 - (xp - floor(xp)) END) * (CASE oy WHEN 1 THEN yp - floor(yp) ELSE 1 - (yp - floor(yp)) END) AS w
  FROM point, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(oy, ox)"""
FWD_SQL = f"""SELECT t.p, t.py AS y, t.px AS x, m.seg, sum(m.i * t.w) AS i FROM tap t JOIN model m USING (iy, ix, iz, p)
  WHERE floor(xp) > 0 AND floor(xp) < {IX} AND floor(yp) > 0 AND floor(yp) < {NY} GROUP BY ALL"""


def with_sql(select, *names, **more):
    known = {"voxel": samples.VOXEL_SQL, "proj": PROJ_SQL, "rot": ROT_SQL, "seg": SEG_SQL, "q": Q_SQL, "model": MODEL_SQL, "point": POINT_SQL, "tap": TAP_SQL, "fwd": FWD_SQL}
    return "WITH " + ", ".join([*(f"{n} AS ({known[n]})" for n in names), *(f"{n} AS ({sql})" for n, sql in more.items())]) + "\n" + select


ALL = ("voxel", "proj", "rot", "seg", "q", "model", "point", "tap", "fwd")


def r_(expr, name, places=R):
    return f"round({expr}, {places}) + 0.0 AS {name}"


# --- shared Spark inputs ------------------------------------------------------
def wide_directions(spark):
    """One row for each projection with the directions of all segments as columns."""
    q = G.directions(generate.projections(spark, NP), generate.segments(spark, SEG))
    return q.groupBy("p").pivot("seg", list(range(SEG))).agg(F.first("qx").alias("qx"), F.first("qy").alias("qy"), F.first("qz").alias("qz"))


def intensities(spark, volume):
    """point rows with s0..s7, the model intensity of each segment in the direction of each projection."""
    v = volume.rows.select("*", *G.axis_columns())
    points = P.hit_points(v, generate.projections(spark, NP), volume.shape, volume.ny, IX)
    met = points.join(P.checked_broadcast(wide_directions(spark)), "p")
    amp = [M.amplitude(M.cosine_to(f"{k}_qx", f"{k}_qy", f"{k}_qz")) for k in range(SEG)]
    return met.select(*points.columns, *((a * a).alias(s) for a, s in zip(amp, S, strict=True)))


def unpivot(df, keys):
    """Segments as rows, after the aggregation."""
    pairs = ", ".join(f"{k}, s{k}" for k in range(SEG))
    return df.select(*keys, F.expr(f"stack({SEG}, {pairs}) AS (seg, i)"))


def modelled(spark, volume):
    return unpivot(P.forward(intensities(spark, volume), S, volume.ny, IX), ["p", "y", "x"])


def measured(df):
    """A stand-in for data: the modelled images with a smooth error."""
    return df.withColumn("d", F.expr("i * (1e0 + 1e-1 * sin(p + y + 2 * x + 3 * seg))"))


MEASURED_SQL = "SELECT *, i * (1e0 + 1e-1 * sin(p + y + 2 * x + 3 * seg)) AS d FROM fwd"


# --- queries -------------------------------------------------------------------
@query("gen_sample", with_sql(f"SELECT iy, ix, iz, {r_('theta', 'theta')}, {r_('phi', 'phi')}, {r_('a0', 'a0')}, {r_('a2', 'a2')}, {r_('a4', 'a4')}, {r_('a6', 'a6')}, mask FROM voxel", "voxel"))
def gen_sample(spark, sf_dir):
    """The sample volume that all queries here look at, from the vectors' components."""
    return rounded(samples.volume(spark, sf_dir).rows, ["iy", "ix", "iz", "mask"], ["theta", "phi", "a0", "a2", "a4", "a6"])


@query("phantom", with_sql(f"""SELECT iy, ix, iz, v AS a0, round(v / 3, 6) AS a2, round(v / 6, 6) AS a4, round(v / 10000, 6) AS a6
FROM (SELECT iy, ix, iz, CASE WHEN iy BETWEEN {NY} // 4 + 1 AND {NY} - {NY} // 4 AND ix BETWEEN 3 AND 6 AND iz BETWEEN 3 AND 6 THEN 1e0 ELSE 0e0 END AS v FROM voxel)""", "voxel"))
def phantom(spark, sf_dir):
    """A box of intensity one in the sample's volume, empty elsewhere; higher orders are fixed fractions of it."""
    v = samples.volume(spark, sf_dir)
    inside = F.col("iy").between(v.ny // 4 + 1, v.ny - v.ny // 4) & F.col("ix").between(3, 6) & F.col("iz").between(3, 6)
    rows = v.rows.select("iy", "ix", "iz", F.when(inside, 1.0).otherwise(0.0).alias("a0"))
    return rounded(rows.select("*", (F.col("a0") / 3).alias("a2"), (F.col("a0") / 6).alias("a4"), (F.col("a0") / 10000).alias("a6")), ["iy", "ix", "iz"], ["a0", "a2", "a4", "a6"])


@query("crop", with_sql(f"SELECT iy, ix, iz, mask FROM voxel, (SELECT {NY} AS n, {NY} // 4 * 2 AS size) WHERE iy BETWEEN (n - size + 1) // 2 + 1 AND (n - size + 1) // 2 + size AND ix BETWEEN 3 AND 6", "voxel"))
def crop(spark, sf_dir):
    """The central even window of half the height and half the breadth: an odd rest goes below it."""
    v = samples.volume(spark, sf_dir)
    rows = v.rows
    for axis, n in (("iy", v.ny), ("ix", SIDE)):
        size = n // 4 * 2
        low = (n - size + 1) // 2 + 1
        rows = rows.where(F.col(axis).between(low, low + size - 1))
    return rows.select("iy", "ix", "iz", "mask")


@query("subcube", with_sql(f"SELECT iy, ix, iz, round(a0, 6) AS a0 FROM voxel WHERE iy BETWEEN {NY} // 3 AND 2 * ({NY} // 3) AND ix BETWEEN 3 AND 6 AND iz BETWEEN 3 AND 6", "voxel"))
def subcube(spark, sf_dir):
    """The region of interest: the middle third of the height, a margin of two voxels elsewhere."""
    v = samples.volume(spark, sf_dir)
    rows = v.rows.where(F.col("iy").between(v.ny // 3, 2 * (v.ny // 3)))
    for c in ("ix", "iz"):
        rows = rows.where(F.col(c).between(3, SIDE - 2))
    return rounded(rows, ["iy", "ix", "iz"], ["a0"])


@query("rot_matrix", f"WITH proj AS ({samples.POSE_SQL}), rot AS ({ROT_SQL}) SELECT p, " + ", ".join(r_(f"r{i}{j}", f"r{i}{j}", 9) for i in (1, 2, 3) for j in (1, 2, 3)) + " FROM rot")
def rot_matrix(spark, sf_dir):
    """The rotation of every pose of the stage."""
    rows = samples.poses(spark, sf_dir).select("p", *G.rotation_columns())
    return rounded(rows, ["p"], [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)], 9)


@query("q_dirs", f"WITH proj AS ({samples.POSE_SQL}), rot AS ({ROT_SQL}), seg AS ({SEG_SQL}), q AS ({Q_SQL}) SELECT p, seg, {r_('qx', 'qx', 9)}, {r_('qy', 'qy', 9)}, {r_('qz', 'qz', 9)} FROM q")
def q_dirs(spark, sf_dir):
    """The q direction of every segment at every pose of the stage."""
    return rounded(G.directions(samples.poses(spark, sf_dir), generate.segments(spark)), ["p", "seg"], ["qx", "qy", "qz"], 9)


@query("local_axis", with_sql(f"SELECT iy, ix, iz, {r_('sin(theta) * cos(phi)', 'ux')}, {r_('sin(theta) * sin(phi)', 'uy')}, {r_('cos(theta)', 'uz')} FROM voxel", "voxel"))
def local_axis(spark, sf_dir):
    return rounded(samples.volume(spark, sf_dir).rows.select("iy", "ix", "iz", *G.axis_columns()), ["iy", "ix", "iz"], ["ux", "uy", "uz"])


@query("page_mult", with_sql("SELECT v.iy, v.ix, v.iz, r.p, " + ", ".join(r_(f"r{k}1 * ix + r{k}2 * iy + r{k}3 * iz", f"y{k}") for k in (1, 2, 3)) + " FROM voxel v, rot r", "voxel", "proj", "rot"))
def page_mult(spark, sf_dir):
    """Each projection's matrix times each voxel's vector: a batched product as column expressions."""
    m = P.checked_broadcast(generate.projections(spark, NP).select("p", *G.rotation_columns()))
    rows = samples.volume(spark, sf_dir).rows.crossJoin(m)
    out = [(F.col(f"r{k}1") * F.col("ix") + F.col(f"r{k}2") * F.col("iy") + F.col(f"r{k}3") * F.col("iz")).alias(f"y{k}") for k in (1, 2, 3)]
    return rounded(rows.select("iy", "ix", "iz", "p", *out), ["iy", "ix", "iz", "p"], ["y1", "y2", "y3"])


@query("ylm", """
SELECT vec_id, CAST(k AS INTEGER) AS k, round(0.5 / sqrt(pi()), 9) AS y0, round(sqrt(5 / pi()) * (0.75 * c * c - 0.25), 9) + 0.0 AS y2,
 round(sqrt(1 / pi()) * (9e0 / 16 - 45e0 / 8 * c ** 2 + 105e0 / 16 * c ** 4), 9) + 0.0 AS y4,
 round(sqrt(13 / pi()) * (-5e0 / 32 + 105e0 / 32 * c ** 2 - 315e0 / 32 * c ** 4 + 231e0 / 32 * c ** 6), 9) + 0.0 AS y6
FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, cos(pi() * CAST(unnest(embedding) AS DOUBLE)) AS c FROM embeddings)""")
def ylm(spark, sf_dir):
    """The harmonics at the angle pi times each component of each vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    rows = rows.select("vec_id", "k", F.cos(F.lit(math.pi) * F.col("v").cast("double")).alias("c"))
    return rounded(rows.select("vec_id", "k", *(M.harmonic(n, F.col("c")).alias(f"y{n}") for n in ORDERS)), ["vec_id", "k"], ["y0", "y2", "y4", "y6"], 9)


@query("model_sh", with_sql(f"SELECT iy, ix, iz, p, seg, {r_('i', 'i')} FROM model", "voxel", "proj", "rot", "seg", "q", "model"))
def model_sh(spark, sf_dir):
    rows = intensities(spark, samples.volume(spark, sf_dir))
    return rounded(unpivot(rows, ["iy", "ix", "iz", "p"]), ["iy", "ix", "iz", "p", "seg"], ["i"])


SIMPSON_SQL = """SELECT range AS k, pi() * range / 500 AS t, CASE WHEN range IN (0, 500) THEN 1e0 WHEN range % 2 = 1 THEN 4e0 ELSE 2e0 END * pi() / 1500 AS w FROM range(501)"""


EXP_SQL = "e AS (SELECT vec_id, 1e0 + abs(CAST(embedding[1] AS DOUBLE)) AS a, 1e1 * abs(CAST(embedding[2] AS DOUBLE)) AS b, cos(3e0 * CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings)"


def exponents(spark, sf_dir):
    """(vec_id, A, B, c): amplitude, width and cosine of the exponential model, from three components of each vector."""
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", (1.0 + F.abs(e(0))).alias("A"), (10.0 * F.abs(e(1))).alias("B"), F.cos(3.0 * e(2)).alias("c"))


@query("model_exp", "WITH node AS (" + SIMPSON_SQL + "), " + EXP_SQL + ", n AS (SELECT vec_id, 2 * pi() * sum(w * sin(t) * exp(-abs(b) * sin(t) ** 2)) AS norm FROM e, node GROUP BY vec_id) SELECT vec_id, round(a * a * exp(-abs(b) * (1 - c * c)) / norm, 6) AS i FROM e JOIN n USING (vec_id)")
def model_exp(spark, sf_dir):
    e = exponents(spark, sf_dir)
    return rounded(e.select("vec_id", M.exponential(F.col("c")).alias("i")), ["vec_id"], ["i"])


@query("fwd_project", with_sql(f"SELECT p, y, x, seg, {r_('i', 'i')} FROM fwd", *ALL))
def fwd_project(spark, sf_dir):
    return rounded(modelled(spark, samples.volume(spark, sf_dir)), ["p", "y", "x", "seg"], ["i"])


@query("fwd_nearest", with_sql(f"""SELECT t.p, t.y, t.x, m.seg, round(sum(m.i), {R}) + 0.0 AS i
FROM (SELECT *, CAST(floor(yp + 0.5) AS INTEGER) AS y, CAST(floor(xp + 0.5) AS INTEGER) AS x FROM point) t JOIN model m USING (iy, ix, iz, p)
WHERE t.x BETWEEN 1 AND {IX} AND t.y BETWEEN 1 AND {NY} GROUP BY t.p, t.y, t.x, m.seg""", *ALL[:7]))
def fwd_nearest(spark, sf_dir):
    volume = samples.volume(spark, sf_dir)
    rows = P.forward_nearest(intensities(spark, volume), S, volume.ny, IX)
    return rounded(unpivot(rows, ["p", "y", "x"]), ["p", "y", "x", "seg"], ["i"])


@query("filter2d", with_sql(f"""SELECT p, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, seg, round(sum(i * w), {R}) + 0.0 AS i
FROM fwd, (SELECT a.o AS dy, b.o AS dx, a.f * b.f / 4e0 AS w FROM (VALUES (-1, 5e-1), (0, 1e0), (1, 5e-1)) a(o, f), (VALUES (-1, 5e-1), (0, 1e0), (1, 5e-1)) b(o, f)) k
WHERE y + dy BETWEEN 1 AND {NY} AND x + dx BETWEEN 1 AND {IX} GROUP BY ALL""", *ALL))
def filter2d(spark, sf_dir):
    volume = samples.volume(spark, sf_dir)
    images = P.forward(intensities(spark, volume), S, volume.ny, IX)
    rows = P.stencil(images, ["y", "x"], S, P.filter_offsets(2), {"y": (1, volume.ny), "x": (1, IX)}, ["p"])
    return rounded(unpivot(rows, ["p", "y", "x"]), ["p", "y", "x", "seg"], ["i"])


@query("window_mask", with_sql(f"""SELECT p, py AS y, px AS x, round(sum(w), {R}) AS length, CASE WHEN sum(w) >= 5 AND py BETWEEN 2 AND {NY} - 1 AND px BETWEEN 2 AND {IX - 1} THEN 1 ELSE 0 END AS w
FROM tap WHERE floor(xp) > 0 AND floor(xp) < {IX} AND floor(yp) > 0 AND floor(yp) < {NY} GROUP BY p, py, px""", "voxel", "proj", "rot", "point", "tap"))
def window_mask(spark, sf_dir):
    """Path length of a volume of ones; a pixel is valid above a threshold and off the border."""
    volume = samples.volume(spark, sf_dir)
    points = P.hit_points(volume.rows.withColumn("length", F.lit(1.0)), generate.projections(spark, NP), volume.shape, volume.ny, IX)
    rows = P.forward(points, ["length"], volume.ny, IX)
    ok = (F.col("length") >= 5) & F.col("y").between(2, volume.ny - 1) & F.col("x").between(2, IX - 1)
    return rounded(rows.withColumn("w", ok.cast("int")), ["p", "y", "x", "w"], ["length"])


@query("back_project", with_sql(f"""SELECT iy, ix, iz, seg, round(sum(f.i * (CASE ox WHEN 1 THEN tx ELSE 1 - tx END) * (CASE oy WHEN 1 THEN ty ELSE 1 - ty END)), {R}) + 0.0 AS i
FROM (SELECT *, lx + ox AS fx, ly + oy AS fy FROM (SELECT *, xq - lx AS tx, yq - ly AS ty FROM (SELECT *, CASE WHEN xq = {IX} THEN {IX - 1} ELSE CAST(floor(xq) AS INTEGER) END AS lx, CASE WHEN yq = {NY} THEN {NY} - 1 ELSE CAST(floor(yq) AS INTEGER) END AS ly
  FROM (SELECT *, CASE WHEN xp < 1 OR xp > {IX} THEN 1e0 ELSE xp END AS xq, CASE WHEN yp < 1 OR yp > {NY} THEN 1e0 ELSE yp END AS yq FROM point))), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(oy, ox)) b
JOIN fwd f ON f.p = b.p AND f.x = b.fx AND f.y = b.fy GROUP BY ALL""", *ALL))
def back_project(spark, sf_dir):
    volume = samples.volume(spark, sf_dir)
    images = P.forward(intensities(spark, volume), S, volume.ny, IX)
    points = P.hit_points(volume.rows.select("iy", "ix", "iz", "slab"), generate.projections(spark, NP), volume.shape, volume.ny, IX)
    rows = P.back(points, images, ["iy", "ix", "iz"], S, volume.ny, IX)
    return rounded(unpivot(rows, ["iy", "ix", "iz"]), ["iy", "ix", "iz", "seg"], ["i"])


PIXELS_SQL = f"({NP * IX} * {NY})"


def pixels(volume):
    return NP * IX * volume.ny


@query("err_metric", with_sql(f"SELECT p, round(2 * sum((sqrt(i) - sqrt(d)) ** 2) / {PIXELS_SQL}, 9) AS e FROM m GROUP BY p", *ALL, m=MEASURED_SQL))
def err_metric(spark, sf_dir):
    volume = samples.volume(spark, sf_dir)
    e = 2 * F.sum(F.pow(F.sqrt("i") - F.sqrt("d"), 2)) / pixels(volume)
    return rounded(measured(modelled(spark, volume)).groupBy("p").agg(e.alias("e")), ["p"], ["e"], 9)


def residual_images(spark, volume):
    """(p, y, x, s0..s7): w * (sqrt(model) - sqrt(data)) / (sqrt(model) + 1e-10) / pixels."""
    images = P.forward(intensities(spark, volume), S, volume.ny, IX)
    out = []
    for k, s in enumerate(S):
        model, data = F.sqrt(s), F.sqrt(F.col(s) * (1.0 + 0.1 * F.sin(F.col("p") + F.col("y") + 2 * F.col("x") + 3 * k)))
        out.append(((model - data) / (model + 1e-10) / pixels(volume)).alias(s))
    return images.select("p", "y", "x", *out)


def gathered(spark, volume, images=None):
    """Residuals gathered by voxel and projection, next to the model's cosines."""
    images = residual_images(spark, volume) if images is None else images
    v = volume.rows.select("*", *G.axis_columns())
    points = P.hit_points(v, generate.projections(spark, NP), volume.shape, volume.ny, IX)
    met = P.gather(points, images, [c for c in v.columns if c != "slab"], S, volume.ny, IX)
    return met.join(P.checked_broadcast(wide_directions(spark)), "p")


BACK_SQL = f"""SELECT b.iy, b.ix, b.iz, b.p, f.seg, sum((sqrt(f.i) - sqrt(f.d)) / (sqrt(f.i) + 1e-10) / {PIXELS_SQL} * (CASE ox WHEN 1 THEN tx ELSE 1 - tx END) * (CASE oy WHEN 1 THEN ty ELSE 1 - ty END)) AS g
FROM (SELECT *, xq - lx AS tx, yq - ly AS ty FROM (SELECT *, CASE WHEN xq = {IX} THEN {IX - 1} ELSE CAST(floor(xq) AS INTEGER) END AS lx, CASE WHEN yq = {NY} THEN {NY} - 1 ELSE CAST(floor(yq) AS INTEGER) END AS ly
  FROM (SELECT *, CASE WHEN xp < 1 OR xp > {IX} THEN 1e0 ELSE xp END AS xq, CASE WHEN yp < 1 OR yp > {NY} THEN 1e0 ELSE yp END AS yq FROM point))) b,
  (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(oy, ox), m f
WHERE f.p = b.p AND f.x = lx + ox AND f.y = ly + oy GROUP BY ALL"""
Y_SQL = {0: "0.5 / sqrt(pi())", 2: "sqrt(5 / pi()) * (0.75 * c * c - 0.25)", 4: "sqrt(1 / pi()) * (9e0 / 16 - 45e0 / 8 * c ** 2 + 105e0 / 16 * c ** 4)",
         6: "sqrt(13 / pi()) * (-5e0 / 32 + 105e0 / 32 * c ** 2 - 315e0 / 32 * c ** 4 + 231e0 / 32 * c ** 6)"}


@query("grad_a", with_sql("SELECT iy, ix, iz, " + ", ".join(f"round(4 * sum(g * amp * {y}), 9) + 0.0 AS g{n}" for n, y in Y_SQL.items()) + " FROM b JOIN model USING (iy, ix, iz, p, seg) GROUP BY ALL", *ALL, m=MEASURED_SQL, b=BACK_SQL))
def grad_a(spark, sf_dir):
    rows = gathered(spark, samples.volume(spark, sf_dir))
    c = [M.cosine_to(f"{k}_qx", f"{k}_qy", f"{k}_qz") for k in range(SEG)]
    out = []
    for n in ORDERS:
        terms = [F.col(f"s{k}") * M.amplitude(c[k]) * M.harmonic(n, c[k]) for k in range(SEG)]
        out.append((4 * F.sum(sum(terms[1:], terms[0]))).alias(f"g{n}"))
    return rounded(rows.groupBy("iy", "ix", "iz").agg(*out), ["iy", "ix", "iz"], [f"g{n}" for n in ORDERS], 9)


DY_SQL = "(a2 * sqrt(5 / pi()) * 1.5 * c + a4 * sqrt(1 / pi()) * (-45e0 / 4 * c + 105e0 / 4 * c ** 3) + a6 * sqrt(13 / pi()) * (105e0 / 16 * c - 315e0 / 8 * c ** 3 + 693e0 / 16 * c ** 5))"


@query("grad_angles", with_sql(f"""SELECT iy, ix, iz, round(4 * sum(g * amp * {DY_SQL} * (cos(theta) * cos(phi) * qx + cos(theta) * sin(phi) * qy - sin(theta) * qz)), 9) + 0.0 AS g_theta,
 round(4 * sum(g * amp * {DY_SQL} * (-sin(theta) * sin(phi) * qx + sin(theta) * cos(phi) * qy)), 9) + 0.0 AS g_phi
FROM b JOIN model USING (iy, ix, iz, p, seg) JOIN voxel USING (iy, ix, iz) JOIN q USING (p, seg) GROUP BY ALL""", *ALL, m=MEASURED_SQL, b=BACK_SQL))
def grad_angles(spark, sf_dir):
    """By dY/dc and the derivatives of the axis, so that the pole needs no division."""
    rows = gathered(spark, samples.volume(spark, sf_dir))
    t, f = F.col("theta"), F.col("phi")
    totals = {"g_theta": [], "g_phi": []}
    for k in range(SEG):
        qx, qy, qz = (F.col(f"{k}_{a}") for a in ("qx", "qy", "qz"))
        c = M.cosine_to(f"{k}_qx", f"{k}_qy", f"{k}_qz")
        slope = sum((F.col(f"a{n}") * M.harmonic_slope(n, c) for n in (4, 6)), F.col("a2") * M.harmonic_slope(2, c))
        common = F.col(f"s{k}") * M.amplitude(c) * slope
        totals["g_theta"].append(common * (F.cos(t) * F.cos(f) * qx + F.cos(t) * F.sin(f) * qy - F.sin(t) * qz))
        totals["g_phi"].append(common * (-F.sin(t) * F.sin(f) * qx + F.sin(t) * F.cos(f) * qy))
    out = [(4 * F.sum(sum(v[1:], v[0]))).alias(n) for n, v in totals.items()]
    return rounded(rows.groupBy("iy", "ix", "iz").agg(*out), ["iy", "ix", "iz"], ["g_theta", "g_phi"], 9)


def _axis_rows(spark, sf_dir):
    return samples.volume(spark, sf_dir).rows.select("iy", "ix", "iz", "theta", "phi", *G.axis_columns())


def _neighbours(v, axis, step, name):
    """The unit vector of the neighbour ``step`` along ``axis`` under the names ``name``x, y, z."""
    return v.select(
        *((F.col(c) - step if c == axis else F.col(c)).alias(c) for c in ("iy", "ix", "iz")),
        *(F.col(f"u{c}").alias(f"{name}{c}") for c in "xyz"),
    )


U_SQL = "SELECT iy, ix, iz, theta, phi, sin(theta) * cos(phi) AS ux, sin(theta) * sin(phi) AS uy, cos(theta) AS uz FROM voxel"


@query("reg_angle", with_sql("SELECT round(sum(1 - abs(a.ux * b.ux + a.uy * b.uy + a.uz * b.uz)), 6) AS reg FROM u a, (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) k(dy, dx, dz), u b WHERE b.iy = a.iy + dy AND b.ix = a.ix + dx AND b.iz = a.iz + dz", "voxel", u=U_SQL))
def reg_angle(spark, sf_dir):
    """Sum over axes of one minus |u . next u|; the last plane has no next and adds nothing."""
    v = _axis_rows(spark, sf_dir)
    parts = []
    for axis in ("iy", "ix", "iz"):
        met = v.join(_neighbours(v, axis, 1, "n"), ["iy", "ix", "iz"])
        parts.append(met.select((1 - F.abs(F.col("ux") * F.col("nx") + F.col("uy") * F.col("ny") + F.col("uz") * F.col("nz"))).alias("e")))
    return rounded(parts[0].union(parts[1]).union(parts[2]).agg(F.sum("e").alias("reg")), [], ["reg"])


@query("reg_angle_grad", with_sql("""SELECT iy, ix, iz, round(sin(theta) * ea - cos(theta) * (cos(phi) * eb + sin(phi) * ec), 9) + 0.0 AS g_theta, round(sin(theta) * (sin(phi) * eb - cos(phi) * ec), 9) + 0.0 AS g_phi FROM (
 SELECT a.iy, a.ix, a.iz, any_value(a.theta) AS theta, any_value(a.phi) AS phi, sum(s * (n.uz + b.uz)) AS ea, sum(s * (n.ux + b.ux)) AS eb, sum(s * (n.uy + b.uy)) AS ec
 FROM u a, (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) k(dy, dx, dz), u n, u b, LATERAL (SELECT sign(a.ux * n.ux + a.uy * n.uy + a.uz * n.uz) AS s)
 WHERE n.iy = a.iy + dy AND n.ix = a.ix + dx AND n.iz = a.iz + dz AND b.iy = a.iy - dy AND b.ix = a.ix - dx AND b.iz = a.iz - dz
 GROUP BY a.iy, a.ix, a.iz HAVING count(*) = 3)""", "voxel", u=U_SQL))
def reg_angle_grad(spark, sf_dir):
    """Interior voxels only; the sign towards the next voxel serves both neighbours of an axis."""
    v = _axis_rows(spark, sf_dir)
    rows, terms = v, {"x": [], "y": [], "z": []}
    for axis in ("iy", "ix", "iz"):
        rows = rows.join(_neighbours(v, axis, 1, f"n{axis}"), ["iy", "ix", "iz"]).join(_neighbours(v, axis, -1, f"b{axis}"), ["iy", "ix", "iz"])
        sign = F.signum(F.col("ux") * F.col(f"n{axis}x") + F.col("uy") * F.col(f"n{axis}y") + F.col("uz") * F.col(f"n{axis}z"))
        for c in "xyz":
            terms[c].append(sign * (F.col(f"n{axis}{c}") + F.col(f"b{axis}{c}")))
    ea, eb, ec = (sum(terms[c][1:], terms[c][0]) for c in "zxy")
    t, f = F.col("theta"), F.col("phi")
    out = rows.select(
        "iy", "ix", "iz",
        (F.sin(t) * ea - F.cos(t) * (F.cos(f) * eb + F.sin(f) * ec)).alias("g_theta"),
        (F.sin(t) * (F.sin(f) * eb - F.cos(f) * ec)).alias("g_phi"),
    )
    return rounded(out, ["iy", "ix", "iz"], ["g_theta", "g_phi"], 9)


@query("soft_limit", with_sql("SELECT round(1e5 * sum(CASE WHEN a0 < 1.2 THEN (a0 - 1.2) ** 2 WHEN a0 > 1.6 THEN (a0 - 1.6) ** 2 ELSE 0 END), 4) AS e, CAST(count(*) FILTER (WHERE a0 < 1.2 OR a0 > 1.6) AS BIGINT) AS n_outside FROM voxel", "voxel"))
def soft_limit(spark, sf_dir):
    a, low, high = F.col("a0"), 1.2, 1.6
    e = F.when(a < low, F.pow(a - low, 2)).when(a > high, F.pow(a - high, 2)).otherwise(0.0)
    out = samples.volume(spark, sf_dir).rows.agg((1e5 * F.sum(e)).alias("e"), F.count(F.when((a < low) | (a > high), 1)).alias("n_outside"))
    return rounded(out, ["n_outside"], ["e"], 4)


def hamming(n=5):
    return [0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]


#: Vectors in one partition of a volume whose voxels are blurred or multiplied in place.
STENCIL_EACH = 2_048
HAM_SQL = "SELECT range - 2 AS o, (0.54e0 - 0.46e0 * cos(pi() * range / 2)) / (SELECT sum(0.54e0 - 0.46e0 * cos(pi() * range / 2)) FROM range(5)) AS w FROM range(5)"


@query("sieve_blur", with_sql(f"""SELECT CAST(v.iy + a.o AS INTEGER) AS iy, CAST(v.ix + b.o AS INTEGER) AS ix, CAST(v.iz + c.o AS INTEGER) AS iz, round(sum(a0 * a.w * b.w * c.w), {R}) AS g
FROM voxel v, h a, h b, h c WHERE v.iy + a.o BETWEEN 1 AND {NY} AND v.ix + b.o BETWEEN 1 AND {SIDE} AND v.iz + c.o BETWEEN 1 AND {SIDE} GROUP BY ALL""", "voxel", h=HAM_SQL))
def sieve_blur(spark, sf_dir):
    """A 5 x 5 x 5 Hamming kernel of sum one as three passes of five taps, not 125."""
    w = hamming()
    # slabs bring their neighbours' slices along, so that no pass moves voxels and no task's table grows with the volume
    volume = samples.volume(spark, sf_dir, halo=2, each=STENCIL_EACH)
    rows = volume.rows.select("slab", "iy", "ix", "iz", F.col("a0").alias("g"))
    for axis in ("iy", "ix", "iz"):
        others = [c for c in ("iy", "ix", "iz") if c != axis]
        rows = P.stencil(rows, [axis], ["g"], [(k - 2, w[k] / sum(w)) for k in range(5)], {axis: volume.bounds[axis]}, ["slab", *others])
        rows = rows.where(P.own()) if axis == "iy" else rows
    return rounded(rows, ["iy", "ix", "iz"], ["g"])


@query("upsample", with_sql(f"""SELECT CAST(2 * v.iy - 1 + a.o AS INTEGER) AS iy, CAST(2 * v.ix - 1 + b.o AS INTEGER) AS ix, CAST(2 * v.iz - 1 + c.o AS INTEGER) AS iz, round(sum(a0 * (1 - abs(a.o) / 2e0) * (1 - abs(b.o) / 2e0) * (1 - abs(c.o) / 2e0)), {R}) AS a0
FROM voxel v, (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) b(o), (VALUES (-1), (0), (1)) c(o)
WHERE 2 * v.iy - 1 + a.o BETWEEN 1 AND 2 * {NY} - 1 AND 2 * v.ix - 1 + b.o BETWEEN 1 AND {2 * SIDE - 1} AND 2 * v.iz - 1 + c.o BETWEEN 1 AND {2 * SIDE - 1} GROUP BY ALL""", "voxel"))
def upsample(spark, sf_dir):
    """Trilinear doubling to 2n - 1: a voxel adds to its own place and, halved, to the neighbours."""
    volume = samples.volume(spark, sf_dir, halo=1, each=STENCIL_EACH)
    rows = volume.rows.select("slab", "iy", "ix", "iz", "a0")
    for axis, (_, n) in volume.bounds.items():
        rows = rows.withColumn(axis, F.col(axis) * 2 - 1)
        others = [c for c in ("iy", "ix", "iz") if c != axis]
        rows = P.stencil(rows, [axis], ["a0"], [(-1, 0.5), (0, 1.0), (1, 0.5)], {axis: (1, 2 * n - 1)}, ["slab", *others])
        # slices 2 i - 1 and 2 i come from slices i and i + 1
        rows = rows.where(P.own(F.expr("(iy + 1) div 2"))) if axis == "iy" else rows
    return rounded(rows, ["iy", "ix", "iz"], ["a0"])


B_SQL = """SELECT p, x * x AS b1, y * y AS b2, z * z AS b3, 2 * x * y AS b4, 2 * x * z AS b5, 2 * y * z AS b6
FROM (SELECT p, sin(phi_det) AS x, cos(phi_det) AS y, 0e0 AS z FROM pose)"""


@query("b_segs", with_sql("SELECT p, " + ", ".join(r_(f"b{k}", f"b{k}", 9) for k in range(1, 7)) + f" FROM ({B_SQL})", pose=samples.POSE_SQL))
def b_segs(spark, sf_dir):
    """[xx, yy, zz, 2xy, 2xz, 2yz] of each pose's detector direction, rotated by a quarter turn."""
    x, y, z = F.sin("phi_det"), F.cos("phi_det"), F.lit(0.0)
    values = [x * x, y * y, z * z, 2 * x * y, 2 * x * z, 2 * y * z]
    return rounded(samples.poses(spark, sf_dir).select("p", *(v.alias(f"b{k + 1}") for k, v in enumerate(values))), ["p"], [f"b{k}" for k in range(1, 7)], 9)


@query("art_step", with_sql(f"""SELECT v.iy, v.ix, v.iz, round(a0 + 1e-2 * res / length, 6) AS a0 FROM voxel v JOIN (
 SELECT b.iy, b.ix, b.iz, sum(r * w) AS res FROM tap b JOIN (SELECT py, px, sum(a0 * w) * 1e-1 * sin(py + px) AS r FROM tap JOIN voxel USING (iy, ix, iz) WHERE p = 1 AND floor(xp) > 0 AND floor(xp) < {IX} AND floor(yp) > 0 AND floor(yp) < {NY} GROUP BY py, px) i USING (py, px)
 WHERE p = 1 AND floor(xp) > 0 AND floor(xp) < {IX} AND floor(yp) > 0 AND floor(yp) < {NY} GROUP BY b.iy, b.ix, b.iz) g USING (iy, ix, iz), (SELECT least({SIDE} / abs(r22), {SIDE} / abs(nullif(r32, 0))) AS length FROM rot WHERE p = 1)""", "voxel", "proj", "rot", "point", "tap"))
def art_step(spark, sf_dir):
    """One algebraic step for one projection: residual x 0.01 over the path length, scattered back to the voxels that made it."""
    volume = samples.volume(spark, sf_dir)
    one = generate.projections(spark, NP).where(F.col("p") == 1)
    points = P.hit_points(volume.rows.select("iy", "ix", "iz", "a0"), one, volume.shape, volume.ny, IX)
    inside = (F.floor("xp") > 0) & (F.floor("xp") < IX) & (F.floor("yp") > 0) & (F.floor("yp") < volume.ny)
    taps = points.where(inside).select("iy", "ix", "iz", "a0", F.explode(P._taps()).alias("t")).select("iy", "ix", "iz", "a0", "t.*")
    image = taps.groupBy("y", "x").agg(F.sum(F.col("a0") * F.col("w")).alias("sim"))
    residual = image.select("y", "x", (F.col("sim") * 0.1 * F.sin(F.col("y") + F.col("x"))).alias("r"))  # stand-in for measured - simulated
    back = taps.join(residual, ["y", "x"]).groupBy("iy", "ix", "iz").agg(F.first("a0").alias("a0"), F.sum(F.col("r") * F.col("w")).alias("res"))
    length = one.select(*G.rotation_columns()).select(F.least(SIDE / F.abs("r22"), F.try_divide(F.lit(float(SIDE)), F.abs("r32"))).alias("length"))
    out = back.crossJoin(F.broadcast(length)).select("iy", "ix", "iz", (F.col("a0") + 0.01 * F.col("res") / F.col("length")).alias("a0"))
    return rounded(out, ["iy", "ix", "iz"], ["a0"])


@query("num_grad", """SELECT vec_id, CAST(k AS INTEGER) AS k, round(((x + h) ** 3 * exp(-(x + h)) - (x - h) ** 3 * exp(-(x - h))) / (2 * h), 6) AS numeric, round(exp(-x) * (3 * x ** 2 - x ** 3), 6) AS exact
FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, 5e-1 + abs(CAST(unnest(embedding) AS DOUBLE)) AS x, 1e-4 AS h FROM embeddings)""")
def num_grad(spark, sf_dir):
    """Central differences beside the exact slope, at each component of each vector."""
    x, h = F.col("x"), 1e-4
    f = lambda v: F.pow(v, 3) * F.exp(-v)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", "k", (0.5 + F.abs(F.col("v").cast("double"))).alias("x"))
    rows = rows.select("vec_id", "k", ((f(x + h) - f(x - h)) / (2 * h)).alias("numeric"), (F.exp(-x) * (3 * x * x - F.pow(x, 3))).alias("exact"))
    return rounded(rows, ["vec_id", "k"], ["numeric", "exact"])
