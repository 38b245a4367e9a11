"""Queries of masks and radial integration over stand-in frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from scatterlake.operators import integrate as I
from scatterlake.plans.grid import rounded
from scatterlake.plans.registry import query
from scatterlake.session import table
from scatterlake.sources.standins import FRAME_SQL, frames

FR = f"WITH frame AS ({FRAME_SQL})"
CY, CX, SECTORS, RINGS = 3.4, 3.6, 4, 6
PIX = f"pix AS (SELECT DISTINCT row, col, CAST(floor(sqrt((row - {CY}) ** 2 + (col - {CX}) ** 2)) AS INTEGER) AS ring, CAST(least(3, floor(CASE WHEN atan2(row - {CY}, col - {CX}) < 0 THEN atan2(row - {CY}, col - {CX}) + 2 * pi() ELSE atan2(row - {CY}, col - {CX}) END / (pi() / 2))) AS INTEGER) AS sector FROM frame)"
VALID = "valid AS (SELECT row, col FROM frame GROUP BY row, col HAVING NOT bool_and(counts < 150) AND NOT bool_or(counts > 420))"


def all_pixels(spark, sf_dir):
    return frames(spark, sf_dir).select("row", "col").distinct()


@query("valid_mask", f"{FR}, {VALID} SELECT row, col FROM valid")
def valid_mask(spark, sf_dir):
    return I.valid_pixels(frames(spark, sf_dir), 150, 420)


@query("mask_merge", f"{FR}, {VALID}, o AS (SELECT DISTINCT row, col FROM frame WHERE (row + col) % 2 = 0) SELECT 'both' AS how, * FROM (SELECT * FROM valid INTERSECT SELECT * FROM o) UNION ALL SELECT 'any', * FROM (SELECT * FROM valid UNION SELECT * FROM o)")
def mask_merge(spark, sf_dir):
    a, b = valid_mask(spark, sf_dir), all_pixels(spark, sf_dir).where((F.col("row") + F.col("col")) % 2 == 0)
    both = I.merge_masks(a, b, "intersect").select(F.lit("both").alias("how"), "row", "col")
    return both.union(I.merge_masks(a, b, "union").select(F.lit("any").alias("how"), "row", "col"))


@query("mask_beamstop", f"{FR}, {VALID}, {PIX} SELECT row, col FROM valid ANTI JOIN (SELECT * FROM pix WHERE ring < 2) b USING (row, col)")
def mask_beamstop(spark, sf_dir):
    stop = all_pixels(spark, sf_dir).where(I.radius(CY, CX) < 2)
    return I.without_pixels(valid_mask(spark, sf_dir), stop)


@query("mask_tune", f"""{FR}, {PIX}, p AS (SELECT row, col, ring, avg(counts) AS v FROM frame JOIN pix USING (row, col) GROUP BY ALL), r AS (SELECT ring, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM p GROUP BY ring),
t AS (SELECT ring, s, median(m) OVER (ORDER BY ring ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM r) SELECT row, col FROM p JOIN t USING (ring) WHERE abs(v - m) <= 1.2 * s + 1e-9""")
def mask_tune(spark, sf_dir):
    return I.tune_mask(frames(spark, sf_dir), CY, CX, 1.2)


@query("mask_index", f"{FR} SELECT vec_id, CAST(i AS INTEGER) AS i, CAST((i - 1) % 8 * 8 + (i + 7) // 8 AS INTEGER) AS j, CAST((i - 1) % 8 + 1 AS INTEGER) AS row, CAST((i - 1) // 8 + 1 AS INTEGER) AS col FROM (SELECT vec_id, row + 1 + col * 8 AS i FROM frame WHERE counts < 150)")
def mask_index(spark, sf_dir):
    """Each frame's valid pixels by column-major index, and from that the row-major index, row and column."""
    d1, d2 = 8, 8
    i = F.col("i")
    valid = frames(spark, sf_dir).where(F.col("counts") < 150).select("vec_id", (F.col("row") + 1 + F.col("col") * d1).alias("i"))
    return valid.select(
        "vec_id",
        i.cast("int").alias("i"),
        (F.pmod(i - 1, F.lit(d1)) * d2 + F.ceil(i / d1)).cast("int").alias("j"),
        (F.pmod(i - 1, F.lit(d1)) + 1).cast("int").alias("row"),
        F.ceil(i / d1).cast("int").alias("col"),
    )


@query("integ_bins", f"{FR}, {PIX} SELECT ring AS r_bin, sector AS seg, count(*) AS norm_sum FROM pix GROUP BY ALL")
def integ_bins(spark, sf_dir):
    rows = I.bins(all_pixels(spark, sf_dir), CY, CX, 1.0, SECTORS)
    return rows.groupBy("r_bin", "seg").agg(F.count(F.lit(1)).alias("norm_sum"))


Q_STEP = 0.004


@query("integ_bins_q", f"{FR}, {PIX}, q AS (SELECT row, col, sector, 4 * pi() / 0.9116 * sin(atan2(0.172 * 10 * sqrt((row - {CY}) ** 2 + (col - {CX}) ** 2), 7126) / 2) AS q FROM pix) SELECT CAST(floor(q / {Q_STEP}) AS INTEGER) AS q_bin, sector AS seg, count(*) AS n FROM q WHERE q < {Q_STEP * 6} GROUP BY ALL")
def integ_bins_q(spark, sf_dir):
    """Bins of q = 4 pi / wavelength * sin(atan2(rho, distance) / 2); equal edges make the range join a division."""
    q = 4 * F.pi() / 0.9116 * F.sin(F.atan2(I.radius(CY, CX) * 0.172 * 10, F.lit(7126.0)) / 2)
    rows = all_pixels(spark, sf_dir).select(q.alias("q"), I.sector(CY, CX, SECTORS).alias("seg")).where(F.col("q") < Q_STEP * 6)
    return rows.groupBy(F.floor(F.col("q") / Q_STEP).cast("int").alias("q_bin"), "seg").agg(F.count(F.lit(1)).alias("n"))


@query("radial_integ", f"""{FR}, {PIX}, {VALID}, a AS (SELECT vec_id, ring AS r_bin, sector AS seg, avg(counts) AS m, coalesce(stddev_samp(counts), 0) AS s, count(*) AS n FROM frame JOIN pix USING (row, col) JOIN valid USING (row, col) GROUP BY ALL),
e AS (SELECT vec_id, CAST(x.range AS INTEGER) AS r_bin, CAST(y.range AS INTEGER) AS seg FROM (SELECT DISTINCT vec_id FROM frame), range({RINGS}) x, range({SECTORS}) y)
SELECT vec_id, r_bin, seg, round(coalesce(m, -1), 6) AS mean, round(coalesce(s, -1), 6) AS std, coalesce(n, 0) AS n FROM e LEFT JOIN a USING (vec_id, r_bin, seg)""")
def radial_integ(spark, sf_dir):
    pixels = I.bins(valid_mask(spark, sf_dir), CY, CX, 1.0, SECTORS)
    rows = I.integrate(frames(spark, sf_dir), pixels, ["vec_id"], RINGS, SECTORS)
    return rounded(rows, ["vec_id", "r_bin", "seg", "n"], ["mean", "std"])


@query("label_mask", f"{FR}, {PIX} SELECT row, col, CASE WHEN ring BETWEEN 1 AND 4 THEN CAST(ring + sector * 4 AS INTEGER) ELSE 0 END AS label FROM pix")
def label_mask(spark, sf_dir):
    """ring + sector * rings for rings 1..4, 0 outside."""
    r, s = I.ring(CY, CX), I.sector(CY, CX, SECTORS)
    return all_pixels(spark, sf_dir).select("row", "col", F.when(r.between(1, 4), r + s * 4).otherwise(0).cast("int").alias("label"))


@query("pixel_to_q", f"{FR} SELECT vec_id, round(4 * pi() * sin(atan(px * 172e-6 / 7.126e0) / 2) / (12.39852e0 / 13.6e0), 9) AS q FROM (SELECT vec_id, sum(counts * sqrt((row - {CY}) ** 2 + (col - {CX}) ** 2)) / sum(counts) AS px FROM frame WHERE counts > 0 GROUP BY vec_id)")
def pixel_to_q(spark, sf_dir):
    """q at the mean radius of each frame's counts."""
    px = F.sum(F.col("counts") * I.radius(CY, CX)) / F.sum("counts")
    q = 4 * F.pi() * F.sin(F.atan(F.col("px") * 172e-6 / 7.126) / 2) / (12.39852 / 13.6)
    return frames(spark, sf_dir).where(F.col("counts") > 0).groupBy("vec_id").agg(px.alias("px")).select("vec_id", F.round(q, 9).alias("q"))


@query("beam_center", f"""{FR}, p AS (SELECT row, col, avg(counts) AS v FROM frame GROUP BY row, col), c AS (SELECT 2.5 + a.range * 5e-1 AS cy, 2.5 + b.range * 5e-1 AS cx FROM range(5) a, range(5) b),
k AS (SELECT cy, cx, coalesce(stddev_samp(v), 0) / count(v) AS c FROM p, c GROUP BY cy, cx, floor(sqrt((row - cy) ** 2 + (col - cx) ** 2))) SELECT cy, cx, round(avg(c), 9) AS cost FROM k GROUP BY cy, cx""")
def beam_center(spark, sf_dir):
    """The cost of every candidate centre; the least wins."""
    c = spark.range(25).select((2.5 + F.floor(F.col("id") / 5) * 0.5).alias("cy"), (2.5 + (F.col("id") % 5) * 0.5).alias("cx"))
    return rounded(I.centre_costs(frames(spark, sf_dir), c), ["cy", "cx"], ["cost"], 9)


@query("scan_prune", "SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 100 AND 199 AND label = 3")
def scan_prune(spark, sf_dir):
    """Scan number and filter arguments of a reader as pushed-down predicates over pruned columns."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").between(100, 199) & (F.col("label") == 3)).select("vec_id", "label")


@query("stxm", f"""{FR} SELECT vec_id, sum(counts) AS total, round(sum(counts * col) / sum(counts), 6) AS mx, round(sum(counts * row) / sum(counts), 6) AS my, coalesce(sum(counts) FILTER (WHERE sqrt((row - {CY}) ** 2 + (col - {CX}) ** 2) >= 3), 0) AS dark FROM frame GROUP BY vec_id""")
def stxm(spark, sf_dir):
    """Transmission, first moments and dark field of every frame."""
    c = F.col("counts")
    moment = lambda axis: F.round(F.sum(c * F.col(axis)) / F.sum(c), 6)
    dark = F.coalesce(F.sum(F.when(I.radius(CY, CX) >= 3, c)), F.lit(0.0))
    return frames(spark, sf_dir).groupBy("vec_id").agg(F.sum(c).alias("total"), moment("col").alias("mx"), moment("row").alias("my"), dark.alias("dark"))


# --- array and image families -------------------------------------------------
@query("frame_reduce", f"{FR} SELECT vec_id, sum(counts) AS s, round(avg(counts), 6) AS mean, max(counts) AS hi, min(counts) AS lo, round(sqrt(avg(counts * counts)), 6) AS rms, bool_and(abs(round(counts) - counts) < 0.01) AS whole FROM frame GROUP BY vec_id")
def frame_reduce(spark, sf_dir):
    c = F.col("counts")
    rms = F.round(F.sqrt(F.avg(c * c)), 6)
    whole = F.bool_and(F.abs(F.round(c) - c) < 0.01)
    return frames(spark, sf_dir).groupBy("vec_id").agg(
        F.sum(c).alias("s"), F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("hi"), F.min(c).alias("lo"), rms.alias("rms"), whole.alias("whole")
    )


@query("arg_extremes", f"{FR}, a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY counts DESC, col, row) AS h, row_number() OVER (PARTITION BY vec_id ORDER BY counts, col, row) AS l FROM frame) SELECT vec_id, max(row) FILTER (WHERE h = 1) AS hi_row, max(col) FILTER (WHERE h = 1) AS hi_col, max(row) FILTER (WHERE l = 1) AS lo_row, max(col) FILTER (WHERE l = 1) AS lo_col FROM a GROUP BY vec_id")
def arg_extremes(spark, sf_dir):
    """First place of the extremes in column-major order: one aggregation of structs, no sort."""
    place = lambda sign: F.min(F.struct((F.col("counts") * sign).alias("v"), "col", "row"))
    rows = frames(spark, sf_dir).groupBy("vec_id").agg(place(-1).alias("h"), place(1).alias("l"))
    return rows.select("vec_id", F.col("h.row").alias("hi_row"), F.col("h.col").alias("hi_col"), F.col("l.row").alias("lo_row"), F.col("l.col").alias("lo_col"))


@query("sp_quantile", f"{FR}, s AS (SELECT vec_id, counts FROM frame WHERE (row * 8 + col) % 2 = 0) SELECT vec_id, round(quantile_cont(counts, 0.9), 6) AS q FROM s GROUP BY vec_id")
def sp_quantile(spark, sf_dir):
    """Quantile of every second pixel."""
    rows = frames(spark, sf_dir).where((F.col("row") * 8 + F.col("col")) % 2 == 0)
    return rows.groupBy("vec_id").agg(F.round(F.percentile("counts", 0.9), 6).alias("q"))


@query("center_mass", f"""{FR}, m AS (SELECT vec_id, sum(counts) AS t, sum(counts * col) / sum(counts) AS x, sum(counts * row) / sum(counts) AS y, sum(counts * col * col) / sum(counts) AS xx, sum(counts * row * row) / sum(counts) AS yy, sum(counts * row * col) / sum(counts) AS xy FROM frame GROUP BY vec_id)
SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(xx - x * x, 5) AS vx, round(yy - y * y, 5) AS vy, round(xy - x * y, 5) + 0.0 AS vxy FROM m""")
def center_mass(spark, sf_dir):
    c, x, y = F.col("counts"), F.col("col"), F.col("row")
    m = lambda e: F.sum(c * e) / F.sum(c)
    rows = frames(spark, sf_dir).groupBy("vec_id").agg(m(x).alias("x"), m(y).alias("y"), m(x * x).alias("xx"), m(y * y).alias("yy"), m(x * y).alias("xy"))
    x, y = F.col("x"), F.col("y")
    return rows.select(
        "vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(F.col("xx") - x * x, 5).alias("vx"),
        F.round(F.col("yy") - y * y, 5).alias("vy"), (F.round(F.col("xy") - x * y, 5) + F.lit(0.0)).alias("vxy"),
    )


@query("binning", f"{FR} SELECT vec_id, row // 3 AS by, col // 3 AS bx, round(avg(counts), 6) AS v FROM frame WHERE row < 6 AND col < 6 GROUP BY ALL")
def binning(spark, sf_dir):
    """Means of 3 x 3 blocks; the remainder of 8 = 2 x 3 + 2 is dropped."""
    rows = frames(spark, sf_dir).where((F.col("row") < 6) & (F.col("col") < 6))
    return rows.groupBy("vec_id", F.expr("row div 3").cast("int").alias("by"), F.expr("col div 3").cast("int").alias("bx")).agg(F.round(F.avg("counts"), 6).alias("v"))


@query("crop_pad", f"{FR}, e AS (SELECT vec_id, CAST(a.range AS INTEGER) AS row, CAST(b.range AS INTEGER) AS col FROM (SELECT DISTINCT vec_id FROM frame), range(5) a, range(11) b) SELECT vec_id, e.row, e.col, coalesce(counts, 0) AS counts FROM e LEFT JOIN (SELECT vec_id, row - 2 AS row, col + 1 AS col, counts FROM frame) f USING (vec_id, row, col)")
def crop_pad(spark, sf_dir):
    """To 5 x 11, aligned on floor(n / 2) + 1, filled with 0."""
    rows, columns = 5, 11
    f = frames(spark, sf_dir)
    shifted = f.select("vec_id", (F.col("row") + (rows // 2 - 4)).alias("row"), (F.col("col") + (columns // 2 - 4)).alias("col"), "counts")
    grid = spark.range(rows * columns).select(F.expr(f"CAST(id div {columns} AS INT)").alias("row"), (F.col("id") % columns).cast("int").alias("col"))
    full = f.select("vec_id").distinct().crossJoin(F.broadcast(grid))
    return full.join(shifted, ["vec_id", "row", "col"], "left").select("vec_id", "row", "col", F.coalesce("counts", F.lit(0.0)).alias("counts"))


@query("gauss_blur", f"""{FR}, k AS (SELECT range - 3 AS o, exp(-(((range - 3) / 1.5e0) ** 2)) / (SELECT sum(exp(-(((range - 3) / 1.5e0) ** 2))) FROM range(7)) AS w FROM range(7))
SELECT vec_id, CAST(row + a.o AS INTEGER) AS row, CAST(col + b.o AS INTEGER) AS col, round(sum(counts * a.w * b.w), 5) AS v FROM frame, k a, k b WHERE row + a.o BETWEEN 0 AND 7 AND col + b.o BETWEEN 0 AND 7 GROUP BY ALL""")
def gauss_blur(spark, sf_dir):
    """exp(-(x / sigma)^2) without a half, radius ceil(2 sigma), one axis at a time."""
    import math

    from scatterlake.operators.project import stencil

    sigma = 1.5
    half = math.ceil(2 * sigma)
    w = [math.exp(-((o / sigma) ** 2)) for o in range(-half, half + 1)]
    rows = frames(spark, sf_dir).withColumnRenamed("counts", "v")
    for axis, other in (("row", "col"), ("col", "row")):
        rows = stencil(rows, [axis], ["v"], [(o - half, x / sum(w)) for o, x in enumerate(w)], {axis: (0, 7)}, ["vec_id", other])
    return rounded(rows, ["vec_id", "row", "col"], ["v"], 5)


@query("residues", f"""{FR}, p AS (SELECT vec_id, row, col, counts / 100 AS a FROM frame), d AS (SELECT x.vec_id, x.row, x.col, x.a AS a, y.a AS b, z.a AS c, w.a AS d FROM p x JOIN p y ON y.vec_id = x.vec_id AND y.row = x.row AND y.col = x.col + 1 JOIN p z ON z.vec_id = x.vec_id AND z.row = x.row + 1 AND z.col = x.col + 1 JOIN p w ON w.vec_id = x.vec_id AND w.row = x.row + 1 AND w.col = x.col),
t AS (SELECT *, [b - a, c - b, d - c, a - d] AS e FROM d) SELECT vec_id, row, col, CAST(round(list_sum(list_transform(e, lambda v: v + pi() - 2 * pi() * floor((v + pi()) / (2 * pi())) - pi())) / (2 * pi())) AS INTEGER) AS residue FROM t""")
def residues(spark, sf_dir):
    """Sum of the four wrapped differences around each 2 x 2 loop over a full turn.

    The neighbours come from the frame's own array, so nothing is joined.
    """
    import math

    turn = 2 * math.pi
    rows = frames(spark, sf_dir).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct((F.col("row") * 8 + F.col("col")).alias("k"), (F.col("counts") / 100).alias("a")))).alias("f"))
    rows = rows.select("vec_id", "f", F.explode(F.expr("filter(sequence(0, 62), k -> k % 8 < 7 AND k < 56)")).alias("k"))
    at = lambda o: F.get(F.col("f"), F.col("k") + o)["a"]
    wrap = lambda d: F.pmod(d + math.pi, F.lit(turn)) - math.pi
    total = wrap(at(1) - at(0)) + wrap(at(9) - at(1)) + wrap(at(8) - at(9)) + wrap(at(0) - at(8))
    return rows.select("vec_id", F.expr("CAST(k div 8 AS INT)").alias("row"), (F.col("k") % 8).cast("int").alias("col"), F.round(total / turn).cast("int").alias("residue"))


@query("shift_wrap", f"""{FR} SELECT vec_id, CAST((row + oy + 2) % 8 AS INTEGER) AS row, CAST((col + ox + 7) % 8 AS INTEGER) AS col, round(sum(counts * CASE oy WHEN 1 THEN 0.25 ELSE 0.75 END * CASE ox WHEN 1 THEN 0.5 ELSE 0.5 END), 6) AS v
FROM frame, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(oy, ox) GROUP BY ALL""")
def shift_wrap(spark, sf_dir):
    """Shift by (2.25, -0.5) with wrap-around: integer roll and four bilinear taps, no join."""
    taps = F.array(*(F.struct(F.lit(oy).alias("oy"), F.lit(ox).alias("ox"), F.lit((0.25 if oy else 0.75) * 0.5).alias("w")) for oy in (0, 1) for ox in (0, 1)))
    rows = frames(spark, sf_dir).withColumn("t", F.explode(taps))
    row, col = F.pmod(F.col("row") + F.col("t.oy") + 2, F.lit(8)), F.pmod(F.col("col") + F.col("t.ox") - 1, F.lit(8))
    return rounded(rows.groupBy("vec_id", row.alias("row"), col.alias("col")).agg(F.sum(F.col("counts") * F.col("t.w")).alias("v")), ["vec_id", "row", "col"], ["v"])


@query("peak_find", f"""{FR}, p AS (SELECT vec_id, row * 8 + col AS k, counts AS v, (max(counts) OVER (PARTITION BY vec_id) - min(counts) OVER (PARTITION BY vec_id)) / 4 AS sel FROM frame), n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY k))
SELECT vec_id, CAST(k AS INTEGER) AS k, v FROM n WHERE v > a + sel AND v > b + sel""")
def peak_find(spark, sf_dir):
    """Points above both neighbours by a quarter of the range."""
    from pyspark.sql import Window

    whole = Window.partitionBy("vec_id")
    w = whole.orderBy("k")
    rows = frames(spark, sf_dir).select("vec_id", (F.col("row") * 8 + F.col("col")).alias("k"), F.col("counts").alias("v"))
    rows = rows.withColumn("sel", (F.max("v").over(whole) - F.min("v").over(whole)) / 4)
    rows = rows.withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w))
    return rows.where((F.col("v") > F.col("a") + F.col("sel")) & (F.col("v") > F.col("b") + F.col("sel"))).select("vec_id", "k", "v")
