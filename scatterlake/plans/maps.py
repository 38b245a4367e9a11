"""Queries of positions, stitched maps, masks found in frames, image edits, factorisations and kept results."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from scatterlake.functions import images as K
from scatterlake.operators import project as P
from scatterlake.operators import svd as V
from scatterlake.operators.cache import cached
from scatterlake.plans.grid import rounded
from scatterlake.plans.ingest import CARRY
from scatterlake.plans.iterate import _image_kernel
from scatterlake.plans.registry import query
from scatterlake.session import table, work_path
from scatterlake.sources import samples, spec
from scatterlake.sources.standins import FRAME_SQL, PATTERN_SQL, frames, patterns
from scatterlake.streaming import live
from scatterlake.streaming.sink import MarkedTable

FR = f"WITH frame AS ({FRAME_SQL})"


@query("scan_positions", f"""WITH {samples.LOG_SQL}, {CARRY}, m AS (SELECT file, scan, CAST(split_part(text, ' ', 2) AS DOUBLE) AS x0, CAST(split_part(text, ' ', 3) AS DOUBLE) AS y0 FROM carried WHERE text LIKE '#P0 %'),
d AS (SELECT file, scan, line_no, CAST(split_part(text, ' ', 1) AS DOUBLE) AS dx, CAST(split_part(text, ' ', 2) AS DOUBLE) AS dy FROM carried WHERE regexp_matches(text, '^[0-9]'))
SELECT d.file, d.scan, line_no, round(x0 + dx, 6) AS x, round(y0 + dy, 6) AS y FROM d JOIN m ON d.file = m.file AND d.scan = m.scan""")
def scan_positions(spark, sf_dir):
    """Position of each counted point of a scan log: the scan's motors plus the point's own offsets."""
    rows = spec.with_scan(samples.scan_log(spark, sf_dir))
    parts = F.split("text", " ")
    motors = rows.where(F.startswith("text", F.lit("#P0 "))).select("file", "scan", parts[1].cast("double").alias("x0"), parts[2].cast("double").alias("y0"))
    points = rows.where(F.col("text").rlike("^[0-9]")).select("file", "scan", "line_no", parts[0].cast("double").alias("dx"), parts[1].cast("double").alias("dy"))
    met = points.join(motors, ["file", "scan"]).select("file", "scan", "line_no", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y"))
    return rounded(met, ["file", "scan", "line_no"], ["x", "y"])


@query("spectra_stitch", """WITH e AS (SELECT user_id AS scan, event_id, event_type AS channel, value FROM events WHERE value IS NOT NULL), s AS (SELECT scan, count(*) AS n, 1 + scan % 7 AS dx, 1 + scan % 3 AS dy FROM e GROUP BY scan),
g AS (SELECT scan, greatest(1, CAST(floor(sqrt(dx * n / dy)) AS BIGINT)) AS nx, n FROM s), p AS (SELECT e.*, row_number() OVER (PARTITION BY scan ORDER BY event_id) - 1 AS k FROM e)
SELECT p.scan, k % nx AS x, k // nx AS y, CAST(round(n / nx) AS BIGINT) AS ny, channel, round(value, 6) AS v FROM p JOIN g USING (scan)""")
def spectra_stitch(spark, sf_dir):
    """(scan, x, y, ny, channel, v): scans as maps of Nx = floor(sqrt(dx n / dy)) columns and Ny = round(n / Nx) rows."""
    e = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).select(F.col("user_id").alias("scan"), "event_id", F.col("event_type").alias("channel"), "value")
    whole = Window.partitionBy("scan")
    rows = e.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("k", F.row_number().over(whole.orderBy("event_id")) - 1)
    nx = F.greatest(F.lit(1), F.floor(F.sqrt((1 + F.col("scan") % 7) * F.col("n") / (1 + F.col("scan") % 3))))
    rows = rows.withColumn("nx", nx)
    return rows.select("scan", (F.col("k") % F.col("nx")).alias("x"), F.expr("k div nx").alias("y"), F.round(F.col("n") / F.col("nx")).cast("long").alias("ny"), "channel", F.round("value", 6).alias("v"))


@query("cluster_maps", """WITH l AS (SELECT DISTINCT label AS cluster FROM embeddings), s AS (SELECT vec_id // 100 AS sample, vec_id % 100 // 10 AS y, vec_id % 10 AS x0, label FROM embeddings)
SELECT sample, cluster, y, CASE WHEN y % 2 = 1 THEN 9 - x0 ELSE x0 END AS x, CASE WHEN label = cluster THEN 1 ELSE 0 END AS v FROM s, l""")
def cluster_maps(spark, sf_dir):
    """Labels split back to samples of 10 x 10 points: a 0/1 image for each cluster, the snake undone."""
    from scatterlake.operators.pattern import snake_x

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    clusters = P.checked_broadcast(rows.select(F.col("label").alias("cluster")).distinct(), 10_000)
    at = rows.select(F.expr("vec_id div 100").alias("sample"), F.expr("vec_id % 100 div 10").alias("y"), (F.col("vec_id") % 10).alias("x0"), "label")
    at = at.select("sample", "y", snake_x("x0", "y", 10).alias("x"), "label")
    return at.crossJoin(clusters).select("sample", "cluster", "y", "x", F.when(F.col("label") == F.col("cluster"), 1).otherwise(0).alias("v"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey")


@query("int_narrow", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in NUMBERS) + """), s AS (SELECT name, bool_and(abs(round(x) - x) < 0.01) AS whole, min(x) AS low, max(x) AS high FROM v GROUP BY name)
SELECT name, whole, CASE WHEN NOT whole THEN 'double' WHEN low >= -128 AND high <= 127 THEN 'tinyint' WHEN low >= -32768 AND high <= 32767 THEN 'smallint' WHEN low >= -2147483648 AND high <= 2147483647 THEN 'int' ELSE 'bigint' END AS type FROM s""")
def int_narrow(spark, sf_dir):
    """The narrowest type of each number column: whole if all values are within 0.01 of a whole number."""
    rows = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in NUMBERS))).alias("v")).select("v.*")
    found = rows.groupBy("name").agg(F.bool_and(F.abs(F.round("x") - F.col("x")) < 0.01).alias("whole"), F.min("x").alias("low"), F.max("x").alias("high"))
    kind = F.when(~F.col("whole"), "double")
    for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
        kind = kind.when((F.col("low") >= -(2.0**bits)) & (F.col("high") <= 2.0**bits - 1), name)
    return found.select("name", "whole", kind.otherwise("bigint").alias("type"))


# --- images ---------------------------------------------------------------------
def packed(spark, sf_dir):
    """(vec_id, f): each frame as an array of 64 counts."""
    rows = frames(spark, sf_dir).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct((F.col("row") * 8 + F.col("col")).alias("k"), "counts"))).alias("f"))
    return rows.select("vec_id", F.transform("f", lambda x: x["counts"]).alias("f"))


THRESHOLD = 60.0


@query("auto_mask", f"""{FR}, o AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(3) a, range(3) b),
g AS (SELECT f.vec_id, f.row, f.col, coalesce((r.counts - l.counts) / 2, 0) AS gx, coalesce((d.counts - u.counts) / 2, 0) AS gy FROM frame f
 LEFT JOIN frame l ON l.vec_id = f.vec_id AND l.row = f.row AND l.col = f.col - 1 LEFT JOIN frame r ON r.vec_id = f.vec_id AND r.row = f.row AND r.col = f.col + 1
 LEFT JOIN frame u ON u.vec_id = f.vec_id AND u.col = f.col AND u.row = f.row - 1 LEFT JOIN frame d ON d.vec_id = f.vec_id AND d.col = f.col AND d.row = f.row + 1),
m0 AS (SELECT vec_id, row, col, CASE WHEN gx * gx + gy * gy > {THRESHOLD * THRESHOLD} THEN 1 ELSE 0 END AS m FROM g),
""" + ",\n".join(f"m{n + 1} AS (SELECT a.vec_id, a.row, a.col, {f}(b.m) AS m FROM (SELECT vec_id, row, col, row + dy AS r2, col + dx AS c2 FROM m{n}, o) a JOIN m{n} b ON b.vec_id = a.vec_id AND b.row = a.r2 AND b.col = a.c2 GROUP BY ALL)" for n, f in enumerate(("max", "min", "min", "max"))) + """
SELECT vec_id, row, col, m AS bad FROM m4""")
def auto_mask(spark, sf_dir):
    """(vec_id, row, col, bad): steep pixels of each frame, closed and opened by 3 x 3: from each frame's own array, no join."""
    around = "array(" + ", ".join(f"named_struct('a', {a}, 'b', {b})" for a in (-1, 0, 1) for b in (-1, 0, 1)) + ")"
    inside = "k div 8 + d.a BETWEEN 0 AND 7 AND k % 8 + d.b BETWEEN 0 AND 7"
    steep = f"transform(sequence(0, 63), k -> pow(CASE WHEN k % 8 BETWEEN 1 AND 6 THEN (f[k + 1] - f[k - 1]) / 2 ELSE 0 END, 2) + pow(CASE WHEN k BETWEEN 8 AND 55 THEN (f[k + 8] - f[k - 8]) / 2 ELSE 0 END, 2) > {THRESHOLD * THRESHOLD})"
    mask = steep
    for kind in ("exists", "forall", "forall", "exists"):  # closing, then opening; each mask is made once, under the name m
        moved = f"transform(sequence(0, 63), k -> {kind}(filter({around}, d -> {inside}), d -> m[int(k + d.a * 8 + d.b)]))"
        mask = f"get(transform(array({mask}), m -> {moved}), 0)"
    rows = packed(spark, sf_dir).select("vec_id", F.expr(mask).alias("m"))
    rows = rows.select("vec_id", F.posexplode("m").alias("k", "bad"))
    return rows.select("vec_id", F.expr("CAST(k div 8 AS INT)").alias("row"), (F.col("k") % 8).cast("int").alias("col"), F.col("bad").cast("int").alias("bad"))


@query("proj_edits", f"""{FR}, o(o, w) AS (VALUES (-2, 1e0 / 3), (-1, 2e0 / 3), (0, 1e0), (1, 2e0 / 3), (2, 1e0 / 3)), s AS (SELECT vec_id, CASE WHEN col % 2 = 1 THEN (row + 1) % 8 ELSE row END AS row, col, counts FROM frame)
SELECT vec_id, CAST(row * 3 + a.o AS INTEGER) AS row, CAST(col * 3 + b.o AS INTEGER) AS col, round(sum(counts * a.w * b.w), 6) AS v FROM s, o a, o b WHERE row * 3 + a.o BETWEEN 0 AND 21 AND col * 3 + b.o BETWEEN 0 AND 21 GROUP BY ALL""")
def proj_edits(spark, sf_dir):
    """Every second column moved down by one, around the edge, then three times finer by bilinear weights, one axis at a time."""
    rows = frames(spark, sf_dir).withColumn("row", F.when(F.col("col") % 2 == 1, (F.col("row") + 1) % 8).otherwise(F.col("row"))).withColumnRenamed("counts", "v")
    taps = [(o, 1 - abs(o) / 3) for o in range(-2, 3)]
    for axis, other in (("row", "col"), ("col", "row")):
        rows = P.stencil(rows.withColumn(axis, F.col(axis) * 3), [axis], ["v"], taps, {axis: (0, 21)}, ["vec_id", other])
    return rounded(rows, ["vec_id", "row", "col"], ["v"])


DEGREES = 30.0


@query("rotate", f"""{FR}, t AS (SELECT CAST(a.range AS INTEGER) AS row, CAST(b.range AS INTEGER) AS col, 3.5 + (a.range - 3.5) * cos(radians({DEGREES})) - (b.range - 3.5) * sin(radians({DEGREES})) AS y, 3.5 + (a.range - 3.5) * sin(radians({DEGREES})) + (b.range - 3.5) * cos(radians({DEGREES})) AS x FROM range(8) a, range(8) b),
p AS (SELECT t.row, t.col, CAST(floor(y) AS INTEGER) + oy AS sy, CAST(floor(x) AS INTEGER) + ox AS sx, (CASE oy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE ox WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(oy, ox))
SELECT f.vec_id, p.row, p.col, round(sum(f.counts * w), 6) AS v FROM p JOIN frame f ON f.row = p.sy AND f.col = p.sx GROUP BY ALL""")
def rotate(spark, sf_dir):
    """Frames turned about their middle, bilinear, zero outside: each place's taps are a literal, each frame its own array."""
    c, s = math.cos(math.radians(DEGREES)), math.sin(math.radians(DEGREES))
    places = []
    for row in range(8):
        for col in range(8):
            y, x = 3.5 + (row - 3.5) * c - (col - 3.5) * s, 3.5 + (row - 3.5) * s + (col - 3.5) * c
            at = [(math.floor(y) + oy, math.floor(x) + ox, (y - math.floor(y) if oy else 1 - y + math.floor(y)) * (x - math.floor(x) if ox else 1 - x + math.floor(x))) for oy in (0, 1) for ox in (0, 1)]
            taps = [(a * 8 + b, w) for a, b, w in at if 0 <= a < 8 and 0 <= b < 8]
            if taps:
                places.append(F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in taps)).alias("taps")))
    rows = packed(spark, sf_dir).select("vec_id", "f", F.explode(F.array(*places)).alias("t"))
    v = F.aggregate("t.taps", F.lit(0.0), lambda acc, t: acc + t["w"] * F.get(F.col("f"), t["k"]))
    return rounded(rows.select("vec_id", "t.row", "t.col", v.alias("v")), ["vec_id", "row", "col"], ["v"])


@query("grad_integrate", f"{FR} SELECT vec_id, CAST(row AS BIGINT) AS y, CAST(col AS BIGINT) AS x, round(counts - avg(counts) OVER (PARTITION BY vec_id), 6) + 0.0 AS v FROM frame")
def grad_integrate(spark, sf_dir):
    """Frames recovered, up to their mean, from their differences along both axes: least squares by a spectral Poisson solve."""

    def one(i, image):
        out = K.integrated(np.diff(image, axis=1), np.diff(image, axis=0))
        return [(i, y, x, float(out[y, x])) for y in range(8) for x in range(8)]

    return rounded(_image_kernel(frames(spark, sf_dir), one, "vec_id long, y long, x long, v double"), ["vec_id", "y", "x"], ["v"])


# --- factorisation ----------------------------------------------------------------
@query("svd", "SELECT round(sum(v * v), 3) AS energy, count(DISTINCT k) AS columns FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS k FROM embeddings)")
def svd(spark, sf_dir):
    """The energy and number of all singular values of the vectors' matrix, which its entries tell as well."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("embedding").cast("array<double>").alias("v"))
    values, _ = V.svd(rows, 1 << 20)
    return spark.createDataFrame([(round(float((values**2).sum()), 3), len(values))], "energy double, columns long")


@query("svd_modes")
def svd_modes(spark, sf_dir):
    """(mode, value, k, weight): the eight largest singular values and their right vectors, by blocks of Krylov directions."""
    vectors = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("embedding").cast("array<double>").alias("v"))
    size = vectors.select(F.max(F.size("v"))).first()[0] or 0
    values, modes = V.krylov_svd(vectors, 8, size, steps=4)
    return spark.createDataFrame([(m, float(s), k, float(x)) for m, (s, row) in enumerate(zip(values, modes, strict=True)) for k, x in enumerate(row)], "mode int, value double, k int, weight double")


# --- kept results -------------------------------------------------------------------
@query("range_cache", f"WITH pattern AS ({PATTERN_SQL}) SELECT vec_id, seg, round(avg(i), 6) AS i FROM pattern WHERE i >= 0 AND r BETWEEN 2 AND 5 GROUP BY vec_id, seg")
def range_cache(spark, sf_dir):
    """The mean of a range of radii, made once for its parameters and input files; the second call reads what the first has kept."""
    root = work_path(spark, "ranges")
    parameters = {"low": 2, "high": 5}

    def mean(rows):
        return rounded(rows.where((F.col("i") >= 0) & F.col("r").between(parameters["low"], parameters["high"])).groupBy("vec_id", "seg").agg(F.avg("i").alias("i")), ["vec_id", "seg"], ["i"])

    source = patterns(spark, sf_dir)
    cached(root, source, parameters, mean)
    return cached(root, source, parameters, mean)[0]


@query("batch_append", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def batch_append(spark, sf_dir):
    """Events appended by a stream in marked batches, each visible once, then summed."""
    stream = live.event_stream(spark, sf_dir)
    sink = MarkedTable(spark, work_path(spark, "marked"))
    run = stream.writeStream.foreachBatch(lambda rows, number: sink.write(rows, number)).option("checkpointLocation", work_path(spark, "marked-checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    return sink.read(stream.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
