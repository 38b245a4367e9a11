"""Queries of the scanning analysis over stand-in patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scatterlake.operators import pattern as P
from scatterlake.plans.grid import rounded
from scatterlake.plans.registry import query
from scatterlake.session import table
from scatterlake.sources.standins import PATTERN_SQL, patterns

PAT = f"WITH pattern AS ({PATTERN_SQL})"
TRANS = "(5e-1 + (vec_id % 10) / 2e1)"
BGR = "bgr AS (SELECT r, seg, coalesce(avg(i) FILTER (WHERE i >= 0), -1) AS bgr FROM pattern GROUP BY r, seg)"
MEAN = "sum(i * n) FILTER (WHERE i >= 0) / sum(n) FILTER (WHERE i >= 0)"
PROFILE = f"profile AS (SELECT vec_id, r + 1 AS r, greatest(0, coalesce({MEAN}, 0)) / ({TRANS} + 1e-12) AS s FROM pattern GROUP BY vec_id, r)"
FOLD = f"fold AS (SELECT vec_id, r, CAST(seg % 4 AS INTEGER) AS seg, coalesce({MEAN}, -1) AS i, CAST(coalesce(sum(n) FILTER (WHERE i >= 0), 0) AS INTEGER) AS n FROM pattern GROUP BY vec_id, r, seg % 4)"
FOUR = """four AS (SELECT vec_id, f0 / 8 AS f1, 2 * sqrt(re * re + im * im) / 8 AS f2, atan2(im, re) AS phase, sqrt(greatest(0, 8 * sq - f0 * f0 - 2 * (re * re + im * im))) / 8 AS dev FROM (
  SELECT vec_id, sum(v) AS f0, sum(v * cos(seg * pi() / 4)) AS re, sum(-v * sin(seg * pi() / 4)) AS im, sum(v * v) AS sq FROM (SELECT vec_id, seg, CASE WHEN i >= 0 THEN i ELSE 0 END AS v FROM pattern WHERE r = 3) GROUP BY vec_id))"""


def transmission():
    return F.lit(0.5) + (F.col("vec_id") % 10) / 20.0


def profiles(spark, sf_dir):
    """Symmetric intensity by radius, radii from 1."""
    rows = P.symmetric(patterns(spark, sf_dir), ["vec_id"], transmission())
    return rows.withColumn("r", (F.col("r") + 1).cast("int"))


def four(spark, sf_dir):
    return P.fourier(patterns(spark, sf_dir).where(F.col("r") == 3), ["vec_id"])


@query("bgr_avg", f"{PAT}, {BGR} SELECT r, seg, round(bgr, 6) AS bgr FROM bgr")
def bgr_avg(spark, sf_dir):
    return rounded(P.background(patterns(spark, sf_dir)), ["r", "seg"], ["bgr"])


def _passes(n):
    sql, source = [], "t0"
    for k in range(n):
        sql.append(f"t{k + 1} AS (SELECT * FROM {source} WHERE abs(t / (SELECT median(t) FROM {source}) - 1) <= {0.3 if k == 0 else 0.15})")
        source = f"t{k + 1}"
    return ", ".join(sql)


@query("bgr_filter", f"{PAT}, t0 AS (SELECT vec_id, sum(i) FILTER (WHERE i >= 0) AS t FROM pattern GROUP BY vec_id), {_passes(5)} SELECT vec_id, round(t, 6) AS t FROM t5")
def bgr_filter(spark, sf_dir):
    total = patterns(spark, sf_dir).groupBy("vec_id").agg(F.sum(F.when(P.known(), F.col("i"))).alias("t"))
    return rounded(P.drop_outliers(total, "t", 0.15), ["vec_id"], ["t"])


@query("bgr_sub", f"{PAT}, {BGR} SELECT vec_id, r, seg, round(CASE WHEN i >= 0 AND bgr >= 0 THEN i - bgr ELSE i END, 6) + 0.0 AS i FROM pattern JOIN bgr USING (r, seg)")
def bgr_sub(spark, sf_dir):
    p = patterns(spark, sf_dir)
    return rounded(P.subtract_background(p, P.background(p)), ["vec_id", "r", "seg"], ["i"])


@query("sym_int", f"{PAT}, {PROFILE} SELECT vec_id, r, round(s, 6) AS s FROM profile")
def sym_int(spark, sf_dir):
    return rounded(profiles(spark, sf_dir), ["vec_id", "r"], ["s"])


@query("fold_half", f"{PAT}, {FOLD} SELECT vec_id, r, seg, n, round(i, 6) AS i FROM fold")
def fold_half(spark, sf_dir):
    return rounded(P.fold(patterns(spark, sf_dir), ["vec_id"]), ["vec_id", "r", "seg", "n"], ["i"])


@query("gap_fill", f"""{PAT}, a AS (SELECT *, CASE WHEN i >= 0 THEN i END AS v FROM pattern),
b AS (SELECT *, CASE WHEN v IS NULL AND lag(v) OVER w IS NOT NULL AND lead(v) OVER w IS NOT NULL THEN (lag(v) OVER w * lag(n) OVER w + lead(v) OVER w * lead(n) OVER w) / (lag(n) OVER w + lead(n) OVER w) ELSE v END AS u FROM a WINDOW w AS (PARTITION BY vec_id ORDER BY r, seg))
SELECT vec_id, r, seg, round(coalesce(last_value(u IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY r, seg ROWS UNBOUNDED PRECEDING), first_value(u IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY r, seg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS i FROM b""")
def gap_fill(spark, sf_dir):
    return rounded(P.fill_gaps(patterns(spark, sf_dir), ["vec_id"]), ["vec_id", "r", "seg"], ["i"])


@query("fold_diff", f"{PAT}, a AS (SELECT vec_id, r, max(i) FILTER (WHERE seg = 0 AND i >= 0) AS a, max(i) FILTER (WHERE seg = 4 AND i >= 0) AS b FROM pattern GROUP BY vec_id, r) SELECT vec_id, round(coalesce(avg((a - b) / (a + b)), 0), 6) + 0.0 AS d FROM a GROUP BY vec_id")
def fold_diff(spark, sf_dir):
    return rounded(P.asymmetry(patterns(spark, sf_dir), ["vec_id"]), ["vec_id"], ["d"])


RANGES = [(0, 0, 2), (1, 2, 5), (2, 4, 7)]


@query("q_ranges", f"{PAT}, q(range_id, a, b) AS (VALUES (0, 0, 2), (1, 2, 5), (2, 4, 7)) SELECT vec_id, range_id, seg, round(sum(i * n) / (sum(n) + 1e-12), 6) AS i FROM pattern JOIN q ON r BETWEEN a AND b WHERE i >= 0 GROUP BY vec_id, range_id, seg")
def q_ranges(spark, sf_dir):
    ranges = spark.createDataFrame(RANGES, "range_id int, r_from int, r_to int")
    return rounded(P.over_ranges(patterns(spark, sf_dir), ranges, ["vec_id"]), ["vec_id", "range_id", "seg"], ["i"])


SIDES = "side AS (SELECT vec_id, avg(s) FILTER (WHERE r BETWEEN 2 AND 3) AS a, avg(s) FILTER (WHERE r BETWEEN 6 AND 7) AS b FROM profile GROUP BY vec_id)"


@query("bgr_power", f"""{PAT}, {PROFILE}, {SIDES}, fit AS (SELECT *, greatest(-0.1, least(4.1, coalesce(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) / ln(2.5 / 6.5) END, 0))) AS p FROM side),
one AS (SELECT *, 2.5 ** -p - 6.5 ** -p AS span, 2.5 ** -2 - 6.5 ** -2 AS span2 FROM fit)
SELECT vec_id, round(p, 6) + 0.0 AS p, round((a - b) / span2, 6) + 0.0 AS fixed_i1, round(b - (a - b) / span2 * 6.5 ** -2, 6) + 0.0 AS fixed_i0 FROM one""")
def bgr_power(spark, sf_dir):
    rows = profiles(spark, sf_dir)
    fitted = P.power_background(rows, ["vec_id"], 4, 5, 2, 1, None).select("vec_id", "p")
    fixed = P.power_background(rows, ["vec_id"], 4, 5, 2, 1, 2.0).select("vec_id", F.col("i0").alias("fixed_i0"), F.col("i1").alias("fixed_i1"))
    return rounded(fitted.join(fixed, "vec_id"), ["vec_id"], ["p", "fixed_i0", "fixed_i1"])


@query("fourier", f"{PAT}, {FOUR} SELECT vec_id, round(f1, 6) AS f1, round(f2, 6) AS f2, round(phase, 6) + 0.0 AS phase, round(dev, 6) AS dev FROM four")
def fourier(spark, sf_dir):
    return rounded(four(spark, sf_dir), ["vec_id"], ["f1", "f2", "phase", "dev"])


@query("orientation", f"{PAT}, {FOUR}, a AS (SELECT *, 11.25e0 - phase / pi() * 90 + 90 AS t FROM four) SELECT vec_id, round(t - 180 * floor(t / 180) - 90, 6) + 0.0 AS angle, round(f2 / (f1 + 1e-6), 6) AS degree FROM a")
def orientation(spark, sf_dir):
    rows = four(spark, sf_dir).select("vec_id", P.orientation(F.col("phase"), 11.25).alias("angle"), P.degree().alias("degree"))
    return rounded(rows, ["vec_id"], ["angle", "degree"])


@query("power_slope", f"{PAT}, {PROFILE} SELECT vec_id, round(coalesce(regr_slope(ln(s), ln(r)) FILTER (WHERE s > 0), 0), 6) + 0.0 AS slope FROM (SELECT vec_id, r, CASE WHEN s > 0 THEN s ELSE NULL END AS s FROM profile) GROUP BY vec_id")
def power_slope(spark, sf_dir):
    return rounded(P.log_slope(profiles(spark, sf_dir), ["vec_id"]), ["vec_id"], ["slope"])


@query("abs_corr", f"{PAT}, {PROFILE} SELECT a.vec_id, a.r, round((a.s * 1.5 / {TRANS.replace('vec_id', 'a.vec_id')} - b.s * 1.5) / 0.1, 5) + 0.0 AS s FROM profile a JOIN profile b ON b.vec_id = a.vec_id - a.vec_id % 10 AND a.r = b.r WHERE a.vec_id % 10 <> 0")
def abs_corr(spark, sf_dir):
    """((I s) / T - air s) / thickness; the first point of ten is the air scan of the rest."""
    rows, scale, thickness = profiles(spark, sf_dir), 1.5, 0.1
    air = rows.where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("air_id"), "r", F.col("s").alias("air"))
    met = rows.where(F.col("vec_id") % 10 != 0).withColumn("air_id", F.col("vec_id") - F.col("vec_id") % 10).join(air, ["air_id", "r"])
    return rounded(met.withColumn("s", (F.col("s") * scale / transmission() - F.col("air") * scale) / thickness), ["vec_id", "r"], ["s"], 5)


@query("peak_simple", f"""{PAT}, {PROFILE}, a AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS top FROM profile), b AS (SELECT *, min(r) FILTER (WHERE s = top) OVER (PARTITION BY vec_id) AS pos FROM a),
c AS (SELECT vec_id, pos, top, coalesce(max(r) FILTER (WHERE s <= top / 2 AND r < pos), 1) AS l, coalesce(min(r) FILTER (WHERE s <= top / 2 AND r > pos), 8) AS u FROM b GROUP BY vec_id, pos, top),
d AS (SELECT c.*, l + coalesce((top / 2 - l0.s) / nullif(l1.s - l0.s, 0), 0) AS lx, u + coalesce((top / 2 - u0.s) / nullif(u0.s - u1.s, 0), 0) AS ux FROM c JOIN profile l0 ON l0.vec_id = c.vec_id AND l0.r = l LEFT JOIN profile l1 ON l1.vec_id = c.vec_id AND l1.r = l + 1 JOIN profile u0 ON u0.vec_id = c.vec_id AND u0.r = u LEFT JOIN profile u1 ON u1.vec_id = c.vec_id AND u1.r = u - 1)
SELECT vec_id, pos, round(top, 6) AS top, round(least(8, greatest(1, lx)), 6) AS "left", round(CASE WHEN ux + 1 >= 8 THEN 8 ELSE greatest(1, ux) END, 6) AS "right" FROM d""")
def peak_simple(spark, sf_dir):
    return rounded(P.simple_peak(profiles(spark, sf_dir), ["vec_id"], 8), ["vec_id", "pos"], ["top", "left", "right"])


@query("trans_norm", """WITH e AS (SELECT min(value) AS low, (max(value) - min(value)) / 1048575 AS step, count(value) AS total FROM events), b AS (SELECT CAST(round((value - low) / step) AS BIGINT) AS bin, low, step, total, count(*) AS c FROM events, e WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (ORDER BY bin) AS run FROM b), n AS (SELECT min(bin) FILTER (WHERE run > 0.99 * total) * any_value(step) + any_value(low) AS norm FROM r) SELECT event_id, round(value / norm, 6) + 0.0 AS t FROM events, n""")
def trans_norm(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    level = P.transmission_level(rows, "value")
    return rounded(rows.crossJoin(F.broadcast(level)).withColumn("t", F.col("value") / F.col("norm")), ["event_id"], ["t"])


@query("trans_div", f"{PAT}, {PROFILE} SELECT vec_id, r, round(coalesce(s / nullif((vec_id % 5) / 5e0, 0), 0), 6) + 0.0 AS s FROM profile")
def trans_div(spark, sf_dir):
    """Maps over a transmission that may be zero: what isn't finite becomes 0."""
    quotient = F.try_divide(F.col("s"), (F.col("vec_id") % 5) / 5.0)
    return rounded(profiles(spark, sf_dir).withColumn("s", F.coalesce(quotient, F.lit(0.0))), ["vec_id", "r"], ["s"])


@query("snake", f"{PAT} SELECT vec_id // 10 AS y, CASE WHEN (vec_id // 10) % 2 = 1 THEN 9 - vec_id % 10 ELSE vec_id % 10 END AS x, round(max(i), 6) AS i FROM pattern GROUP BY vec_id")
def snake(spark, sf_dir):
    rows = patterns(spark, sf_dir).groupBy("vec_id").agg(F.max("i").alias("i"))
    rows = rows.select(F.expr("vec_id div 10").alias("y"), (F.col("vec_id") % 10).alias("x0"), "i")
    return rounded(rows.withColumn("x", P.snake_x("x0", "y", 10)), ["y", "x"], ["i"])


@query("snake_detect", """WITH s AS (SELECT vec_id // 10 AS y, (CASE WHEN (vec_id // 10) % 2 = 1 THEN 9 - vec_id % 10 ELSE vec_id % 10 END) * 1e-1 + 1e-3 * sin(vec_id) AS x, vec_id % 10 AS k FROM embeddings), d AS (SELECT y, x - lag(x) OVER (PARTITION BY y ORDER BY k) AS step FROM s)
SELECT y, CAST(sign(avg(step)) AS INTEGER) AS direction, coalesce(stddev_samp(step), 0) > 0.05 * abs(avg(step)) AS uneven FROM d GROUP BY y HAVING count(step) > 0""")
def snake_detect(spark, sf_dir):
    """Direction of each line from the mean step, and whether steps vary by more than 5 %."""
    y, k = F.expr("vec_id div 10"), F.col("vec_id") % 10
    place = F.when(y % 2 == 1, 9 - k).otherwise(k) * 0.1 + 0.001 * F.sin("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(y.alias("y"), k.alias("k"), place.alias("x"))
    steps = rows.withColumn("step", F.col("x") - F.lag("x").over(Window.partitionBy("y").orderBy("k"))).where(F.col("step").isNotNull())
    mean = F.avg("step")
    return steps.groupBy("y").agg(F.signum(mean).cast("int").alias("direction"), (F.coalesce(F.stddev_samp("step"), F.lit(0.0)) > 0.05 * F.abs(mean)).alias("uneven"))


@query("doo_hist", f"{PAT}, {FOUR}, d AS (SELECT f2 / (f1 + 1e-6) AS d FROM four) SELECT CAST(floor(d * 1000) AS BIGINT) AS bin, count(*) AS c, (SELECT round(median(d), 6) FROM d) AS med, (SELECT round(stddev_samp(d), 6) FROM d) AS sd FROM d GROUP BY bin")
def doo_hist(spark, sf_dir):
    d = four(spark, sf_dir).select(P.degree().alias("d"))
    overall = d.agg(F.round(F.percentile("d", 0.5), 6).alias("med"), F.round(F.stddev_samp("d"), 6).alias("sd"))
    return d.groupBy(F.floor(F.col("d") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(overall))


@query("q_edges", f"""WITH pattern AS ({PATTERN_SQL}), top AS (SELECT vec_id, 2e1 + max(i) AS top FROM pattern WHERE i >= 0 GROUP BY vec_id), e AS (SELECT vec_id, range AS k, CAST(round(10 ** (ln(20) / ln(10) + range * (ln(top * 8) - ln(20)) / ln(10) / 60)) AS BIGINT) AS edge FROM top, range(61)), d AS (SELECT vec_id, edge, lag(edge) OVER (PARTITION BY vec_id ORDER BY k) AS prev FROM e) SELECT vec_id, edge FROM d WHERE prev IS NULL OR prev <> edge""")
def q_edges(spark, sf_dir):
    """Logarithmic integer edges from 20 to eight times the reach of each pattern; equal neighbours are dropped."""
    top = patterns(spark, sf_dir).where(F.col("i") >= 0).groupBy("vec_id").agg((20.0 + F.max("i")).alias("top"))
    rows = top.select("vec_id", "top", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("k"))
    low = F.log10(F.lit(20.0))
    edge = F.round(F.pow(F.lit(10.0), low + F.col("k") * (F.log10(F.col("top") * 8) - low) / 60)).cast("long")
    rows = rows.select("vec_id", "k", edge.alias("edge")).withColumn("prev", F.lag("edge").over(Window.partitionBy("vec_id").orderBy("k")))
    return rows.where(F.col("prev").isNull() | (F.col("prev") != F.col("edge"))).select("vec_id", "edge")


@query("spacing", "SELECT event_id, round(tan(2 * asin(0.9116e0 / (2e0 * d))) / 0.172e0 * 7126, 6) AS px, round(4 * pi() * sin(atan(d * 0.172e0 / 7126) / 2) / 0.9116e0, 9) AS q FROM (SELECT event_id, 1 + abs(value) AS d FROM events WHERE value IS NOT NULL)")
def spacing(spark, sf_dir):
    """d-spacing (A) to pixel, and pixel to q, for the instrument's constants; an event's value is the spacing."""
    wave, size, distance = 0.9116, 0.172, 7126.0
    d = F.col("d")
    rows = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).select("event_id", (1 + F.abs("value")).alias("d"))
    return rows.select(
        "event_id",
        F.round(F.tan(2 * F.asin(wave / (2 * d))) / size * distance, 6).alias("px"),
        F.round(4 * F.pi() * F.sin(F.atan(d * size / distance) / 2) / wave, 9).alias("q"),
    )


@query("beer_lambert", f"{PAT}, {PROFILE} SELECT vec_id, round(-ln(sum(s) / (SELECT max(t) FROM (SELECT sum(s) AS t FROM profile GROUP BY vec_id))), 6) + 0.0 AS mu FROM profile GROUP BY vec_id")
def beer_lambert(spark, sf_dir):
    """-ln(I / I_air); the brightest point is taken as air."""
    total = profiles(spark, sf_dir).groupBy("vec_id").agg(F.sum("s").alias("t"))
    air = total.agg(F.max("t").alias("air"))
    return rounded(total.crossJoin(F.broadcast(air)).withColumn("mu", -F.ln(F.col("t") / F.col("air"))), ["vec_id"], ["mu"])


@query("projection_build", f"""{PAT} SELECT CAST(vec_id // 100 AS INTEGER) AS p, CAST(vec_id % 100 // 10 AS INTEGER) AS y, CAST(vec_id % 10 AS INTEGER) AS x, seg, round(i / {TRANS}, 6) AS i,
round(cos(radians(3e0 * (vec_id // 100))), 9) AS r11, round(sin(radians(2e0 * (vec_id // 100))), 9) + 0.0 AS r32 FROM pattern WHERE r = 3 AND i >= 0""")
def projection_build(spark, sf_dir):
    """Projection records: pixels over transmission beside two entries of the rotation of their projection."""
    p = F.expr("CAST(vec_id div 100 AS INT)")
    rows = patterns(spark, sf_dir).where((F.col("r") == 3) & P.known()).select(
        p.alias("p"), F.expr("CAST(vec_id % 100 div 10 AS INT)").alias("y"), (F.col("vec_id") % 10).cast("int").alias("x"), "seg",
        (F.col("i") / transmission()).alias("i"), (2.0 * p).alias("rot_x"), (3.0 * p).alias("rot_y"),
    )
    from scatterlake.operators.geometry import rotation_columns

    rows = rows.select("p", "y", "x", "seg", F.round("i", 6).alias("i"), *rotation_columns())
    return rows.select("p", "y", "x", "seg", "i", F.round("r11", 9).alias("r11"), (F.round("r32", 9) + F.lit(0.0)).alias("r32"))
