"""Queries of reconstruction by slices, masked gradients, tensor models and checks against measured images."""

from __future__ import annotations

from pyspark.sql import functions as F

from scatterlake.functions import images as K
from scatterlake.operators import art
from scatterlake.operators import model as M
from scatterlake.operators import optimize as O
from scatterlake.operators import project as P
from scatterlake.plans import grid as D
from scatterlake.plans.derive import TENSOR, tensors
from scatterlake.plans.grid import ALL, IX, NP, NY, ORDERS, S, SEG, rounded, with_sql
from scatterlake.plans.iterate import _problem
from scatterlake.plans.registry import query
from scatterlake.session import stage, table
from scatterlake.sources import generate, samples

#: Angles of the stand-in sinograms: 8 rows of 8 samples in each vector, half a turn.
ANGLES = tuple(22.5 * k for k in range(8))


def vector_rays(spark, sf_dir):
    """(slice, k, value): each vector as a sinogram, its components made intensities."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slice"), F.posexplode("embedding").alias("k", "v"))
    return rows.select("slice", "k", F.abs(F.col("v").cast("double")).alias("value"))


@query("art_slices")
def art_slices(spark, sf_dir):
    """Scalar reconstruction of every vector's slice by row-action steps, with the share of its rays left unexplained."""
    return rounded(art.reconstruct(vector_rays(spark, sf_dir), 8, ANGLES), ["slice", "y", "x"], ["v", "residual"])


def turned_images(spark, volume, angles):
    """(p, y, x, a0): the volume's a0 seen at turns about its own axis, without tilt; centred between the middle columns."""
    poses = spark.createDataFrame([(i, 0.0, float(a), -0.5, 0.0) for i, a in enumerate(angles)], "p int, rot_x double, rot_y double, dx double, dy double")
    points = P.hit_points(volume.rows.select("iy", "ix", "iz", "a0"), poses, volume.shape, volume.ny + 1, IX)
    return P.forward(points, ["a0"], volume.ny + 1, IX)


@query("slice_tomo")
def slice_tomo(spark, sf_dir):
    """(slice, y, x, v): filtered back projection, slice by slice, of the sample's images at zero tilt."""
    import numpy as np
    import pyarrow as pa

    angles = [11.25 * k for k in range(16)]
    images = turned_images(spark, samples.volume(spark, sf_dir), angles)
    rays = images.select(F.col("y").cast("long").alias("slice"), (F.col("p") * IX + F.col("x") - 1).alias("k"), F.col("a0").alias("value"))

    def invert(batches):
        for b in batches:
            for i in range(b.num_rows):
                image = np.zeros(len(angles) * IX)
                image[b.column(1)[i].values.to_numpy()] = b.column(2)[i].values.to_numpy()
                out = K.filtered_back_projection(image.reshape(-1, IX), np.array(angles), "hamming")
                y, x = np.mgrid[:IX, :IX].reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * (IX * IX)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(out.ravel())], ["slice", "y", "x", "v"])

    return rounded(art.packed_rays(rays).mapInArrow(invert, "slice long, y int, x int, v double"), ["slice", "y", "x"], ["v"])


@query("line_search")
def line_search(spark, sf_dir):
    """(round, step, error): a search along the steepest descent of a0, several steps to a job, then the step that is taken."""
    problem, start = _problem(spark, sf_dir)
    state = O.Descent.at(problem, stage(O.packed(problem, start), "blocks"), ["a0"])
    at_zero = state.errors([0.0])[0][0]
    tried = []

    def score(steps):
        values = [e for e, _ in state.errors(steps)]
        tried.extend((len(tried), float(s), float(v)) for s, v in zip(steps, values, strict=True))
        return values

    step, value, _ = O.minimise(score, at_zero / state.size, at_zero, 4, 0.05)
    return spark.createDataFrame([*tried, (-1, float(step), float(value))], "trial int, step double, error double")


@query("grad_mask", with_sql("SELECT iy, ix, iz, " + ", ".join(f"round(4 * sum(g * amp * {y}), 9) + 0.0 AS g{n}" for n, y in D.Y_SQL.items()) + " FROM b JOIN model USING (iy, ix, iz, p, seg) JOIN voxel v USING (iy, ix, iz) WHERE v.mask = 1 GROUP BY iy, ix, iz", *ALL, m=D.MEASURED_SQL, b=D.BACK_SQL))
def grad_mask(spark, sf_dir):
    """The gradient inside the mask: what lies outside isn't gathered at all."""
    volume = samples.volume(spark, sf_dir)
    inside = samples.Volume(volume.rows.where(F.col("mask") == 1), volume.ny)
    rows = D.gathered(spark, inside, D.residual_images(spark, volume))
    c = [M.cosine_to(f"{k}_qx", f"{k}_qy", f"{k}_qz") for k in range(SEG)]
    out = []
    for n in ORDERS:
        terms = [F.col(f"s{k}") * M.amplitude(c[k]) * M.harmonic(n, c[k]) for k in range(SEG)]
        out.append((4 * F.sum(sum(terms[1:], terms[0]))).alias(f"g{n}"))
    return rounded(rows.groupBy("iy", "ix", "iz").agg(*out), ["iy", "ix", "iz"], [f"g{n}" for n in ORDERS], 9)


QUADRATIC = "xx * qx * qx + yy * qy * qy + zz * qz * qz + 2 * (xy * qx * qy + xz * qx * qz + yz * qy * qz)"


@query("tensor_error", with_sql(f"""SELECT p, round(2 * sum((sqrt(greatest(t.i, 0)) - sqrt(m.d)) ** 2) / {D.PIXELS_SQL}, 9) AS e
FROM (SELECT t.p, t.py AS y, t.px AS x, s.seg, sum(s.i * t.w) AS i FROM tap t JOIN ten s USING (iy, ix, iz, p) WHERE floor(xp) > 0 AND floor(xp) < {IX} AND floor(yp) > 0 AND floor(yp) < {NY} GROUP BY ALL) t JOIN m USING (p, y, x, seg) GROUP BY p""",
    *ALL, m=D.MEASURED_SQL, ten=f"SELECT iy, ix, iz, p, seg, {QUADRATIC} AS i FROM ({TENSOR}), q"))
def tensor_error(spark, sf_dir):
    """The error of a tensor model: q' T q summed along the rays, held at zero, against the measured images."""
    volume = samples.volume(spark, sf_dir)
    points = P.hit_points(tensors(spark, sf_dir), generate.projections(spark, NP), volume.shape, volume.ny, IX)
    met = points.join(P.checked_broadcast(D.wide_directions(spark)), "p")
    values = []
    for k in range(SEG):
        x, y, z = (F.col(f"{k}_{a}") for a in ("qx", "qy", "qz"))
        values.append((F.col("xx") * x * x + F.col("yy") * y * y + F.col("zz") * z * z + 2 * (F.col("xy") * x * y + F.col("xz") * x * z + F.col("yz") * y * z)).alias(S[k]))
    images = D.unpivot(P.forward(met.select("p", "xp", "yp", *values), S, volume.ny, IX), ["p", "y", "x"])
    both = images.join(D.measured(D.modelled(spark, volume)).select("p", "y", "x", "seg", "d"), ["p", "y", "x", "seg"])
    e = 2 * F.sum(F.pow(F.sqrt(F.greatest(F.col("i"), F.lit(0.0))) - F.sqrt("d"), 2)) / D.pixels(volume)
    return rounded(both.groupBy("p").agg(e.alias("e")), ["p"], ["e"], 9)


@query("check_result", with_sql("""SELECT p, count(*) AS n, round(avg(a), 6) AS modelled, round(avg(b), 6) AS measured, round(sqrt(avg((a - b) ** 2)), 6) AS rms, round(max(abs(a - b)), 6) AS worst, round(corr(a, b), 6) AS agreement
FROM (SELECT p, y, x, avg(i) AS a, avg(d) AS b FROM m GROUP BY p, y, x) GROUP BY p""", *ALL, m=D.MEASURED_SQL))
def check_result(spark, sf_dir):
    """Modelled against measured maps, the mean of the segments of each pixel: one row for each projection."""
    maps = D.measured(D.modelled(spark, samples.volume(spark, sf_dir))).groupBy("p", "y", "x").agg(F.avg("i").alias("a"), F.avg("d").alias("b"))
    gap = F.col("a") - F.col("b")
    found = maps.groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("modelled"), F.avg("b").alias("measured"),
        F.sqrt(F.avg(gap * gap)).alias("rms"), F.max(F.abs(gap)).alias("worst"), F.corr("a", "b").alias("agreement"),
    )
    return rounded(found, ["p", "n"], ["modelled", "measured", "rms", "worst", "agreement"])
