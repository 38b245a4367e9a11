"""Driver tables read as a scanned sample: a volume of voxels, poses of its stage, scan logs, file names.

The mapping is a stand-in, without physical meaning. The volume has a slice for
each vector, along the vertical axis about which the sample turns: 8 x 8 voxels
of a slice, a model's parameters from components of the vector. It grows with
the table, and its images with it, while a pixel sees at most one slice's
breadth of voxels, so that no key grows hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.operators import project as P
from scatterlake.session import table

#: Voxels of a slice along ix and iz, and columns of the images that a turned slice fits in.
SIDE, COLUMNS = 8, 16
#: Vectors in one partition of the volume, at most about.
EACH = 8_192


@dataclass(frozen=True)
class Volume:
    """voxel(iy, ix, iz, theta, phi, a0, a2, a4, a6, mask, slab); iy is 1 + vec_id, up to ``ny``.

    Rows are partitioned by slab, so neighbours in iy share a task.
    """

    rows: DataFrame
    ny: int

    @property
    def shape(self) -> tuple[int, int, int]:
        return (self.ny, SIDE, SIDE)

    @property
    def bounds(self) -> dict[str, tuple[int, int]]:
        return {"iy": (1, self.ny), "ix": (1, SIDE), "iz": (1, SIDE)}


def volume(spark: SparkSession, sf_dir: str, halo: int = 0, each: int = EACH) -> Volume:
    """The volume in partitions of about ``each`` vectors at most; a slab also gets the ``halo`` slices next to it.

    With a halo a slice stands in several slabs: what a slab computes beyond its own slices must be dropped (``P.own``).
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ny = int(vectors.agg(F.coalesce(F.max("vec_id"), F.lit(-1)) + 1).first()[0])
    # each vector becomes 64 voxels, and each of these 16 taps of images: compact rows are spread first
    near = [P.slab(F.col("vec_id") + 1 + o) for o in ((-halo, 0, halo) if halo else (0,))]
    vectors = vectors.withColumn("slab", F.explode(F.array_distinct(F.array(*near))) if halo else near[0])
    vectors = vectors.repartition(max(spark.sparkContext.defaultParallelism, ny // each), "slab")
    e = F.col("embedding")
    at = lambda step: F.get(e, F.pmod(F.col("k") + step, F.size(e))).cast("double")
    rows = vectors.select("slab", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.size(e) - 1)).alias("k"))
    rows = rows.select("slab", "vec_id", "k", at(0).alias("e0"), at(16).alias("e1"), at(32).alias("e2"), at(48).alias("e3"))
    rows = rows.select(
        (F.col("vec_id") + 1).cast("int").alias("iy"), (F.col("k") % SIDE + 1).cast("int").alias("ix"),
        F.expr(f"CAST(k div {SIDE} + 1 AS INT)").alias("iz"), "e0", "e1", "e2", "e3", "slab",
    )
    inside = F.greatest(F.abs(F.col("ix") - 4.5), F.abs(F.col("iz") - 4.5)) <= 2.5
    return Volume(
        rows.select(
            "iy", "ix", "iz",
            F.expr("3e-1 + abs(e0) + 5e-2 * ix").alias("theta"),
            F.expr("2e-1 + e1 + 7e-2 * iz").alias("phi"),
            F.expr("1e0 + abs(e0)").alias("a0"),
            F.expr("(1e0 + e1) / 3e0").alias("a2"),
            F.expr("(1e0 + e2) / 6e0").alias("a4"),
            F.expr("(1e0 + e3) / 12e0").alias("a6"),
            F.when(inside & (F.abs("e0") < 0.4), 1).otherwise(0).alias("mask"),
            "slab",
        ),
        ny,
    )


NY_SQL = "(SELECT CAST(max(vec_id) + 1 AS INTEGER) FROM embeddings)"
VOXEL_SQL = f"""SELECT iy, ix, iz, 3e-1 + abs(e0) + 5e-2 * ix AS theta, 2e-1 + e1 + 7e-2 * iz AS phi, 1e0 + abs(e0) AS a0, (1e0 + e1) / 3e0 AS a2, (1e0 + e2) / 6e0 AS a4, (1e0 + e3) / 12e0 AS a6,
  CASE WHEN greatest(abs(ix - 4.5), abs(iz - 4.5)) <= 2.5 AND abs(e0) < 0.4 THEN 1 ELSE 0 END AS mask
  FROM (SELECT CAST(vec_id + 1 AS INTEGER) AS iy, CAST(k % {SIDE} + 1 AS INTEGER) AS ix, CAST(k // {SIDE} + 1 AS INTEGER) AS iz, CAST(embedding[k + 1] AS DOUBLE) AS e0,
    CAST(embedding[(k + 16) % len(embedding) + 1] AS DOUBLE) AS e1, CAST(embedding[(k + 32) % len(embedding) + 1] AS DOUBLE) AS e2, CAST(embedding[(k + 48) % len(embedding) + 1] AS DOUBLE) AS e3
    FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings))"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pose(p, rot_x, rot_y, dx, dy, phi_det, theta_det): each event as a position of the stage and of a detector."""
    e = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    return e.select(
        F.col("event_id").alias("p"),
        F.expr("value - 90e0 * floor(value / 90e0)").alias("rot_x"),
        F.expr("CAST(event_id % 360 AS DOUBLE) + 25e-2").alias("rot_y"),
        F.expr("25e-2 * (event_id % 5)").alias("dx"),
        F.expr("-125e-3 * (event_id % 3)").alias("dy"),
        F.expr("radians(value + 11.25e0)").alias("phi_det"),
        F.lit(1.5707963267948966).alias("theta_det"),
    )


POSE_SQL = """SELECT event_id AS p, value - 90e0 * floor(value / 90e0) AS rot_x, CAST(event_id % 360 AS DOUBLE) + 25e-2 AS rot_y, 25e-2 * (event_id % 5) AS dx, -125e-3 * (event_id % 3) AS dy, radians(value + 11.25e0) AS phi_det, pi() / 2 AS theta_det
  FROM (SELECT event_id, CAST(value AS DOUBLE) AS value FROM events WHERE value IS NOT NULL)"""

#: Lines of one scan in a log, and scans in one file of it.
LINES, SCANS = 40, 10


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line(file, line_no, text): the events written as a scan log, SCANS scans to a file.

    Every event is a line: a scan's head, date, motors, columns, counts, a mark in the middle and an end, in turn.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))
    i, n, k = F.col("event_id"), F.expr(f"event_id div {LINES}"), F.col("event_id") % LINES
    text = (
        F.when(k == 0, F.concat(F.lit("#S "), n + 1, F.lit(" cscan x 0 10")))
        .when(k == 1, F.concat(F.lit("#D "), F.date_format("ts", "yyyy-MM-dd")))
        .when(k == 2, F.concat(F.lit("#P0 "), i, F.lit(" "), i * 2))
        .when(k == 3, "#L x y det")
        .when(k == 20, F.concat(F.lit("#C mark "), F.when(n % 3 == 0, "A").otherwise("BB")))
        .when(k == 39, F.when(n % 2 == 0, F.concat(F.lit("#X "), n + 1)).otherwise("#C aborted"))
        .otherwise(F.concat_ws(" ", F.floor(F.abs("value") * 100), i % 5, F.lit(1)))
    )
    return e.select(F.expr(f"event_id div {LINES * SCANS}").cast("int").alias("file"), i.alias("line_no"), text.alias("text"))


LOG_SQL = f"""line AS (SELECT CAST(event_id // {LINES * SCANS} AS INTEGER) AS file, event_id AS line_no, CASE event_id % {LINES} WHEN 0 THEN '#S ' || (event_id // {LINES} + 1) || ' cscan x 0 10' WHEN 1 THEN '#D ' || strftime(ts, '%Y-%m-%d')
 WHEN 2 THEN '#P0 ' || event_id || ' ' || event_id * 2 WHEN 3 THEN '#L x y det' WHEN 20 THEN '#C mark ' || CASE WHEN event_id // {LINES} % 3 = 0 THEN 'A' ELSE 'BB' END
 WHEN 39 THEN CASE WHEN event_id // {LINES} % 2 = 0 THEN '#X ' || (event_id // {LINES} + 1) ELSE '#C aborted' END
 ELSE CAST(floor(abs(coalesce(value, 0)) * 100) AS BIGINT) || ' ' || (event_id % 5) || ' 1' END AS text FROM events)"""
