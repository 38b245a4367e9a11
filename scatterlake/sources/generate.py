"""Generated grids: voxel models, projections and segments, as closed forms of row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segment centres of half a detector of 16, in degrees.
SEGMENTS, FIRST_DEG, STEP_DEG = 8, 11.25, 22.5


def voxels(spark: SparkSession, n: int) -> DataFrame:
    """voxel(iy, ix, iz, theta, phi, a0, a2, a4, a6, mask), n on each axis, one row from one id."""
    grid = spark.range(n**3).select(
        (F.col("id") % n + 1).cast("int").alias("iy"),
        (F.expr(f"id div {n}") % n + 1).cast("int").alias("ix"),
        (F.expr(f"id div {n * n}") + 1).cast("int").alias("iz"),
    )
    return grid.select(
        "iy", "ix", "iz",
        F.expr("3e-1 + 5e-2 * iy + 2e-2 * ix").alias("theta"),
        F.expr("2e-1 + 7e-2 * iz + 1e-2 * iy").alias("phi"),
        F.expr("1e0 + 1e-1 * ix").alias("a0"),
        F.expr("(1e0 + 1e-1 * ix) / 3e0").alias("a2"),
        F.expr("(1e0 + 1e-1 * iy) / 6e0").alias("a4"),
        F.expr("(1e0 + 1e-1 * iz) / 12e0").alias("a6"),
        F.expr(f"CASE WHEN greatest(abs(iy - {(n + 1) / 2}), abs(ix - {(n + 1) / 2}), abs(iz - {(n + 1) / 2})) <= {n / 4} THEN 1 ELSE 0 END").alias("mask"),
    )


def phantom(spark: SparkSession, n: int = 20, low: int = 7, high: int = 13) -> DataFrame:
    """A cube of intensity one in an empty volume; higher orders are fixed fractions of it."""
    inside = " AND ".join(f"{c} BETWEEN {low} AND {high}" for c in ("iy", "ix", "iz"))
    a0 = F.expr(f"CASE WHEN {inside} THEN 1e0 ELSE 0e0 END")
    half_pi = F.lit(1.5707963267948966)
    return voxels(spark, n).select(
        "iy", "ix", "iz", half_pi.alias("theta"), half_pi.alias("phi"), a0.alias("a0"), (a0 / 3).alias("a2"),
        (a0 / 6).alias("a4"), (a0 / 10000).alias("a6"), F.lit(1).alias("mask"),
    )


def projections(spark: SparkSession, count: int = 4) -> DataFrame:
    """projection(p, rot_x, rot_y, dx, dy), angles in degrees; the first is the identity."""
    return spark.range(count).select(
        F.col("id").cast("int").alias("p"),
        F.expr("11e0 * id").alias("rot_x"),
        F.expr("23e0 * id").alias("rot_y"),
        F.expr("25e-2 * id").alias("dx"),
        F.expr("-125e-3 * id").alias("dy"),
    )


def segments(spark: SparkSession, count: int = SEGMENTS) -> DataFrame:
    """segment(seg, phi_det, theta_det) in radians; theta_det is a flat Ewald sphere."""
    return spark.range(count).select(
        F.col("id").cast("int").alias("seg"),
        F.expr(f"radians({FIRST_DEG}e0 + {STEP_DEG}e0 * id)").alias("phi_det"),
        F.lit(1.5707963267948966).alias("theta_det"),
    )
