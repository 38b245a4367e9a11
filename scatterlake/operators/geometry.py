"""Rotations, directions and grid coordinates as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotation_columns(rot_x: str = "rot_x", rot_y: str = "rot_y", flip_x: bool = False, flip_y: bool = False) -> list[Column]:
    """r11..r33 of Rx * Ry, angles in degrees, optionally with a flipped sense."""
    a = F.radians(-F.col(rot_x) if flip_x else F.col(rot_x))
    b = F.radians(-F.col(rot_y) if flip_y else F.col(rot_y))
    ca, sa, cb, sb = F.cos(a), F.sin(a), F.cos(b), F.sin(b)
    values = [cb, F.lit(0.0), sb, sa * sb, ca, -sa * cb, -ca * sb, sa, ca * cb]
    return [v.alias(f"r{i // 3 + 1}{i % 3 + 1}") for i, v in enumerate(values)]


def rotation_xyz(ax: Column, ay: Column, az: Column) -> list[Column]:
    """m11..m33 of Rx * Ry * Rz, angles in radians."""
    cx, sx, cy, sy, cz, sz = F.cos(ax), F.sin(ax), F.cos(ay), F.sin(ay), F.cos(az), F.sin(az)
    values = [
        cy * cz, -cy * sz, sy,
        cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy,
        sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy,
    ]
    return [v.alias(f"m{i // 3 + 1}{i % 3 + 1}") for i, v in enumerate(values)]


def axis_columns(theta: str = "theta", phi: str = "phi") -> list[Column]:
    """ux, uy, uz: the local axis of a voxel, the third row of its rotation."""
    t, p = F.col(theta), F.col(phi)
    return [(F.sin(t) * F.cos(p)).alias("ux"), (F.sin(t) * F.sin(p)).alias("uy"), F.cos(t).alias("uz")]


def directions(projections: DataFrame, segments: DataFrame) -> DataFrame:
    """(p, seg, qx, qy, qz): q of every segment in object coordinates, R' * q.

    Both inputs are geometry of the instrument: projections x segments rows.
    """
    t, f = F.col("theta_det"), F.col("phi_det")
    rows = projections.select("p", *rotation_columns()).crossJoin(
        segments.select("seg", (F.sin(t) * F.cos(f)).alias("bx"), (F.sin(t) * F.sin(f)).alias("by"), F.cos(t).alias("bz"))
    )
    q = [F.col(f"r1{k}") * F.col("bx") + F.col(f"r2{k}") * F.col("by") + F.col(f"r3{k}") * F.col("bz") for k in (1, 2, 3)]
    return rows.select("p", "seg", q[0].alias("qx"), q[1].alias("qy"), q[2].alias("qz"))


def centred(index: str, n: int) -> Column:
    """1..n about ceil(n / 2), the centre of the harmonic reconstruction."""
    return F.col(index) - F.lit((n + 1) // 2)
