"""Forward and back projection between a voxel grid and measured images.

Intensities of all segments ride as columns of one row, so the explode makes
voxels x projections x 4 rows, not x segments; map-side aggregation shrinks
them before the shuffle. The projection table is geometry: its size is checked
before it is broadcast.

Images come back to the voxels by slabs, runs of slices along iy: each slab gets
the image rows that its voxels meet, once, and gathers its pixels in place, so
that no row is made for each voxel, projection and pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.operators.geometry import centred, rotation_columns

MAX_BROADCAST_ROWS = 100_000
#: Slices in a slab.
SLAB = 64


def slab(iy: str | Column = "iy") -> Column:
    """The slab of a slice, a column to partition voxels by."""
    return F.floor((F.col(iy) if isinstance(iy, str) else iy) / SLAB).cast("int").alias("slab")


def own(iy: str | Column = "iy") -> Column:
    """Whether a slice is one of its row's slab, not of the slab's halo."""
    return slab(iy) == F.col("slab")


def checked_broadcast(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hit_points(voxels: DataFrame, projections: DataFrame, shape: int | tuple[int, int, int], ny: int, nx: int) -> DataFrame:
    """Every voxel with every projection, and its image coordinates xp, yp from 1.

    ``shape`` is the volume's size along iy, ix, iz, or one size for all. Image columns run from 1 - ceil(nx / 2) + dx, rows likewise.
    """
    geometry = projections.select("p", "dx", "dy", *rotation_columns())
    rows = voxels.crossJoin(checked_broadcast(geometry))
    sizes = (shape,) * 3 if isinstance(shape, int) else shape
    y, x, z = (centred(c, n) for c, n in zip(("iy", "ix", "iz"), sizes, strict=True))
    at = [F.col(f"r{k}1") * x + F.col(f"r{k}2") * y + F.col(f"r{k}3") * z for k in (1, 2)]
    low_x, low_y = 1 - (nx + 1) // 2, 1 - (ny + 1) // 2
    return rows.select(*voxels.columns, "p", (at[0] - low_x - F.col("dx") + 1).alias("xp"), (at[1] - low_y - F.col("dy") + 1).alias("yp"))


def _taps() -> Column:
    ax, ay = F.floor("xp"), F.floor("yp")
    tx, ty = F.col("xp") - ax, F.col("yp") - ay
    tap = lambda y, x, w: F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), w.alias("w"))
    return F.array(
        tap(ay + 1, ax + 1, tx * ty), tap(ay, ax + 1, tx * (1 - ty)), tap(ay + 1, ax, (1 - tx) * ty), tap(ay, ax, (1 - tx) * (1 - ty))
    )


def forward(points: DataFrame, values: list[str], ny: int, nx: int) -> DataFrame:
    """(p, y, x, values...): bilinear scatter of each value to four pixels.

    A voxel counts only if its floor is at least 1 and below the last row and
    column, so what lands exactly on the last ones is lost.
    """
    inside = (F.floor("xp") > 0) & (F.floor("xp") < nx) & (F.floor("yp") > 0) & (F.floor("yp") < ny)
    rows = points.where(inside).select("p", F.explode(_taps()).alias("t"), *values)
    return rows.groupBy("p", F.col("t.y").alias("y"), F.col("t.x").alias("x")).agg(*(F.sum(F.col(v) * F.col("t.w")).alias(v) for v in values))


def forward_nearest(points: DataFrame, values: list[str], ny: int, nx: int) -> DataFrame:
    """The same with each voxel in its nearest pixel, the last row and column included."""
    # ties away from zero, as the images' own rounding
    rows = points.select("p", F.floor(F.col("yp") + 0.5).cast("int").alias("y"), F.floor(F.col("xp") + 0.5).cast("int").alias("x"), *values)
    rows = rows.where((F.col("x") > 0) & (F.col("x") <= nx) & (F.col("y") > 0) & (F.col("y") <= ny))
    return rows.groupBy("p", "y", "x").agg(*(F.sum(v).alias(v) for v in values))


def gather(points: DataFrame, images: DataFrame, keep: list[str], values: list[str], ny: int, nx: int, every: bool = False) -> DataFrame:
    """(keep..., p, values...): each point with what four pixels of its image give it, bilinear.

    ``points`` have slab, p, xp, yp and the columns ``keep``, of plain types;
    rows of a slab are handled by one task, without a shuffle if they are
    partitioned by it. Coordinates outside the image read pixel 1; on the last
    row or column the weight moves to the inner neighbour. Pixels that
    ``images`` lacks give nothing; a point that has none is left out, unless
    ``every`` keeps it with zeros.
    """

    def side(c: str, n: int) -> tuple[Column, Column]:
        v = F.when((F.col(c) < 1) | (F.col(c) > n), F.lit(1.0)).otherwise(F.col(c))
        low = F.when(v == n, F.lit(n - 1)).otherwise(F.floor(v))
        return low.cast("int"), v - low

    (lx, tx), (ly, ty) = side("xp", nx), side("yp", ny)
    rows = points.select("slab", *keep, "p", lx.alias("__lx"), tx.alias("__tx"), ly.alias("__ly"), ty.alias("__ty"))
    wanted = rows.select("slab", "p", F.explode(F.array(F.col("__ly"), F.col("__ly") + 1)).alias("y")).distinct()
    # names of their own: both sides may come from the same rows
    wanted = wanted.select(F.col("slab").alias("__slab"), F.col("p").alias("__p"), F.col("y").alias("__y"))
    sent = images.select(*(F.col(c).alias(f"__{c}") for c in ("p", "y", "x")), *(F.col(v).alias(f"__v{k}") for k, v in enumerate(values))).join(wanted, ["__p", "__y"])
    known = dict(points.dtypes)
    schema = ", ".join([*(f"`{c}` {known[c]}" for c in [*keep, "p"]), *(f"`{v}` double" for v in values)])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        place = lambda p, y, x: (p.astype(np.int64) * (ny + 2) + y) * (nx + 2) + x
        codes = place(*(column(right, c) for c in ("__p", "__y", "__x")))
        order = np.argsort(codes)
        codes = codes[order]
        pixels = np.stack([column(right, f"__v{k}") for k in range(len(values))], 1)[order] if len(codes) else np.zeros((1, len(values)))
        p, x, tx, y, ty = (column(left, c) for c in ("p", "__lx", "__tx", "__ly", "__ty"))
        out, met = np.zeros((len(p), len(values))), np.zeros(len(p), bool)
        for dy, dx, w in ((0, 0, (1 - tx) * (1 - ty)), (1, 0, (1 - tx) * ty), (0, 1, tx * (1 - ty)), (1, 1, tx * ty)):
            code = place(p, y + dy, x + dx)
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = codes[at] == code if len(codes) else np.zeros(len(p), bool)
            out += pixels[at] * np.where(hit, w, 0.0)[:, None]
            met |= hit
        found = pa.table([*(left.column(c) for c in [*keep, "p"]), *(pa.array(out[:, k]) for k in range(len(values)))], names=[*keep, "p", *values])
        return found if every else found.filter(pa.array(met))

    return rows.groupBy("slab").cogroup(sent.groupBy("__slab")).applyInArrow(fill, schema)


def back(points: DataFrame, images: DataFrame, key: list[str], values: list[str], ny: int, nx: int) -> DataFrame:
    """(key..., values...): ``gather`` summed over images, or for each of them if ``key`` holds p."""
    met = gather(points, images, [c for c in key if c != "p"], values, ny, nx)
    return met.groupBy(*key).agg(*(F.sum(v).alias(v) for v in values))


def stencil(df: DataFrame, axes: list[str], values: list[str], offsets: list[tuple], bounds: dict[str, tuple[int, int]], key: list[str] = ()) -> DataFrame:
    """Sum of shifted copies: each row adds ``weight * value`` at ``axes + offset``, inside ``bounds``.

    The offsets ride along as a literal array: one explode and one aggregation
    by the shifted index, no self join. What leaves the bounds is dropped, so
    outside counts as zero. Rows partitioned by a column of ``key`` aren't moved.
    """
    table = F.array(*(F.struct(*(F.lit(o).alias(f"o{i}") for i, o in enumerate(off[:-1])), F.lit(float(off[-1])).alias("w")) for off in offsets))
    rows = df.withColumn("__o", F.explode(table))
    shifted = [(F.col(a) + F.col(f"__o.o{i}")).alias(a) for i, a in enumerate(axes)]
    rows = rows.select(*key, *shifted, *((F.col(v) * F.col("__o.w")).alias(v) for v in values))
    for a, (low, high) in bounds.items():
        rows = rows.where(F.col(a).between(low, high))
    return rows.groupBy(*key, *axes).agg(*(F.sum(v).alias(v) for v in values))


#: Rows of the separable filters by size.
FILTERS = {1: (0.25, 1.0, 0.25), 2: (0.5, 1.0, 0.5), 3: (1 / 3, 2 / 3, 1.0, 2 / 3, 1 / 3)}


def filter_offsets(size: int) -> list[tuple[int, int, float]]:
    """(dy, dx, weight) of the outer product of a filter row with itself, of sum one."""
    row = FILTERS[size]
    half, total = len(row) // 2, sum(row) ** 2
    return [(i - half, j - half, a * b / total) for i, a in enumerate(row) for j, b in enumerate(row)]
