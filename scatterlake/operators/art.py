"""Row-action reconstruction of slices: Kaczmarz steps over rays, slices in parallel.

A slice is an independent problem, so the rays of each are brought together by
one shuffle and all sweeps run where they are, many slices at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.functions.images import _rays


@lru_cache(16)
def ray_matrix(n: int, degrees: tuple[float, ...]) -> np.ndarray:
    """(angles * n, n * n): the weight of each voxel of an n x n slice in each ray."""
    out = np.zeros((len(degrees) * n, n * n))
    voxel = np.arange(n * n)
    for a, angle in enumerate(degrees):
        low, w, met = _rays(n, angle)
        out[a * n + low, voxel] += (1 - w) * met
        out[a * n + low + 1, voxel] += w * met
    return out


def subset_order(angles: int) -> list[int]:
    """Angles so that neighbours in the order are far apart: steps of about the golden part of a turn."""
    step = max(1, round(angles * 0.381966))
    while np.gcd(step, angles) != 1:
        step += 1
    return [i * step % angles for i in range(angles)]


def sweep_slices(values: np.ndarray, matrix: np.ndarray, angles: int, sweeps: int, relaxation: float, non_negative: bool) -> tuple[np.ndarray, np.ndarray]:
    """(slices, voxels) and (slices, sweeps + 1) residual norms, from (slices, rays); NaN rays weren't measured.

    A step moves a slice by ``relaxation`` of its distance from the plane of
    one ray; rays go by subsets of one angle, and each subset is followed by
    the clamp at zero.
    """
    known = ~np.isnan(values)
    b = np.where(known, values, 0.0)
    x = np.zeros((len(b), matrix.shape[1]))
    norms = (matrix * matrix).sum(1)
    n = len(matrix) // angles
    residuals = [np.linalg.norm(b, axis=1)]
    for _ in range(sweeps):
        for a in subset_order(angles):
            for i in range(a * n, (a + 1) * n):
                if norms[i] > 0:
                    x += (relaxation / norms[i] * known[:, i] * (b[:, i] - x @ matrix[i]))[:, None] * matrix[i]
            if non_negative:
                np.maximum(x, 0, out=x)
        residuals.append(np.linalg.norm((b - x @ matrix.T) * known, axis=1))
    return x, np.stack(residuals, axis=1)


def packed_rays(rays: DataFrame) -> DataFrame:
    """(slice, k, value) as one row for each slice, in the order of k: the only shuffle."""
    rows = rays.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("r"))
    return rows.select("slice", F.transform("r", lambda x: x["k"]).alias("k"), F.transform("r", lambda x: x["value"]).alias("value"))


def reconstruct(rays: DataFrame, n: int, degrees: tuple[float, ...], sweeps: int = 10, relaxation: float = 0.5, non_negative: bool = True) -> DataFrame:
    """(slice, y, x, v, residual): slices of n x n voxels from rays (slice, k, value), k = angle * n + sample.

    ``residual`` is the norm of what the slice's rays leave unexplained over
    the norm of the rays, the same for all its voxels. Rays that are missing,
    null or NaN aren't used; of several with one k the last counts. A slice
    without rays is absent.
    """
    places = np.arange(n * n)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = ray_matrix(n, degrees)
        for b in batches:
            if not b.num_rows:
                continue
            values = np.full((b.num_rows, len(matrix)), np.nan)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            values[row, b.column(1).flatten().to_numpy()] = b.column(2).flatten().to_numpy(zero_copy_only=False)
            x, left = sweep_slices(values, matrix, len(degrees), sweeps, relaxation, non_negative)
            share = left[:, -1] / np.where(left[:, 0] > 0, left[:, 0], 1)
            m = n * n
            columns = [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), m))), np.tile(places // n, b.num_rows), np.tile(places % n, b.num_rows), x.ravel(), np.repeat(share, m)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if t else c for c, t in zip(columns, (None, pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["slice", "y", "x", "v", "residual"])

    return packed_rays(rays).mapInArrow(solve, "slice long, y int, x int, v double, residual double")
