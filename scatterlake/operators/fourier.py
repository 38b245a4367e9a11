"""Fourier transforms and near-field propagation of images of any height, no task holding more than about the root of it.

A column of n = a * b entries is transformed in two steps, over a entries that
lie b apart and, after a turn by phases, over b. Rows move by their remainder in
one shuffle and by frequency in the next; a group has a or b rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE = "k long, row long, z array<double>"


def _factors(n: int) -> tuple[int, int]:
    """(a, b) with a * b = n, as near to each other as they come."""
    a = int(n**0.5)
    while n % a:
        a -= 1
    return a, n // a


def image_height(image: DataFrame) -> int:
    """The least power of two above every row number; rows below 0 raise."""
    low, high = image.agg(F.min("row"), F.max("row")).first()
    if low is not None and low < 0:
        raise ValueError("row numbers start at 0")
    return 1 if high is None else 1 << int(high).bit_length()


def _prepared(image: DataFrame, width: int, height: int) -> DataFrame:
    """(row, z): real and imaginary parts in turn; nulls are 0."""
    none = F.array_repeat(F.lit(0.0), width)
    zero = lambda name: F.transform(F.coalesce(F.col(name), none), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    imaginary = zero("im") if "im" in image.columns else none
    rows = image.where(F.col("row").isNotNull()).select(F.col("row").cast("long").alias("row"), zero("re").alias("re"), imaginary.alias("im"))
    right = (F.size("re") == width) & (F.size("im") == width) & (F.col("row") >= 0) & (F.col("row") < height)
    checked = F.when(right, F.col("re")).otherwise(F.raise_error(F.format_string("row %d is not one of %d rows of %d pixels", "row", F.lit(height), F.lit(width))))
    return rows.select("row", F.flatten(F.zip_with(checked, "im", lambda a, b: F.array(a, b))).alias("z"))


def _filled(table: pa.Table, places: np.ndarray, n: int, width: int) -> np.ndarray:
    """n x width numbers with the table's rows at their places; those that share one add up."""
    z = table.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * width).view(np.complex128)
    block = np.zeros((n, width), np.complex128)
    np.add.at(block, places, z)
    return block


def _pieces(k: np.ndarray, row: np.ndarray, z: np.ndarray) -> pa.Table:
    flat = np.ascontiguousarray(z).view(np.float64)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.table({"k": pa.array(k, pa.int64()), "row": pa.array(row, pa.int64()), "z": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))})


def _half_way(image: DataFrame, width: int, height: int) -> DataFrame:
    """(k, row, z): rows transformed, and columns over entries ``b`` apart, turned; ``row`` is the remainder."""
    a, b = _factors(height)

    def step(table: pa.Table) -> pa.Table:
        rows = table.column("row").to_numpy()
        rest = int(rows[0] % b)
        k = np.arange(a)
        z = np.fft.fft2(_filled(table, rows // b, a, width)) * np.exp(-2j * np.pi * rest * k / height)[:, None]
        return _pieces(k, np.full(a, rest), z)

    return _prepared(image, width, height).groupBy(F.col("row") % b).applyInArrow(step, _PIECE)


def _parts(df: DataFrame) -> DataFrame:
    part = lambda odd: F.filter("z", lambda _, i: i % 2 == odd)
    return df.select("row", part(0).alias("re"), part(1).alias("im"))


def spectrum(image: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """(row, re, im) of the 2-D transform of ``image`` (row, re[, im]: ``width`` values each); frequencies in the usual order from 0.

    ``height`` is the number of rows, by default the next power of two. Missing
    rows, null values and null arrays count as 0, rows without number are left
    out, repeated ones add up; other widths and rows beyond raise. An image
    without rows has no spectrum. Two shuffles; a task holds about
    16 x width x root(height) bytes, more where height has no factor near its root.
    """
    height = height or image_height(image)
    a, b = _factors(height)

    def step(table: pa.Table) -> pa.Table:
        k = int(table.column("k")[0].as_py())
        rows = k + a * np.arange(b)
        return _pieces(rows, rows, np.fft.fft(_filled(table, table.column("row").to_numpy(), b, width), axis=0))

    return _parts(_half_way(image, width, height).groupBy("k").applyInArrow(step, _PIECE))


def propagate(image: DataFrame, width: int, wavelength: float, distance: float, pixel: tuple[float, float] = (1.0, 1.0), height: int | None = None) -> DataFrame:
    """(row, re, im): the wave ``image`` after ``distance``, by its angular spectrum, periodic at the edges.

    Lengths have one unit; ``pixel`` is the size along rows' numbers and along
    a row. Frequencies that don't travel decay. Cases as in ``spectrum``; all
    ``height`` rows come out. Three shuffles, as going back starts in the groups
    where the spectrum is complete.
    """
    height = height or image_height(image)
    a, b = _factors(height)
    across = np.fft.fftfreq(width) * wavelength / pixel[1]

    def there_and_back(table: pa.Table) -> pa.Table:
        k = int(table.column("k")[0].as_py())
        rows = k + a * np.arange(b)
        down = np.where(2 * rows < height, rows, rows - height) / height * wavelength / pixel[0]
        slope = (down**2)[:, None] + across**2
        turn = np.exp(2j * np.pi * abs(distance) / wavelength * (np.sqrt(1 - slope + 0j) - 1))
        z = np.fft.fft(_filled(table, table.column("row").to_numpy(), b, width), axis=0) * (turn if distance >= 0 else turn.conj())
        rest = np.arange(b)
        return _pieces(np.full(b, k), rest, np.fft.ifft(z, axis=0) * np.exp(2j * np.pi * k * rest / height)[:, None])

    def finish(table: pa.Table) -> pa.Table:
        rest = int(table.column("row")[0].as_py())
        rows = np.arange(a) * b + rest
        return _pieces(rows, rows, np.fft.ifft2(_filled(table, table.column("k").to_numpy(), a, width)))

    turned = _half_way(image, width, height).groupBy("k").applyInArrow(there_and_back, _PIECE)
    return _parts(turned.groupBy("row").applyInArrow(finish, _PIECE))
