"""Reciprocal-space models: even spherical harmonics and the exponential model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Y_l0 as coefficients of cos^0, cos^2, cos^4, cos^6.
YLM = {
    0: (math.sqrt(1 / math.pi) / 2,),
    2: tuple(math.sqrt(5 / math.pi) * c for c in (-1 / 4, 3 / 4)),
    4: tuple(math.sqrt(1 / math.pi) * c for c in (9 / 16, -45 / 8, 105 / 16)),
    6: tuple(math.sqrt(13 / math.pi) * c for c in (-5 / 32, 105 / 32, -315 / 32, 231 / 32)),
}
SIMPSON = 500


def harmonic(order: int, cosine: Column) -> Column:
    """Y_l0 at the cosine, by Horner's rule in its square."""
    square, out = cosine * cosine, F.lit(YLM[order][-1])
    for c in YLM[order][-2::-1]:
        out = out * square + F.lit(c)
    return out


def harmonic_slope(order: int, cosine: Column) -> Column:
    """dY_l0/dcos: a polynomial, so nothing is divided by the sine at the pole."""
    out = F.lit(0.0)
    for k in range(len(YLM[order]) - 1, 0, -1):
        out = out * cosine * cosine + F.lit(2 * k * YLM[order][k])
    return out * cosine


def amplitude(cosine: Column, orders=(0, 2, 4, 6)) -> Column:
    """Sum of a_l * Y_l0."""
    terms = [F.col(f"a{n}") * harmonic(n, cosine) for n in orders]
    return sum(terms[1:], terms[0])


def cosine_to(qx="qx", qy="qy", qz="qz") -> Column:
    return F.col("ux") * F.col(qx) + F.col("uy") * F.col(qy) + F.col("uz") * F.col(qz)


def simpson(f, intervals: int = SIMPSON, top: float = math.pi) -> Column:
    """Composite Simpson's rule of ``f`` over [0, top], an even number of intervals."""
    h = top / intervals
    weight = lambda i: F.when((i == 0) | (i == intervals), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(intervals)), F.lit(0.0), lambda acc, i: acc + weight(i) * f(i * F.lit(h))) * F.lit(h / 3)


def exponential(cosine: Column, a: str = "A", b: str = "B", sign: int = 1) -> Column:
    """A^2 exp(-s |B| sin^2) over its integral on the sphere."""
    decay = F.abs(F.col(b)) * float(sign)
    norm = simpson(lambda x: F.sin(x) * F.exp(-decay * F.sin(x) * F.sin(x))) * (2 * math.pi)
    return F.col(a) * F.col(a) * F.exp(-decay * (1 - cosine * cosine)) / norm


def nematic_order(weight) -> Column:
    """(3 <cos^2> - 1) / 2 over the sphere, weighted by ``weight(x)``."""
    whole = simpson(lambda x: F.sin(x) * weight(x))
    square = simpson(lambda x: F.sin(x) * F.cos(x) * F.cos(x) * weight(x))
    return (F.lit(3.0) * square / whole - 1) / 2


def _moments(power: int, orders=(0, 2, 4, 6), intervals: int = SIMPSON) -> list[list[float]]:
    """Simpson's rule of sin * cos^power * Y_l * Y_m over [0, pi], for each pair of orders."""
    h = math.pi / intervals
    nodes = [(k * h, (1.0 if k in (0, intervals) else 4.0 if k % 2 else 2.0) * h / 3) for k in range(intervals + 1)]
    y = {n: [sum(c * math.cos(t) ** (2 * i) for i, c in enumerate(YLM[n])) for t, _ in nodes] for n in orders}
    base = [w * math.sin(t) * math.cos(t) ** power for t, w in nodes]
    return [[sum(b * u * v for b, u, v in zip(base, y[n], y[m], strict=True)) for m in orders] for n in orders]


def harmonic_order(orders=(0, 2, 4, 6)) -> Column:
    """``nematic_order`` of the harmonic model's squared amplitude.

    The integrals are quadratic forms of the coefficients, whose matrices are
    the same for every voxel: ten products take the place of 501 nodes.
    """

    def form(power: int) -> Column:
        m = _moments(power, orders)
        terms = [F.col(f"a{n}") * F.col(f"a{k}") * F.lit(m[i][j] * (1 if i == j else 2)) for i, n in enumerate(orders) for j, k in enumerate(orders) if i <= j]
        return sum(terms[1:], terms[0])

    return (F.lit(3.0) * form(2) / form(0) - 1) / 2
