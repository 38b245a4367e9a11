"""Queries of Fourier transforms and propagation over one image as tall as the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scatterlake.operators import fourier
from scatterlake.plans.registry import query
from scatterlake.session import table

WIDTH = 64
# lengths in units of a pixel
WAVELENGTH, DISTANCE = 0.25, 200.0

#: The tables' ids as rows, padded to a power of two.
FIELD_SQL = """size AS (SELECT CAST(pow(2, floor(log2(max(vec_id))) + 1) AS BIGINT) AS n FROM embeddings),
f0 AS (SELECT vec_id AS r, CAST(k AS BIGINT) AS c, CAST(v AS DOUBLE) AS re, 0e0 AS im FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings))"""


def _dft(name: str, of: str, axis: str, back: bool = False) -> str:
    """One axis transformed by the definition."""
    other, n = ("c", "n") if axis == "r" else ("r", str(WIDTH))
    s, scale = ("-1", f"/ {n}") if back else ("1", "")
    phases = f"t_{name} AS MATERIALIZED (SELECT i.x AS {axis}, k.x AS k, cos(2 * pi() * (i.x * k.x % {n}) / {n}) AS p, {s} * sin(2 * pi() * (i.x * k.x % {n}) / {n}) AS q FROM size, range({n}) i(x), range({n}) k(x))"
    n_in = "any_value(n)" if axis == "r" else n
    total = scale.replace(n, n_in) if scale else ""
    return f"""{phases},
{name} AS (SELECT {other}, k AS {axis}, sum(re * p + im * q) {total} AS re, sum(im * p - re * q) {total} AS im FROM {of} JOIN t_{name} USING ({axis}), size GROUP BY {other}, k)"""


_FREQUENCY = f"pow((CASE WHEN 2 * r < n THEN r ELSE r - n END) / n * {WAVELENGTH}e0, 2) + pow((CASE WHEN 2 * c < {WIDTH} THEN c ELSE c - {WIDTH} END) / {WIDTH} * {WAVELENGTH}e0, 2)"
_ROUNDED = "r AS row, CAST(c AS BIGINT) AS col, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im"


def _field(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("re"))


def _cells(df):
    cells = df.select("row", F.posexplode(F.arrays_zip("re", "im")).alias("col", "z"))
    rounded = lambda part: F.round(part, 6) + F.lit(0.0)
    return cells.select("row", F.col("col").cast("long").alias("col"), rounded("z.re").alias("re"), rounded("z.im").alias("im"))


@query("spectrum_2d", f"WITH {FIELD_SQL}, {_dft('f1', 'f0', 'c')}, {_dft('f2', 'f1', 'r')} SELECT {_ROUNDED} FROM f2")
def spectrum_2d(spark, sf_dir):
    """The spectrum of all vectors as one image."""
    return _cells(fourier.spectrum(_field(spark, sf_dir), WIDTH))


@query("propagate", f"""WITH {FIELD_SQL}, {_dft('f1', 'f0', 'c')}, {_dft('f2', 'f1', 'r')},
turn AS (SELECT r, c, re, im, 2 * pi() * {DISTANCE}e0 / {WAVELENGTH}e0 * (sqrt(1 - ({_FREQUENCY})) - 1) AS a FROM f2, size),
f3 AS (SELECT r, c, re * cos(a) - im * sin(a) AS re, re * sin(a) + im * cos(a) AS im FROM turn), {_dft('f4', 'f3', 'r', True)}, {_dft('f5', 'f4', 'c', True)} SELECT {_ROUNDED} FROM f5""")
def propagate(spark, sf_dir):
    """All vectors as one wave, propagated."""
    return _cells(fourier.propagate(_field(spark, sf_dir), WIDTH, WAVELENGTH, DISTANCE))
