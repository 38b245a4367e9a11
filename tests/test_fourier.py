"""Transforms across tasks against numpy's, propagation there and back, energy, holes and refused rows."""

import numpy as np
import pytest

from scatterlake.operators.fourier import _factors, image_height, propagate, spectrum


def _image(spark, z):
    return spark.createDataFrame([(i, r.real.tolist(), r.imag.tolist(), "x") for i, r in enumerate(z)], "row long, re array<double>, im array<double>, k string").repartition(3)


def _array(df, height):
    rows = {r.row: np.array(r.re) + 1j * np.array(r.im) for r in df.collect()}
    assert sorted(rows) == list(range(height))
    return np.array([rows[i] for i in range(height)])


def _random(n, width):
    rng = np.random.default_rng(n)
    return rng.normal(size=(n, width)) + 1j * rng.normal(size=(n, width))


@pytest.mark.parametrize("n,width", [(1, 3), (7, 4), (12, 5), (64, 6), (96, 1)])
def test_spectrum_equals_the_local_transform(spark, n, width):
    z = _random(n, width)
    assert np.allclose(_array(spectrum(_image(spark, z), width, n), n), np.fft.fft2(z))


def test_groups_have_about_the_root_of_the_rows():
    assert _factors(1 << 20) == (1024, 1024) and _factors(1 << 21) == (1024, 2048) and _factors(13) == (1, 13)


def test_propagation_keeps_energy_and_comes_back(spark):
    z = _random(32, 8)
    there = propagate(_image(spark, z), 8, 0.5, 90.0, (1.0, 2.0))
    moved = _array(there, 32)
    f, g = np.meshgrid(np.fft.fftfreq(32) * 0.5, np.fft.fftfreq(8) * 0.25, indexing="ij")
    assert np.allclose(moved, np.fft.ifft2(np.fft.fft2(z) * np.exp(2j * np.pi * 180 * (np.sqrt(1 - f**2 - g**2) - 1))))
    assert np.isclose((abs(moved) ** 2).sum(), (abs(z) ** 2).sum())
    assert np.allclose(_array(propagate(there, 8, 0.5, -90.0, (1.0, 2.0)), 32), z)


def test_what_does_not_travel_decays_both_ways(spark):
    z = _random(8, 8)
    for distance in (3.0, -3.0):
        assert (abs(_array(propagate(_image(spark, z), 8, 4.0, distance), 8)) ** 2).sum() < (abs(z) ** 2).sum()


def test_holes_repeats_and_refused_rows(spark):
    schema = "row long, re array<double>"
    rows = [(0, [1.0, 2.0]), (0, [1.0, None]), (5, None), (None, [9.0, 9.0])]
    image = spark.createDataFrame(rows, schema)
    z = np.zeros((8, 2))
    z[0] = 2, 2
    assert image_height(image) == 8
    assert np.allclose(_array(spectrum(image, 2), 8), np.fft.fft2(z))
    assert spectrum(spark.createDataFrame([], schema), 2).collect() == []
    for bad, height in (([(0, [1.0])], 4), ([(4, [1.0, 1.0])], 4)):
        with pytest.raises(Exception, match="is not one of"):
            spectrum(spark.createDataFrame(bad, schema), 2, height).collect()
    with pytest.raises(ValueError, match="start at 0"):
        spectrum(spark.createDataFrame([(-1, [1.0, 1.0])], schema), 2)
