import numpy as np
import pyarrow as pa

from scatterlake.functions import images as K
from scatterlake.operators import align as A
from scatterlake.operators.align import align

SIDE = 16


def _projections(shifts, angles):
    """Projections of three off-centre blobs, moved by known shifts."""
    z, y, x = np.mgrid[:SIDE, :SIDE, :SIDE] - (SIDE - 1) / 2
    blobs = [(-2.0, 1.5, 2.0, 1.8), (2.5, -2.0, 1.0, 1.5), (0.5, 0.0, -3.0, 2.0)]
    volume = sum(np.exp(-((z - a) ** 2 + (y - b) ** 2 + (x - c) ** 2) / (2 * w * w)) for a, b, c, w in blobs)
    return [K.moved(K.reproject(volume.reshape(SIDE, -1), d), *s) for d, s in zip(angles, shifts, strict=True)]


def test_spreading_is_adjoint_to_projecting():
    rng = np.random.default_rng(0)
    v, p = rng.random((3, SIDE * SIDE)), rng.random((3, SIDE))
    low, w, met = K._rays(SIDE, 33.0)
    spread = (p[:, low] * (1 - w) + p[:, low + 1] * w) * met
    assert np.isclose((K.reproject(v, 33.0) * p).sum(), (v * spread).sum())


def test_images_of_an_angle_are_worked_on_together(monkeypatch):
    """Stacks of one angle, of bounded size, and kernels that give for each image of a stack what they give for it alone."""
    rng = np.random.default_rng(3)
    images, degrees = rng.random((40, 4, 6)), np.arange(40) % 4 * 22.5
    moves = rng.uniform(-2, 2, (4, 40))
    names = ["id", "degrees", "f", "y", "x", "sy", "sx"]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40)), pa.array(degrees), pa.array([f.ravel().tolist() for f in images]), *map(pa.array, moves)], names)
    assert [(a, at.tolist()) for a, at, *_ in A._images(batch, 6)] == [(k * 22.5, list(range(k, 40, 4))) for k in range(4)]
    monkeypatch.setattr(A, "PIXELS", 24 * 3)
    stacks = list(A._images(batch.slice(2, 30), 6))
    assert sorted(i for _, at, *_ in stacks for i in at.tolist()) == list(range(30)) and max(len(at) for _, at, *_ in stacks) == 3
    model = rng.random((4, 6))
    for angle, at, stack, y, x, *_ in stacks:
        assert np.array_equal(stack, images[at + 2]) and (degrees[at + 2] == angle).all()
        found = K.high_pass(K.moved(stack, y, x))
        off = np.array(K.gradient_shift(model, found))
        for i, j in enumerate(at + 2):
            alone = K.high_pass(K.moved(images[j], moves[0, j], moves[1, j]))
            assert np.allclose(found[i], alone) and np.allclose(off[:, i], K.gradient_shift(model, alone))


def test_known_shifts_are_taken_back(spark):
    rng = np.random.default_rng(1)
    angles = np.arange(36) * 5.0
    shifts = np.stack([rng.uniform(-1.5, 1.5, 36), rng.uniform(-1.0, 1.0, 36)], 1)
    rows = [(i, float(d), f.ravel().tolist()) for i, (d, f) in enumerate(zip(angles, _projections(shifts, angles), strict=True))]
    found, steps = align(spark.createDataFrame(rows, "id long, degrees double, f array<double>"), SIDE, rounds=12)
    at = np.array([(r["y"], r["x"]) for r in found.orderBy("id").collect()])
    left = at + shifts
    left -= np.median(left, axis=0)
    # across the axis a move of the whole volume, a sine of the angle, can't be told
    turn = np.stack([np.cos(np.radians(angles)), np.sin(np.radians(angles)), np.ones(36)], 1)
    across = left[:, 1] - turn @ np.linalg.lstsq(turn, left[:, 1], rcond=None)[0]
    assert np.abs(left[:, 0]).max() < 0.15
    assert np.sqrt((across**2).mean()) < 0.5 * shifts[:, 1].std()
    assert steps[-1] < steps[0]


def test_incomplete_projections_take_no_part(spark):
    schema = "id long, degrees double, f array<double>"
    bad = [(1, None, [1.0] * 16), (2, 0.0, None), (3, 0.0, [None] + [1.0] * 15), (4, 0.0, [float("nan")] * 16)]
    found, steps = align(spark.createDataFrame(bad, schema), 4)
    assert found.count() == 0 and steps == []
    good = [(None, 0.0, [0.0] * 16), (5, 90.0, [2.0] * 16), (5, 90.0, [2.0] * 16)]
    found, steps = align(spark.createDataFrame(bad + good, schema), 4, rounds=2)
    assert sorted(str(r["id"]) for r in found.collect()) == ["5", "5", "None"] and max(steps) < 1e-9
