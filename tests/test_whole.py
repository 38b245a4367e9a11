"""Queries over all frames, whatever their ids, against plain numpy."""

import duckdb
import numpy as np
import pytest

import scatterlake.plans as plans
from scatterlake.functions import images as K
from tests.oracle import compare

IDS = [0, 3, 45, 250, 5000]


def write(spark, path, images):
    rows = [(i, (images[i].ravel() / 1000 + 0.0005).tolist(), 0) for i in images]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    return {i: rng.integers(0, 400, (8, 8)).astype(float) for i in IDS}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, images):
    return write(spark, tmp_path_factory.mktemp("whole"), images)


def run(spark, name, sf):
    return plans.queries()[name](spark, sf).collect()


def test_masks_read_every_frame(spark, tmp_path):
    made = {i: np.full((8, 8), 200.0) for i in IDS}
    made[250][2, 3] = 500  # hot there only
    for i in IDS:
        made[i][4, 5] = made[i][6, 6] = 100
    made[5000][4, 5] = 200  # lit there only
    sf = write(spark, tmp_path, made)
    want = {(r, c) for r in range(8) for c in range(8)} - {(2, 3), (6, 6)}
    assert {(r["row"], r["col"]) for r in run(spark, "valid_mask", sf)} == want


def test_gauss_blur_of_every_frame(spark, sf, images):
    w = np.exp(-((np.arange(-3, 4) / 1.5) ** 2))
    k = np.zeros((8, 8))
    for o, x in zip(range(-3, 4), w / w.sum(), strict=True):
        k += x * np.eye(8, k=o)
    got = {(r["vec_id"], r["row"], r["col"]): r["v"] for r in run(spark, "gauss_blur", sf)}
    want = {(i, r, c): (k @ images[i] @ k.T)[r, c] for i in IDS for r in range(8) for c in range(8)}
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x], abs=2e-5) for x in want)


def test_back_projection_and_transform_of_every_frame(spark, sf, images):
    got = {(r["vec_id"], r["y"], r["x"]): r["v"] for r in run(spark, "fbp", sf)}
    out = {i: K.filtered_back_projection(images[i], np.arange(8) * 22.5, "hann") for i in IDS}
    assert got == {(i, y, x): pytest.approx(out[i][y, x]) for i in IDS for y in range(8) for x in range(8)}
    got = {(r["vec_id"], r["y"], r["x"]): complex(r["re"], r["im"]) for r in run(spark, "fft_blocks", sf)}
    out = {i: np.fft.fftshift(np.fft.fft2(images[i])) for i in IDS}
    assert got == {(i, y, x): pytest.approx(out[i][y, x], abs=1e-6) for i in IDS for y in range(8) for x in range(8)}


def test_unbin_of_every_frame(spark, sf, images):
    got = {(r["vec_id"], r["row"], r["col"]): r["counts"] for r in run(spark, "unbin", sf)}
    assert got == {(i, r, c): images[i][r // 2, c // 2] for i in IDS for r in range(16) for c in range(16)}


def test_bright_parts_of_every_frame(spark, sf, images):
    want = []
    for i in IDS:
        left, parts = {(r, c) for r in range(8) for c in range(8) if images[i][r, c] > 60}, []
        while left:
            todo, part = [min(left)], set()
            while todo:
                r, c = todo.pop()
                if (r, c) in left:
                    left.remove((r, c))
                    part.add(r * 8 + c)
                    todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
            parts.append((-len(part), min(part)))
        want += [(i, least, -size) for size, least in sorted(parts)[:2]]
    assert sorted((r["vec_id"], r["part"], r["size"]) for r in run(spark, "bright_parts", sf)) == sorted(want)


def test_median_and_padding_of_every_frame(spark, sf, images):
    cells = [(i, r, c) for i in IDS for r in range(8) for c in range(8)]
    edge = {i: np.pad(images[i], 1, "edge") for i in IDS}
    got = {(r["vec_id"], r["row"], r["col"]): r["v"] for r in run(spark, "diode_filter", sf)}
    assert got == {(i, r, c): np.median(edge[i][r : r + 3, c : c + 3]) for i, r, c in cells}
    wide = {i: np.pad(images[i], ((0, 1), (0, 2)), constant_values=1) for i in IDS}
    got = {(r["vec_id"], r["row"], r["col"]): r["v"] for r in run(spark, "pad", sf)}
    assert got == {(i, r, c): wide[i][r, c] for i in IDS for r in range(9) for c in range(10)}


@pytest.mark.parametrize("name", ["upsample", "sieve_blur", "mask3d"])
def test_stencils_of_the_volume_move_vectors_only(spark, tmp_path, name):
    """Slabs of 64 slices bring their neighbours along: one exchange, by slab, in as many parts as the volume needs."""
    rng = np.random.default_rng(5)
    ids = [0, 1, *range(60, 70), *range(126, 131), 192, 400]
    write(spark, tmp_path, {i: rng.integers(0, 900, (8, 8)).astype(float) for i in ids})
    found = plans.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(slab") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    compare(found, con, plans.oracle_sql()[name])
