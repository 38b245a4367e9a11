import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterlake.functions import images as K
from scatterlake.operators import art
from scatterlake.operators import svd as V
from scatterlake.operators.cache import cached
from scatterlake.operators.linesearch import minimise
from scatterlake.operators.ranks import ranked
from scatterlake.streaming.sink import MarkedTable

DEGREES = tuple(22.5 * k for k in range(8))


def plain_kaczmarz(b, matrix, angles, sweeps, relaxation):
    x, n = np.zeros(matrix.shape[1]), len(matrix) // angles
    for _ in range(sweeps):
        for a in art.subset_order(angles):
            for i in range(a * n, (a + 1) * n):
                size = matrix[i] @ matrix[i]
                if size > 0 and not np.isnan(b[i]):
                    x = x + relaxation * (b[i] - matrix[i] @ x) / size * matrix[i]
            x = np.maximum(x, 0)
    return x


def test_slices_by_row_actions_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    matrix = art.ray_matrix(8, DEGREES)
    truth = rng.random((5, 64)) * (rng.random((5, 64)) < 0.5)
    rays = truth @ matrix.T
    rows = [(s, k, float(v)) for s, r in enumerate(rays) for k, v in enumerate(r) if (s, k) not in {(1, 7), (2, 30)}] + [(2, 30, None), (9, 3, 1.0)]
    df = spark.createDataFrame(rows, "slice long, k int, value double").repartition(4)
    got = art.reconstruct(df, 8, DEGREES, sweeps=6, relaxation=0.7).collect()
    rays[1, 7] = rays[2, 30] = np.nan
    for s in range(5):
        x = np.zeros(64)
        for r in got:
            if r["slice"] == s:
                x[r["y"] * 8 + r["x"]] = r["v"]
        assert np.allclose(x, plain_kaczmarz(rays[s], matrix, 8, 6, 0.7), atol=1e-9)
    assert len(got) == 6 * 64
    assert art.reconstruct(df.limit(0), 8, DEGREES).count() == 0


def test_residuals_fall_and_the_truth_is_approached():
    rng = np.random.default_rng(5)
    matrix = art.ray_matrix(8, DEGREES)
    truth = rng.random((4, 64))
    x, left = art.sweep_slices(truth @ matrix.T, matrix, 8, 60, 0.8, True)
    assert (np.diff(left, axis=1) <= 1e-9).all() and (left[:, -1] < 0.02 * left[:, 0]).all()
    assert np.abs((x - truth) @ matrix.T).max() < 0.2


def test_projection_pair_is_adjoint():
    rng = np.random.default_rng(6)
    matrix = art.ray_matrix(8, DEGREES)
    for a, angle in enumerate(DEGREES):
        v = rng.random((1, 64))
        assert np.allclose(K.reproject(v, angle)[0], matrix[a * 8 : a * 8 + 8] @ v[0])


def scalar_brent(f, a, b, c, tolerance=1e-8):
    """Least value in (a, c) by parabolic and golden steps, one trial at a time; (x, value, trials)."""
    x = w = v = b
    fx = fw = fv = f(b)
    d = e = 0.0
    for trials in range(1, 200):
        m, tol = (a + c) / 2, tolerance * abs(x) + 1e-12
        if abs(x - m) <= 2 * tol - (c - a) / 2:
            break
        p = q = 0.0
        if abs(e) > tol:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
        if q and abs(p) < abs(q * e / 2) and q * (a - x) < p < q * (c - x):
            e, d = d, p / q
        else:
            e = c - x if x < m else a - x
            d = 0.381966 * e
        u = x + (d if abs(d) >= tol else np.copysign(tol, d))
        fu = f(u)
        if fu <= fx:
            a, c = (x, c) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, c = (u, c) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx, trials


@pytest.mark.parametrize("seed", range(20))
def test_batched_search_finds_the_minimum_of_a_scalar_search(seed):
    rng = np.random.default_rng(seed)
    low, power, tilt = 10 ** rng.uniform(-3, 3), rng.uniform(1.5, 3), rng.uniform(0.1, 2)
    f = lambda s: abs(s / low - 1) ** power + tilt * np.log1p((s / low - 1) ** 2)
    jobs = []

    def score(steps):
        jobs.append(len(steps))
        return [f(s) for s in steps]

    step, value, used = minimise(score, low * 10 ** rng.uniform(-1.5, 1.5), f(0.0), 40, 1e-5)
    want, least, trials = scalar_brent(f, 0.0, low * 0.7, low * 3)
    assert value <= least + 1e-8 and step == pytest.approx(want, rel=1e-3)
    assert used == len(jobs) and used <= max(6, trials / 2 + 3)


def test_search_stays_where_nothing_is_lower():
    assert minimise(lambda steps: [1 + s for s in steps], 0.5, 1.0, 12)[:2] == (0.0, 1.0)


def test_singular_values(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 24)) @ np.diag(0.7 ** np.arange(24))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(40)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    for values, modes in (V.svd(df, 6), V.krylov_svd(df, 6, 24, steps=4)):
        assert np.allclose(values, s[:6], rtol=1e-6)
        assert np.allclose(np.abs((modes * vt[:6]).sum(1)), 1, atol=1e-6)
        assert (np.take_along_axis(modes, np.abs(modes).argmax(1)[:, None], 1) > 0).all()
    assert V.svd(df.limit(0), 3)[0].size == 0


def test_results_are_kept_until_something_changes(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    calls = []

    def run(limit):
        source = spark.read.parquet(f"{tmp_path}/in")

        def compute(rows):
            calls.append(limit)
            return rows.where(F.col("id") < limit)

        df, hit = cached(f"{tmp_path}/kept", source, {"limit": limit}, compute)
        return df.count(), hit

    assert [run(4), run(4), run(6), run(4)] == [(4, False), (4, True), (6, False), (4, True)]
    spark.range(10, 12).selectExpr("id - 9 AS id").write.mode("append").parquet(f"{tmp_path}/in")
    assert run(4) == (6, False) and calls == [4, 6, 4]


def test_a_replayed_batch_leaves_no_double_and_an_unmarked_one_is_not_seen(spark, tmp_path):
    sink = MarkedTable(spark, f"file://{tmp_path}/table")
    rows = spark.range(5)
    sink.write(rows, 0)
    mark = sink.mark
    sink.mark = lambda batch: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        sink.write(spark.range(5, 8), 1)  # data written, not marked
    assert sink.read(rows.schema).count() == 5
    sink.mark = mark
    sink.write(spark.range(5, 8), 1)  # replayed after the crash
    sink.write(spark.range(5, 8), 1)  # and again
    assert sorted(r["id"] for r in sink.read(rows.schema).collect()) == list(range(8))
    assert sink.batches() == [0, 1] and sink.read(rows.schema, since=0).count() == 3
    assert MarkedTable(spark, f"file://{tmp_path}/none").read(rows.schema).count() == 0


def test_marked_batches_of_a_stream(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.json").write_text(json.dumps({"a": n}))
    sink = MarkedTable(spark, f"file://{tmp_path}/table")
    stream = spark.readStream.schema("a long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/*.json")
    stream.writeStream.foreachBatch(lambda df, n: sink.write(df, n)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sink.batches() == [0, 1, 2]
    assert sorted(r["a"] for r in sink.read(stream.schema).collect()) == [0, 1, 2]


def test_ranks_in_groups_cut_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.1), int(rng.integers(0, 50)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(5)
    got = {r["i"]: (r["p"], r["n"]) for r in ranked(df, "g", [F.desc("v"), F.asc("i")]).collect()}
    for g in (0, 1):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == [(p, len(own)) for p in range(1, len(own) + 1)]


def test_integration_undoes_differences():
    image = np.random.default_rng(1).normal(size=(7, 11))
    assert np.allclose(K.integrated(np.diff(image, axis=1), np.diff(image, axis=0)), image - image.mean())
