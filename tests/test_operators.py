import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterlake.functions import images as K
from scatterlake.operators import model as M
from scatterlake.operators import optimize as O
from scatterlake.operators import pattern
from scatterlake.operators import project as P
from scatterlake.session import stage
from scatterlake.sources import generate, spec

N, NP = 4, 2


@pytest.fixture(scope="module")
def problem(spark):
    grid = generate.voxels(spark, N)
    p = generate.projections(spark, NP)
    made = O.Problem.of(grid, p, generate.segments(spark), grid, N, NP, generate.SEGMENTS)
    truth = grid.select(*O.KEY, *O.PARAMETERS)
    made.images = stage(O.simulate(made, truth), "measured")
    return made, truth


def test_error_is_zero_at_the_generating_model(problem):
    made, truth = problem
    assert O.error(made, truth) == pytest.approx(0, abs=1e-20)


@pytest.mark.parametrize("name", ["a0", "a2", "theta", "phi"])
def test_gradient_is_the_central_difference(problem, name):
    made, truth = problem
    start = truth.select(*O.KEY, *((F.col(c) * 0.9).alias(c) for c in O.COEFFICIENTS), (F.col("theta") + 0.2).alias("theta"), "phi")
    place = (F.col("iy") == 2) & (F.col("ix") == 2) & (F.col("iz") == 3)
    exact = O.gradients(made, start, [name]).where(place).first()[f"g_{name}"]
    h = 1e-4
    up, down = (O.error(made, start.withColumn(name, F.col(name) + F.when(place, s * h).otherwise(0.0))) for s in (1, -1))
    assert exact == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-9)


def test_conjugate_gradient_lowers_the_error(problem):
    made, truth = problem
    start = stage(truth.withColumn("a0", F.col("a0") * 0.7), "start")
    _, errors = O.conjugate_gradient(made, start, ["a0"], 2)
    assert len(errors) == 3 and errors[0] > errors[1] >= errors[2]


def test_iterations_keep_no_tables_but_models(spark, problem):
    from scatterlake.session import work_path

    made, truth = problem
    start = stage(truth.withColumn("a0", F.col("a0") * 0.7), "start")
    root = pathlib.Path(work_path(spark, "any").removeprefix("file:")).parent
    kept = lambda: {p.name for kind in ("direction-*", "gradient-*") for p in root.glob(kind)}
    assert list(root.glob("start-*"))
    before = kept()
    _, errors = O.conjugate_gradient(made, start, ["a0"], 2, search=1)
    assert len(errors) == 3 and kept() == before


def test_frames_are_turned_to_rows_piece_by_piece():
    import pyarrow as pa

    from scatterlake.plans import iterate

    n = 3 * iterate.PIECE + 5
    whole = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([[float(i)] * 64 for i in range(n)])], ["vec_id", "f"])
    got = list(iterate._kernel_rows([whole], lambda i, f: [(i, k, float(f[0, 0])) for k in range(64)], ["vec_id", "k", "v"]))
    assert max(b.num_rows for b in got) == iterate.PIECE * 64
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(i, k, float(i)) for i in range(n) for k in range(64)]


def test_path_length_of_a_cube_of_ones(spark):
    n = 5
    grid = generate.voxels(spark, n).withColumn("one", F.lit(1.0))
    points = P.hit_points(grid, generate.projections(spark, 1), n, n, n)
    got = {(r["y"], r["x"]): r["one"] for r in P.forward(points, ["one"], n, n).collect()}
    assert all(got[y, x] == n for y in range(1, n) for x in range(1, n))
    assert all(got[y, x] == 0 for y, x in got if n in (y, x))  # the last row and column get nothing
    near = {(r["y"], r["x"]): r["one"] for r in P.forward_nearest(points, ["one"], n, n).collect()}
    assert len(near) == n * n and set(near.values()) == {float(n)}


def test_gather_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    ny, nx = 9, 5
    image = {(p, y, x): (float(rng.random()), float(rng.random())) for p in (0, 1) for y in range(1, ny + 1) for x in range(1, nx + 1) if rng.random() < 0.7}
    places = [(1.0, 1.0), (5.0, 9.0), (0.5, 4.25), (6.0, 3.0), (2.5, 9.5), (3.0, 2.0), *((float(a), float(b)) for a, b in rng.random((200, 2)) * (6, 11))]
    points = [(i // 10, i, i % 2, x, y) for i, (x, y) in enumerate(places)]

    def low(v, n):
        v = 1.0 if v < 1 or v > n else v
        a = n - 1 if v == n else math.floor(v)
        return a, v - a

    want = {}
    for _, i, p, x, y in points:
        (lx, tx), (ly, ty) = low(x, nx), low(y, ny)
        taps = [(ly + b, lx + a, (tx if a else 1 - tx) * (ty if b else 1 - ty)) for a in (0, 1) for b in (0, 1)]
        met = [(image[p, r, c], w) for r, c, w in taps if (p, r, c) in image]
        if met:
            want[i] = [sum(v[k] * w for v, w in met) for k in (0, 1)]
    rows = spark.createDataFrame(points, "slab int, id int, p int, xp double, yp double").repartition(3, "slab")
    images = spark.createDataFrame([(*k, *v) for k, v in image.items()], "p int, y int, x int, s0 double, s1 double")
    for every in (False, True):
        got = {r["id"]: [r["s0"], r["s1"]] for r in P.gather(rows, images, ["id"], ["s0", "s1"], ny, nx, every).collect()}
        assert set(got) == (set(range(len(places))) if every else set(want))
        assert all(v == pytest.approx(want.get(i, [0, 0])) for i, v in got.items())


def test_harmonics_are_normalised(spark):
    rows = spark.range(1)
    for order in (0, 2, 4, 6):
        assert rows.select(_norm(order)).first()[0] == pytest.approx(1, abs=1e-6)


def test_a_peak_fit_survives_parameters_without_a_say():
    """Two profiles of the given vectors whose normal equations become singular."""
    x = np.arange(1.0, 9.0)
    for y in (
        [12.864618438162974, 11.513746680226177, 12.074236407876015, 8.573947194032371, 15.004073978867382, 6.558451903717859, 9.685669215628877, 12.45984404720366],
        [14.900163530239038, 11.44533345848322, 8.918650863575749, 14.992039327110563, 9.93493935582228, 7.956929687294178, 10.819814230182342, 12.326472915243357],
    ):
        y = np.array(y)
        a, b, c, d, e, f = K.fit_peak(x, y)
        left = a * np.exp(-(((x - b) / c) ** 2)) + d * x**-e + f - y
        assert np.isfinite([a, b, c, d, e, f]).all() and (left**2).sum() < ((y - y.mean()) ** 2).sum()


def _norm(order):
    def square(x):
        y = M.harmonic(order, F.cos(x))
        return F.sin(x) * y * y

    return M.simpson(square) * (2 * math.pi)


def test_fold_and_gaps_with_missing_values(spark):
    rows = spark.createDataFrame([(1, 0, s, -1.0 if s in (0, 4, 1) else 10.0 + s, 2) for s in range(8)], "k int, r int, seg int, i double, n int")
    folded = {r["seg"]: r["i"] for r in pattern.fold(rows, ["k"]).collect()}
    assert folded == {0: -1.0, 1: 15.0, 2: 14.0, 3: 15.0}
    filled = {r["seg"]: r["i"] for r in pattern.fill_gaps(rows, ["k"]).collect()}
    assert filled == {0: 12.0, 1: 12.0, 2: 12.0, 3: 13.0, 4: 14.0, 5: 15.0, 6: 16.0, 7: 17.0}
    none = rows.withColumn("i", F.lit(-1.0))
    assert {r["i"] for r in pattern.fill_gaps(none, ["k"]).collect()} == {0.0}


def test_one_cosine_gives_its_amplitude_and_base(spark):
    rows = spark.range(8).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("seg"), (10 + 3 * F.cos(F.col("id") * 2 * math.pi / 8 + 0.4)).alias("i"), F.lit(1).alias("n"))
    got = pattern.fourier(rows, ["k"]).first()
    assert (got["f1"], got["f2"], got["phase"], got["dev"]) == pytest.approx((10, 3, 0.4, 0), abs=1e-6)


def test_scan_log_with_text_before_the_first_scan(spark):
    text = ["# head", "1 2", "#S 7 a", "#C mark Z", "3 4", "#X 7", "#S 8 b", "#X 80"]
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(text)], "file int, line_no long, text string")
    assert [(r["scan"], r["n_rows"], r["total"]) for r in spec.scans(lines).orderBy("scan").collect()] == [(7, 1, 3.0), (8, 0, 0.0)]
    assert [tuple(r) for r in spec.find_scans(lines, "#C mark ").collect()] == [(0, 3, 7)]
    assert {r["scan"]: (r["finished"], r["overtaken"]) for r in spec.states(lines).collect()} == {7: (True, True), 8: (False, False)}


def test_back_projection_recovers_a_disc():
    n, degrees = 33, np.arange(0, 180, 3.0)
    t = np.arange(n) - (n - 1) / 2
    chord = 2 * np.sqrt(np.maximum(64 - t * t, 0))
    image = K.filtered_back_projection(np.tile(chord, (len(degrees), 1)), degrees)
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    assert image[(x * x + y * y) < 25].mean() == pytest.approx(1, abs=0.1)
    assert abs(image[(x * x + y * y) > 150].mean()) < 0.1


def test_registration_and_peak_fit():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(16, 16))
    assert K.shift_between(a, np.roll(a, (3, -2), (0, 1))) == pytest.approx((3, -2), abs=0.2)
    x = np.linspace(1, 10, 60)
    p = K.fit_peak(x, 5 * np.exp(-(((x - 4) / 0.8) ** 2)) + 2 * x**-1.5 + 1)
    assert p[:3] == pytest.approx((5, 4, 0.8), rel=0.02)
    assert K.shell_correlation(a, a) == pytest.approx(1)


def explode_simulated(made, projections, model):
    """Images by a row for each voxel, projection and tap."""
    from scatterlake.operators import geometry as G

    q = G.directions(projections, generate.segments(model.sparkSession)).groupBy("p").pivot("seg", list(range(generate.SEGMENTS))).agg(F.first("qx").alias("qx"), F.first("qy").alias("qy"), F.first("qz").alias("qz"))
    points = P.hit_points(model, projections, 5, 5, 5).select("*", *G.axis_columns()).join(q, "p")
    values = [F.pow(M.amplitude(M.cosine_to(f"{k}_qx", f"{k}_qy", f"{k}_qz")), 2).alias(f"s{k}") for k in range(generate.SEGMENTS)]
    return P.forward(points.select("p", "xp", "yp", *values), made.names("s"), 5, 5).where(" + ".join(made.names("s")) + " > 0")


@pytest.fixture(scope="module")
def tilted(spark):
    """A cube under tilts up to 90 degrees, whose images are met by several blocks of one or two slices."""
    grid = generate.voxels(spark, 5)
    tilts = [(0, 0.0, 0.0, 0.0, 0.0), (1, 40.0, 20.0, 0.25, 0.5), (4, 90.0, 35.0, 0.0, -0.25), (7, 170.0, 10.0, -0.5, 0.0)]
    poses = spark.createDataFrame(tilts, "p int, rot_x double, rot_y double, dx double, dy double")
    truth = stage(grid.select(*O.KEY, *O.PARAMETERS), "truth")
    measured = None
    made = []
    for slices in (5, 1, 2):
        m = O.Problem.of(grid, poses, generate.segments(spark), grid, 5, 4, generate.SEGMENTS, slices=slices)
        measured = measured or stage(explode_simulated(m, poses, truth), "measured")
        m.images = measured
        made.append(m)
    return made, truth, poses


def test_blocks_sum_images_as_single_rows_do(tilted):
    made, truth, _ = tilted
    key = ["p", "y", "x"]
    want = made[0].images.orderBy(*key).toPandas().to_numpy()
    for m in made:
        got = O.simulate(m, truth).orderBy(*key).toPandas().to_numpy()
        assert got.shape == want.shape and np.allclose(got, want, rtol=1e-12, atol=1e-12)


def test_blocks_that_share_rows_find_what_one_block_finds(tilted):
    made, truth, _ = tilted
    start = stage(truth.select(*O.KEY, *((F.col(c) * 0.9).alias(c) for c in O.COEFFICIENTS), (F.col("theta") + 0.2).alias("theta"), "phi"), "start")
    found = []
    for m in made:
        slopes = O.gradients(m, start, O.PARAMETERS).orderBy(*O.KEY).toPandas().to_numpy()
        state = O.Descent.at(m, stage(O.packed(m, start), "blocks"), ["a0", "theta"], mu=0.01)
        state.beta = 0.0
        after = O.Descent.at(m, state.blocks, ["a0", "theta"], 0.0, 0.3, 0.01)
        after.beta = 0.2
        found.append((slopes, np.array([*np.ravel(state.errors([0.0, 0.3])), *np.ravel(after.errors([0.0, 0.1])), after.slope, after.size])))
    assert found[0][1][2:4] == pytest.approx(found[0][1][4:6]) and found[0][1][0] > 0
    for slopes, values in found[1:]:
        assert np.allclose(slopes, found[0][0], rtol=1e-9, atol=1e-14)
        assert np.allclose(values, found[0][1], rtol=1e-9)


def test_unmeasured_pixels_count_nothing(tilted, problem):
    made, truth, _ = tilted
    start = stage(truth.withColumn("a0", F.col("a0") * 0.7), "start")
    whole = O.error(made[1], start)
    errors = []
    for keep in (F.col("y") <= 3, F.col("y") > 3):
        part = O.Problem(made[1].geometry, made[1].images.where(keep), made[1].segments, made[1].pixels)
        errors.append(O.error(part, start))
    assert min(errors) > 0 and sum(errors) == pytest.approx(whole)


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_an_iteration_exchanges_few_rows(spark):
    from scatterlake.plans import iterate

    made, start = iterate._problem(spark, "/root/testdata/sf0.001")
    before = set(shuffled(spark))
    _, errors = O.conjugate_gradient(made, start, ["a0"], 1)
    written = sum(v for k, v in shuffled(spark).items() if k not in before)
    assert len(errors) == 2 and errors[1] < errors[0]
    assert written < 5e6  # the voxels once, the measured images once


def test_reconstruction_runs_as_long_as_the_reference_does(spark, monkeypatch):
    from scatterlake.plans import iterate

    monkeypatch.setattr(iterate, "_problem", lambda spark, sf_dir: (None, None))
    asked = []
    monkeypatch.setattr(O, "four_steps", lambda problem, start, iterations: (asked.append(iterations), (None, [1.0, 0.5]))[1])
    assert iterate.recon_sh(spark, "").count() == 2
    assert asked == [(10, 20, 20, 50)]


def test_a_converged_search_ends(tilted):
    made, truth, _ = tilted
    start = stage(truth.withColumn("a0", F.col("a0") + F.when(F.col("iy") == 2, 0.01).otherwise(0.0)), "start")
    _, errors = O.conjugate_gradient(made[0], start, ["a0"], 25)
    assert 2 < len(errors) < 26 and errors == sorted(errors, reverse=True)


def test_regularisation_scan_is_the_reference_s(spark, monkeypatch):
    from scatterlake.plans import iterate

    monkeypatch.setattr(iterate, "_problem", lambda spark, sf_dir: (None, None))
    asked = []
    monkeypatch.setattr(O, "l_curve", lambda *given: (asked.append(given[2:]), [(1.0, 2.0, 3.0)])[1])
    assert iterate.lcurve(spark, "").count() == 1
    (wanted, weights, iterations), = asked
    assert wanted == O.PARAMETERS and iterations == 10
    assert np.allclose(np.log10(weights), np.linspace(-5, 10, 15))


def test_heavier_weights_leave_a_larger_error_and_a_smaller_penalty(tilted):
    made, truth, _ = tilted
    start = stage(truth.withColumn("a0", F.col("a0") * 0.9), "start")
    found = O.l_curve(made[0], start, ["a0"], [0.0, 1e-2, 1e8], 3)
    assert [mu for mu, _, _ in found] == [0.0, 1e-2, 1e8]
    assert found[0][1] < found[1][1] < found[2][1] and found[0][2] > found[1][2] > found[2][2] >= 0
    again, _ = O.conjugate_gradient(made[0], start, ["a0"], 3, mu=1e-2)
    assert found[1][1] == pytest.approx(O.error(made[0], again)) and found[1][2] == pytest.approx(again.agg(F.sum(F.col("a0") * F.col("a0"))).first()[0])
