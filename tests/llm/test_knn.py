import math

import numpy as np

from scatterlake.llm.knn import _nearest, reachable, top_k


def plain(rows, queries, k):
    ints = {}
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(1024 * float(x)) for x in v]))
    out = []
    for row, (q, v) in enumerate(good):
        if q not in queries:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for n, (i, w) in enumerate(good) if n != row and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, queries, **kw):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, block int")
    got = top_k(df, df.where(df["vec_id"].isin(list(queries))), **kw)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_against_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one large group of equal vectors
    rows += [(2000, None), (2001, []), (2010, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0])]
    rows += [(5, rows[5][1]), (5, rows[6][1])]  # an id in three rows, two of them equal
    queries = {0, 5, 1000, 2000, 2001, 2002, 3000}
    assert run(spark, rows, queries, block=16, max_pivots=9) == plain(rows, queries, 10)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [1e5 + i, -3e4 * i, 7.25]) for i in range(20)]
    assert run(spark, rows, {0, 7}, k=4) == plain(rows, {0, 7}, 4)


def test_few_and_no_rows(spark):
    assert run(spark, [(1, [1.0]), (2, [0.5])], {1}) == [(1, 1, 2, 1024 * 512)]
    assert run(spark, [(1, [1.0])], {1}) == []
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_query_ids_over_several_pivots(spark):
    rng = np.random.default_rng(6)
    order = [r["id"] for r in spark.range(300).selectExpr("id", "xxhash64(11, id) AS o").orderBy("o").collect()]
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300) if i != order[2]]
    rows += [(order[2], [8.0, 0.0, 0.0, 0.0])] * 14  # the third pivot, and more rows than k + 1
    assert run(spark, rows, {order[2], 5}, block=16, max_pivots=9) == plain(rows, {order[2], 5}, 10)


def test_clustered_vectors_are_pruned_without_loss(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 20
    x = np.concatenate([c + rng.normal(size=(60, 8)) * 0.2 for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = {0, 61, 300, 719}
    assert run(spark, rows, queries, max_pivots=30) == plain(rows, queries, 10)
    ints = np.floor(x * 1024)
    pivots = ints[::24]
    cell, far = _nearest(ints, pivots)
    norm = np.linalg.norm(ints, axis=1)
    angle = np.arccos(np.clip((ints * pivots[cell]).sum(1) / norm / np.linalg.norm(pivots[cell], axis=1), -1, 1))
    names = np.unique(cell)
    near = np.full((len(names), 11), np.inf)
    for n, c in enumerate(names):
        near[n, : min(11, (cell == c).sum())] = np.sort(far[cell == c])[:11]
    of = lambda v, f: np.array([f(v[cell == c]) for c in names])
    cells = {"cell": names, "near": near, "radius": of(far, max), "angle": of(angle, max), "longest": of(norm, max), "shortest": of(norm, min)}
    visited = reachable(ints[sorted(queries)], pivots, cells, 11)
    assert (visited * of(far, len)).sum() < 0.35 * len(queries) * len(rows)
