import hashlib
import math

import numpy as np
from pyspark.sql import Row

from scatterlake.llm.codes import build_tree, compress, group_total, nearest


def plain(rows, parts=8, entries=16, rounds=6):
    good = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return [], ""
    dim = len(good[0][1])
    good = [r for r in good if len(r[1]) == dim]
    width = -(-dim // parts)
    cut = [[(v + [0] * (parts * width - dim))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in good]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        found = [[assign(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(book[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p] == k]
                if own:
                    book[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for (i, _, label), c in zip(good, cut, strict=True):
        hits = [assign(c[p], p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits), label))
    flat = ",".join(str(x) for part in book for e in part for x in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


def order(row):
    return tuple((x is None, str(x)) for x in row)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got, model = compress(df, **kw)
    expected, digest = plain(rows, **kw)
    assert sorted([(r["vec_id"], r["__code"], r["__error"], r["label"]) for r in got.collect()], key=order) == sorted(expected, key=order)
    assert (model.digest() if model else "") == digest


def test_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=16).tolist(), i % 5) for i in range(200)]
    rows += [(500 + i, rows[3][1], 1) for i in range(120)]  # a large group of equal vectors
    rows += [(900 + i, np.round(rng.normal(size=16) * 2).tolist(), None) for i in range(60)]  # many equal distances
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0, None] * 8, 1), (2003, [float("nan")] * 16, 1), (2004, [float("-inf")] * 16, 1), (2005, [1.0], 2), (None, [0.5] * 16, 3)]
    rows += [(5, rows[7][1], 1), (5, rows[5][1], 2)]  # an id in three rows
    run(spark, rows)


def test_lengths_that_do_not_divide_and_few_rows(spark):
    rng = np.random.default_rng(1)
    run(spark, [(i, rng.normal(size=11).tolist(), 0) for i in range(40)])
    run(spark, [(i, rng.normal(size=3).tolist(), 0) for i in range(5)])
    run(spark, [(1, [1.0] * 8, 0)])
    run(spark, [(1, None, 0)])
    run(spark, [])


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    run(spark, [(i, (rng.normal(size=8) * 1e5).tolist(), 0) for i in range(60)])


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(i, [float(i)] * 8, i, f"c{i}") for i in range(20)], "vec_id long, embedding array<double>, code long, `a.b` string")
    got, _ = compress(df)
    assert got.columns == ["vec_id", "code", "a.b", "__code", "__error"]
    assert sorted((r["vec_id"], r["code"], r["a.b"]) for r in map(Row.asDict, got.collect())) == [(i, i, f"c{i}") for i in range(20)]


def test_trees_find_the_lowest_nearest_and_leave_branches_out():
    rng = np.random.default_rng(4)
    for size, spread in ((8, 3), (8, 400), (2, 5), (1, 2), (8, 1)):
        entries = rng.integers(-spread, spread + 1, size=(16, size))
        entries[9] = entries[2]
        values = rng.integers(-spread, spread + 1, size=(500, size))
        who, best, _ = nearest(values, entries, build_tree(entries.tolist()))
        d = ((values[:, None] - entries[None]) ** 2).sum(2)
        assert (who == d.argmin(1)).all() and (best == d.min(1)).all()
    centres = rng.integers(-4000, 4000, size=(16, 8))
    values = centres[rng.integers(0, 16, 1000)] + rng.integers(-50, 50, size=(1000, 8))
    assert nearest(values, centres, build_tree(centres.tolist()))[2] < 0.6 * 16 * len(values)


def test_sums_by_label(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, None, 1), (4, None, 2), (5, "b", (1 << 63) - 1), (6, "b", (1 << 63) - 1)], "id int, label string, e long")
    got = {r["id"]: r["t"] for r in group_total(df, "label", "e", "t").collect()}
    assert got == {1: 12, 2: 12, 3: 3, 4: 3, 5: (1 << 63) - 1, 6: (1 << 63) - 1}
