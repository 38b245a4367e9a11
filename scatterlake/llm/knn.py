"""Exact top-k inner-product search by a Voronoi join.

Vectors are grouped by their nearest pivot. Summaries of the groups (counts,
radii, angles, norms, the distances of the members nearest to the pivot) bound
each query's scores from below and above; a query is sent only to the groups
that can hold one of its k best, and groups are solved locally in blocks of
bounded size. Vectors that lie in clusters are pruned; vectors without any
structure can't be, by no such bound, and then every query meets every row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.llm.common import parts_for, stage

SCALE = 1024
#: One pivot for each two square roots of the rows, no more than are cheaply sent to all (2,048 of 64 components: 1 MB).
MAX_PIVOTS = 2048
#: Vectors in one block of a group, and (query, block) rows in one task.
BLOCK = 4096
SAFE = float(1 << 53)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as longs; null unless all are finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & vector.isNotNull(), F.transform(values, lambda x: F.floor(x * F.lit(float(scale)))))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers: in doubles while all sums stay below 2^53, else in Python integers.

    Scores beyond 64 bits are held at the ends of that range.
    """
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if top < SAFE:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one row of scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and Euclidean distance to the nearest pivot."""
    v, p = vectors.astype(float), pivots.astype(float)
    cross = v @ p.T
    cell = np.argmin((p * p).sum(1) - 2 * cross, axis=1)
    return cell, np.linalg.norm(v - p[cell], axis=1)


def reachable(queries: np.ndarray, pivots: np.ndarray, cells: dict[str, np.ndarray], k: int) -> np.ndarray:
    """(queries, groups): whether a group may hold one of the ``k`` best rows of a query.

    For a member x of group c, |q.x - q.p_c| <= |q| |x - p_c|, and q.x is at most
    |q| |x| times the cosine of the least angle that the group's cone leaves.
    The members nearest to their pivots give k lower bounds, hence a score that
    the k best reach (none, if too few are known); a group whose upper bound
    falls short of it isn't visited. ``k`` counts the query's own row, if it has one.
    """
    q = queries.astype(float)
    norm = np.linalg.norm(q, axis=1)[:, None]
    own = pivots[cells["cell"]].astype(float)
    middle = q @ own.T
    lower = (middle[:, :, None] - norm[:, :, None] * cells["near"]).reshape(len(q), -1)  # inf distances: no member
    lower = np.where(np.isfinite(lower), lower, -np.inf)
    spare = lower.shape[1] - k
    least = np.partition(lower, spare, axis=1)[:, spare][:, None] if spare >= 0 else np.full((len(q), 1), -np.inf)
    length = np.linalg.norm(own, axis=1)
    scale = norm * length
    cosine = np.clip(np.divide(middle, scale, out=np.ones_like(middle), where=scale > 0), -1, 1)
    gap = np.cos(np.maximum(np.arccos(cosine) - np.where(length > 0, cells["angle"], np.pi) - 1e-7, 0))
    cone = norm * gap * np.where(gap > 0, cells["longest"], cells["shortest"])
    slack = 1e-9 * (1 + np.abs(middle) + norm * (cells["radius"] + cells["longest"]))  # rounding never loses a group
    return np.minimum(middle + norm * cells["radius"], cone) + slack >= least


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    max_pivots: int = MAX_PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``.

    Scores are integer inner products of floor(scale * component). A query's
    own row (one of ``vectors`` with its id and its vector) is no candidate of
    it; ties go to the smaller id. Rows whose vector is null, or has a null, NaN
    or infinite component, take no part; vectors meet those of their own length
    only, empty ones at score 0. A null id takes no part. A repeated id is a
    candidate once for each row, of the other rows of that id as well, and, as
    a query, answered once for each row. Fewer than k candidates: all of them.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
    )
    data = stage(pick(vectors).withColumn("dim", F.size("v")), "vectors")
    asked = pick(queries).withColumn("dim", F.size("v")).withColumn("q", F.monotonically_increasing_id())
    asked = stage(asked, "asked")
    answers = None
    for row in data.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        part = _top_k_of_dim(
            spark, data.where(F.col("dim") == row["dim"]), asked.where(F.col("dim") == row["dim"]), row["dim"], row["n"], k, max_pivots, block
        )
        answers = part if answers is None else answers.union(part)
    if answers is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return answers


def _top_k_of_dim(spark, data, asked, dim, n, k, max_pivots, block):
    count = int(min(max_pivots, max(1, round(n**0.5 / 2))))
    # a bounded draw of pivots, by a hash of the id: the same whatever the partitions
    drawn = data.select("id", "v").withColumn("o", F.xxhash64(F.lit(11), F.col("id"))).orderBy("o", "id").limit(count).select("v").toPandas()
    pivots = np.unique(np.stack(drawn["v"].to_list()).astype(np.int64), axis=0)
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1), dim).astype(float)
                cell, far = _nearest(v, sent.value)
                p = sent.value[cell].astype(float)
                norm = np.linalg.norm(v, axis=1)
                scale = norm * np.linalg.norm(p, axis=1)
                angle = np.arccos(np.clip(np.divide((v * p).sum(1), scale, out=np.ones(len(v)), where=scale > 0), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far), pa.array(norm), pa.array(angle)], ["id", "v", "cell", "far", "norm", "angle"])

    grouped = stage(data.select("id", "v").mapInArrow(assign, "id long, v array<bigint>, cell int, far double, norm double, angle double"), "cells")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = defaultdict(lambda: np.zeros(0))
        for batch in batches:
            cell, far = (batch.column(i).to_numpy() for i in range(2))
            for c in np.unique(cell).tolist():
                near[c] = np.sort(np.concatenate([near[c], far[cell == c]]))[: k + 1]
        cells = sorted(near)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([near[c].tolist() for c in cells], pa.list_(pa.float64()))], ["cell", "near"])

    partial = grouped.select("cell", "far").mapInArrow(summarise, "cell int, near array<double>")
    ranges = grouped.groupBy("cell").agg(
        F.max("far").alias("radius"), F.max("angle").alias("angle"), F.max("norm").alias("longest"), F.min("norm").alias("shortest"), F.count(F.lit(1)).alias("size")
    )
    # one row for each pivot: the k + 1 least distances, the ranges, the size
    nearest = partial.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    summary = nearest.join(ranges, "cell").orderBy("cell").toPandas()
    near = np.full((len(summary), k + 1), np.inf)
    for i, x in enumerate(summary["near"]):
        near[i, : len(x)] = x
    cells = {c: summary[c].to_numpy() for c in ("cell", "radius", "angle", "longest", "shortest")}
    cells |= {"near": near, "blocks": -(-summary["size"].to_numpy() // block)}
    sent_cells = spark.sparkContext.broadcast(cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent_cells.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(2), dim)
            met = [np.argwhere(reachable(vectors[i : i + 64], sent.value, known, k + 1)) + (i, 0) for i in range(0, len(vectors), 64)]
            query, group = np.concatenate(met).T
            many = known["blocks"][group]  # large groups lie in several blocks
            row, cell = np.repeat(query, many), np.repeat(known["cell"][group], many)
            part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(cell, pa.int32()), pa.array(part, pa.int32())],
                ["q", "id", "v", "cell", "block"],
            )

    routed = asked.select("q", "id", "v").mapInArrow(route, "q long, id long, v array<bigint>, cell int, block int")
    blocks = spark.createDataFrame(
        pd.DataFrame({"c": cells["cell"], "n": cells["blocks"]}), "c int, n long"
    )  # one row for each pivot
    members = grouped.join(F.broadcast(blocks), F.col("cell") == F.col("c")).select(
        "id", "v", "cell", F.pmod(F.xxhash64("id", "far"), F.col("n")).cast("int").alias("block")
    )

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = right["id"].to_numpy(), np.stack(right["v"].to_list())
            for at in range(0, len(left), 256):
                some = left.iloc[at : at + 256]
                asked_v = np.stack(some["v"].to_list())
                for q, own, v, s in zip(some["q"], some["id"], asked_v, dot(asked_v, x), strict=True):
                    keep = best(s, ids, k + 1)
                    same = np.zeros(len(keep), np.int64)
                    alike = np.flatnonzero(ids[keep] == own)
                    same[alike] = (x[keep[alike]] == v).all(axis=1)
                    out.append(np.column_stack([np.full(len(keep), q), np.full(len(keep), own), np.full(len(keep), key[0]), ids[keep], s[keep], same]))
        rows = np.concatenate(out) if out else np.zeros((0, 6), np.int64)
        return pd.DataFrame(rows, columns=["q", "query_id", "cell", "vec_id", "score", "own"])

    spread = parts_for(n, block, int(spark.conf.get("spark.sql.shuffle.partitions")))
    local = (
        routed.repartition(spread, "cell", "block")
        .groupBy("cell", "block")
        .cogroup(members.repartition(spread, "cell", "block").groupBy("cell", "block"))
        .applyInPandas(solve, "q long, query_id long, cell int, vec_id long, score long, own int")
    )
    # k + 1 rows of each block at most, merged by group and then by query, so that
    # no list grows with the number of blocks; of the last k + 1 the query's own row goes
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"), (F.col("own") == 1).alias("own"))
    of_cell = local.groupBy("q", "query_id", "cell").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("best"))
    merged = of_cell.groupBy("q", "query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    others = "filter(best, (x, n) -> n + 1 <> array_position(transform(best, y -> y.own), true))"
    merged = merged.select("query_id", F.slice(F.expr(others), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score")
    )
