"""Singular values and vectors of tall matrices: QR of row blocks, joined in a tree.

No task or driver holds more rows than a block or a few triangular factors.
Wide matrices are first reduced to a block of directions by random projection
and power steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Triangular factors that one task joins.
FAN_IN = 16


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _factors(change: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            if b.num_rows:
                block = change(_matrix(b.column(0)))
                r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(r.tolist(), pa.list_(pa.float64()))], ["v"])

    return factor


def triangular(rows: DataFrame, change: Callable[[np.ndarray], np.ndarray] = lambda x: x, parts: int | None = None) -> np.ndarray:
    """R of the QR decomposition of all rows (array column v), each block changed first; up to signs of its rows.

    Factors of blocks are joined ``FAN_IN`` at a time until one is left.
    """
    found = rows.select("v").mapInArrow(_factors(change), "v array<double>")
    left = parts or found.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        found = found.withColumn("part", F.spark_partition_id()).repartition(left, "part").select("v").mapInArrow(_factors(lambda x: x), "v array<double>")
    block = np.array([r["v"] for r in found.collect()])  # one factor, no more rows than columns
    return block if block.size else np.zeros((0, 0))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Rows with their largest component positive."""
    top = np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1)
    return vectors * np.where(top < 0, -1, 1)


def svd(rows: DataFrame, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, right vectors as rows) of the matrix with the rows v, the ``rank`` largest, by the tree of QR."""
    r = triangular(rows)
    if not r.size:
        return np.zeros(0), np.zeros((0, 0))
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    return s[:rank], _signed(vt[:rank])


def _products(basis: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                part = x.T @ (x @ basis)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    return multiply


def krylov_svd(rows: DataFrame, rank: int, size: int, block: int | None = None, steps: int = 3, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The same for wide rows of ``size`` columns: the span of X'X G, (X'X)^2 G, ... for a random block G.

    A step is one pass that sums ``size`` x ``block`` numbers over the tasks;
    then the rows, projected to the span, go through the tree of QR.
    """
    block = min(size, block or rank + 4)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, block)))[0]
    spans = []
    width = block
    for _ in range(steps):
        summed = rows.select("v").mapInArrow(_products(basis), "k long, v array<double>").select("k", F.posexplode("v").alias("j", "x")).groupBy("k", "j").agg(F.sum("x").alias("x")).toPandas()
        moved = np.zeros((size, width))
        moved[summed["k"], summed["j"]] = summed["x"]
        basis = np.linalg.qr(moved)[0]
        spans.append(basis)
    span = np.linalg.qr(np.hstack(spans))[0][:, : min(size, block * steps)]
    r = triangular(rows, lambda x: x @ span)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    return s[:rank], _signed(vt[:rank] @ span.T)
