"""Alignment of projections against what their own reconstruction predicts.

Each round reconstructs the volume from all moved projections, projects it again
and moves each projection towards its prediction. Projections stay on the
executors; what is gathered is the volume, whose size is that of one image times
its width, and two medians.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.functions import images as K
from scatterlake.session import discard, stage

STATE = "id long, degrees double, f array<double>, y double, x double, sy double, sx double"


#: Pixels worked on at once.
PIXELS = 1 << 18


def _images(batch: pa.RecordBatch, side: int) -> Iterator[tuple]:
    """(angle, rows, images, y, x, sy, sx) of the batch: stacks of one angle, of bounded size."""
    if not batch.num_rows:
        return
    images = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1, side)
    degrees, *moves = (batch.column(i).to_numpy() for i in (1, 3, 4, 5, 6))
    each = max(1, PIXELS // max(1, images[0].size))
    for angle in np.unique(degrees).tolist():
        same = np.flatnonzero(degrees == angle)
        for at in np.split(same, range(each, len(same), each)):
            yield angle, at, images[at], *(c[at] for c in moves)


def reconstruct(state: DataFrame, side: int, count: int, centre: tuple[float, float]) -> np.ndarray:
    """(slices, side * side): filtered back projection of all projections, moved by their shift and last step."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # moving back from the transform, filtering and spreading are linear: done once for the sum of an angle's images
        total = None
        for batch in batches:
            for angle, _, images, y, x, sy, sx in _images(batch, side):
                together = np.fft.ifft2(K.turned(images, y + sy - centre[0], x + sx - centre[1]).sum(axis=0)).real
                part = K.smear(together, angle).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    sums = state.mapInArrow(spread, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(sums)]).reshape(-1, side * side) * np.pi / 2 / count


def align(projections: DataFrame, side: int, rounds: int = 30, least: float = 0.02) -> tuple[DataFrame, list[float]]:
    """(id, y, x): the shift that each projection needs, and the largest step of each round.

    ``projections`` has id, degrees and f, the pixels row by row, ``side`` to a
    row; all have one shape. Rows are along the tilt axis. Steps are held to one
    pixel and centred on their median, and rounds end once none reaches
    ``least``. Projections that are null or hold null or non-finite pixels take
    no part; repeated ids are projections of their own. No rows: no rounds.
    """
    whole = F.col("degrees").isNotNull() & F.col("f").isNotNull() & F.forall("f", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    zero = [F.lit(0.0).alias(c) for c in ("y", "x", "sy", "sx")]
    state = stage(projections.select(F.col("id").cast("long").alias("id"), F.col("degrees").cast("double").alias("degrees"), F.col("f").cast("array<double>").alias("f")).where(whole).select("id", "degrees", "f", *zero), "projections")
    count, centre, steps = state.count(), (0.0, 0.0), []
    for _ in range(rounds if count else 0):
        volume = reconstruct(state, side, count, centre)

        def step(batches: Iterator[pa.RecordBatch], volume=volume, centre=centre) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = np.zeros((4, batch.num_rows))
                for angle, at, images, y, x, sy, sx in _images(batch, side):
                    y, x = y + sy - centre[0], x + sx - centre[1]
                    off = K.gradient_shift(K.high_pass(K.reproject(volume, angle)), K.high_pass(K.moved(images, y, x)))
                    columns[:, at] = y, x, *np.clip([-off[0], -off[1]], -1, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in columns)], ["id", "degrees", "f", "y", "x", "sy", "sx"])

        before, state = state, stage(state.mapInArrow(step, STATE), "aligned")
        discard(before)
        spread = state.agg(*(fn(c) for fn in (lambda c: F.percentile_approx(c, 0.5, 10_000), F.min, F.max) for c in ("sy", "sx"))).first()
        centre = tuple(spread[:2])
        steps.append(float(max(abs(end - centre[i % 2]) for i, end in enumerate(spread[2:]))))
        if steps[-1] < least:
            break
    shifts = [(F.col(c) + F.col(f"s{c}") - m).alias(c) for c, m in zip("yx", centre, strict=True)]
    return state.select("id", *shifts), steps
