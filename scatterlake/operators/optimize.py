"""Iterative reconstruction of the harmonic model: driver loops around Spark jobs.

A model is a voxel DataFrame. The optimizer packs it into blocks, one row for a
run of slices, whose arrays hold voxels, measured image rows, gradient and
direction; kernels of ``blocks`` work on one at a time. Only image rows that
several blocks meet are exchanged, and only scalars come to the driver. An
iteration writes its blocks once to the shared folder, so plans stay short and
a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.operators import blocks as B
from scatterlake.operators import geometry as G
from scatterlake.operators.blocks import ORDERS, PARAMETERS
from scatterlake.operators.linesearch import minimise
from scatterlake.session import discard, stage, tidy

KEY = ["iy", "ix", "iz"]
COEFFICIENTS = [f"a{n}" for n in ORDERS]
#: Slices of a block.
SLICES = 512
#: Bytes of exchanged image rows that are broadcast; more are joined by a shuffle.
BROADCAST = 64 << 20


@dataclass
class Problem:
    """The projections' geometry and measured images with p, y, x and s0.. columns."""

    geometry: B.Geometry
    images: DataFrame
    segments: int
    pixels: int

    @staticmethod
    def of(grid: DataFrame, projections: DataFrame, segments: DataFrame, images: DataFrame, n: int, n_projections: int, n_segments: int, shape: tuple[int, int, int] | None = None, size: tuple[int, int] | None = None, slices: int = SLICES) -> Problem:
        """A cube of ``n`` seen in images of n x n, or a volume of ``shape`` (iy, ix, iz) in images of ``size`` (y, x).

        Blocks have ``slices`` slices; their results don't depend on it.
        """
        ny, nx = size or (n, n)
        poses = projections.select("p", "dx", "dy", *G.rotation_columns()).orderBy("p").collect()
        places = {r["p"]: i for i, r in enumerate(poses)}
        q = np.zeros((len(poses), n_segments, 3))
        for r in G.directions(projections, segments).collect():
            q[places[r["p"]], r["seg"]] = r["qx"], r["qy"], r["qz"]
        rotation = np.array([[[r[f"r{i}{k}"] for k in (1, 2, 3)] for i in (1, 2, 3)] for r in poses])
        shape = shape or (n, n, n)
        geometry = B.Geometry(np.array([r["p"] for r in poses]), rotation, np.array([r["dx"] for r in poses]), np.array([r["dy"] for r in poses]), q, shape, (ny, nx), slices)
        return Problem(geometry, images, n_segments, n_projections * ny * nx)

    def names(self, prefix: str) -> list[str]:
        return [f"{prefix}{k}" for k in range(self.segments)]


def _parted(problem: Problem, rows: DataFrame) -> DataFrame:
    """Rows partitioned by block, a few blocks to a task."""
    g, cores = problem.geometry, rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(min(g.blocks, max(2 * cores, g.blocks // 8)), "block")


#: How many rows go to a Python worker at once, and how many blocks may: one with all parameters wanted takes up to about 6 MB.
BATCH, AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", "4"


@contextmanager
def _few(blocks: DataFrame) -> Iterator[None]:
    """Queries within send few blocks at a time, whatever a partition holds."""
    conf = blocks.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, AT_ONCE)
    try:
        yield
    finally:
        conf.set(BATCH, before)


def _one(**columns) -> pa.RecordBatch:
    """A batch of one row; arrays become binary."""
    made = {k: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v]) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with binary columns as arrays: keys of integers, (iy, ix, iz), the others of doubles, a line for a parameter."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name in batch.schema.names:
                value = batch.column(name)[i]
                if name == "keys":
                    row[name] = np.frombuffer(value.as_buffer(), np.int32).reshape(3, -1)
                elif pa.types.is_binary(value.type) or pa.types.is_large_binary(value.type):
                    row[name] = np.frombuffer(value.as_buffer(), np.float64)
                else:
                    row[name] = value.as_py()
            if "keys" in row:
                n = row["keys"].shape[1]
                row |= {c: row[c].reshape(-1, n) for c in ("x", "g", "h") if c in row}
            yield row


def packed(problem: Problem, model: DataFrame, measured: bool = True) -> DataFrame:
    """(block, keys, x, d): a model's voxels by blocks, with the image rows that a block meets, NaN where none was measured."""
    g, names = problem.geometry, problem.names("s")
    block = F.floor((F.col("iy") - 1) / g.slices).cast("int").alias("block")
    voxels = _parted(problem, model.select(block, *KEY, *(F.col(w).cast("double") for w in PARAMETERS)))
    schema = "block int, keys binary, x binary, d binary"

    def fill(voxels: pa.Table, images: pa.Table | None) -> pa.Table:
        if not voxels.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("block", pa.int32()), *((c, pa.binary()) for c in ("keys", "x", "d")))})
        keys = np.stack([voxels.column(c).to_numpy() for c in KEY]).astype(np.int32)
        if (keys < 1).any() or (keys > np.array(g.shape)[:, None]).any():
            raise ValueError("a voxel lies outside the volume's shape")
        order = np.lexsort(keys[::-1])
        x = np.stack([voxels.column(w).to_numpy() for w in PARAMETERS])
        boxes = g.boxes(voxels.column("block")[0].as_py())
        d = [np.full((g.segments, b.size), np.nan) for b in boxes]
        if images is not None and images.num_rows:
            p, y, column = (images.column(c).to_numpy() for c in ("p", "y", "x"))
            s = np.stack([images.column(c).to_numpy() for c in names])
            for i, b in enumerate(boxes):
                at = np.flatnonzero((p == g.p[i]) & (y >= b.low) & (y < b.low + len(b.shared)) & (column >= b.left) & (column < b.left + b.columns))
                d[i][:, (y[at] - b.low) * b.columns + column[at] - b.left] = s[:, at]
        return pa.Table.from_batches([_one(block=pa.scalar(voxels.column("block")[0].as_py(), pa.int32()), keys=keys[:, order], x=x[:, order], d=np.concatenate([v.ravel() for v in d]))])

    if not measured:
        return voxels.groupBy("block").applyInArrow(lambda t: fill(t, None), schema)

    def dealt(batches):
        spans = [np.array([g._span(b, i)[:2] for b in range(g.blocks)]) for i in range(len(g.p))]
        for batch in batches:
            p, y = batch.column("p").to_numpy(), batch.column("y").to_numpy()
            for i, span in enumerate(spans):
                at = np.flatnonzero(p == g.p[i])
                # spans move one way with the block
                turned = span[::-1] if span[0, 0] > span[-1, 0] else span
                first, last = np.searchsorted(turned[:, 1], y[at]), np.searchsorted(turned[:, 0], y[at], "right")
                many = np.maximum(last - first, 0)
                found = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found = g.blocks - 1 - found if turned is not span else found
                out = batch.take(pa.array(np.repeat(at, many)))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *out.columns], ["block", *out.schema.names])

    columns = [F.col("p").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), *(F.col(s).cast("double") for s in names)]
    rows = problem.images.select(*columns).mapInArrow(dealt, "block int, p long, y int, x int, " + ", ".join(f"{s} double" for s in names))
    return voxels.groupBy("block").cogroup(_parted(problem, rows).groupBy("block")).applyInArrow(fill, schema)


def unpacked(blocks: DataFrame, wanted: list[str] = ()) -> DataFrame:
    """Voxel rows of blocks: KEY, PARAMETERS and, for ``wanted``, g_<parameter>."""

    def rows(batches):
        for r in _rows(batches):
            values = [*r["x"], *(r["g"] if wanted else ())]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*r["keys"], *values)], [*KEY, *PARAMETERS, *(f"g_{w}" for w in wanted)])

    columns = [*(f"{k} int" for k in KEY), *(f"{w} double" for w in PARAMETERS), *(f"g_{w} double" for w in wanted)]
    return blocks.select("keys", "x", *(["g"] if wanted else [])).mapInArrow(rows, ", ".join(columns))


def simulate(problem: Problem, model: DataFrame) -> DataFrame:
    """(p, y, x, s0..): the images of a model."""
    g, names = problem.geometry, problem.names("s")

    def rows(batches):
        for r in _rows(batches):
            boxes = g.boxes(r["block"])
            found, met = B.images(g, boxes, r["keys"], r["x"])
            for i, b in enumerate(boxes):
                at = np.flatnonzero(met[i] > 0)
                if len(at):
                    place = [np.full(len(at), int(g.p[i])), at // b.columns + b.low, at % b.columns + b.left]
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in place] + [pa.array(v[at]) for v in found[i][0]], ["p", "y", "x", *names])

    pixels = packed(problem, model, False).mapInArrow(rows, "p int, y int, x int, " + ", ".join(f"{s} double" for s in names))
    return pixels.groupBy("p", "y", "x").agg(*(F.sum(s).alias(s) for s in names))


def _shared_rows(g: B.Geometry, boxes: list[B.Box], found: list[np.ndarray], met: list[np.ndarray], d: list[np.ndarray]):
    """(projection, row, images + weights + measured) of each row that other blocks may meet."""
    for i, b in enumerate(boxes):
        for r in np.flatnonzero(b.shared) if b.size else ():
            at = slice(r * b.columns, (r + 1) * b.columns)
            yield i, b.low + int(r), np.concatenate([v[..., at].ravel() for v in (found[i], met[i], d[i])])


def _summed(batches: Iterable[pa.RecordBatch], g: B.Geometry, count: int) -> Iterator[tuple]:
    """((projection, row), blocks, images, weights, measured) of the shared rows of a partition, each summed over its blocks."""
    known: dict[tuple[int, int], list] = {}
    for r in _rows(batches):
        columns = len(r["v"]) // ((count + 1) * g.segments + 1)
        mine = columns * (count * g.segments + 1)
        if (at := (r["p"], r["y"])) in known:
            known[at][0].append(r["block"])
            known[at][1][:mine] += r["v"][:mine]
        else:
            known[at] = [[r["block"]], r["v"].copy()]
    for at, (owners, v) in known.items():
        columns = len(v) // ((count + 1) * g.segments + 1)
        cut = count * g.segments * columns
        yield at, owners, v[:cut].reshape(count, g.segments, columns), v[cut : cut + columns], v[cut + columns :].reshape(g.segments, columns)


SHARED = "block int, p int, y int, v binary"


def _direction(row: dict, wanted: list[int], beta: float) -> np.ndarray:
    """(6, n): -g + beta * h, zero for parameters that aren't wanted."""
    out = np.zeros_like(row["x"])
    if "g" in row:
        out[wanted] = -row["g"] + (beta * row["h"] if beta else 0.0)
    return out


def _errors(problem: Problem, blocks: DataFrame, wanted: list[int], beta: float, steps: list[float]) -> list[tuple[float, float]]:
    """2 sum (sqrt model - sqrt data)^2 over the pixels, and the sum of the squared wanted parameters, for blocks moved by each of ``steps`` along their direction: one job."""
    g, steps = problem.geometry, [float(s) for s in steps]

    def score(batches):
        for r in _rows(batches):
            boxes = g.boxes(r["block"])
            h = _direction(r, wanted, beta)
            found, met = B.images_along(g, boxes, r["keys"], r["x"], h, steps)
            d = B.split(boxes, r["d"], g.segments)
            total, squares = np.zeros(len(steps)), np.array([((r["x"][wanted] + s * h[wanted]) ** 2).sum() for s in steps])
            for i, b in enumerate(boxes):
                own = np.repeat(~b.shared, b.columns)
                total += B.misfit(found[i][..., own], d[i][:, own], met[i][own])
            yield _one(block=pa.scalar(r["block"], pa.int32()), p=pa.scalar(-1, pa.int32()), y=pa.scalar(r["block"], pa.int32()), v=np.concatenate([total, squares]))
            for i, y, v in _shared_rows(g, boxes, found, met, d):
                yield _one(block=pa.scalar(r["block"], pa.int32()), p=pa.scalar(i, pa.int32()), y=pa.scalar(y, pa.int32()), v=v)

    def add(batches):
        total, rest = np.zeros(2 * len(steps)), []
        for b in batches:
            alone = b.filter(pc.equal(b.column("p"), -1))
            for r in _rows([alone]):
                total += r["v"]
            rest.append(b.filter(pc.greater_equal(b.column("p"), 0)))
        for _, _, found, met, d in _summed(rest, g, len(steps)):
            total[: len(steps)] += B.misfit(found, d, met)
        yield _one(e=total)

    sent = blocks.mapInArrow(score, SHARED)
    with tidy(blocks.sparkSession), _few(blocks):
        # a block alone shares no rows
        sent = (sent if g.blocks < 2 else sent.repartition("p", "y")).mapInArrow(add, "e binary")
        found = [np.frombuffer(r["e"]) for r in sent.collect()]
    errors, squares = np.sum([np.zeros(2 * len(steps)), *found], 0).reshape(2, -1).tolist()
    return [(e * 2 / problem.pixels, s) for e, s in zip(errors, squares, strict=True)]


def _exchanged(problem: Problem, blocks: DataFrame, wanted: list[int], beta: float, step: float) -> DataFrame | None:
    """(block, rows): residuals of the image rows that a block shares, from the voxels near them; None where nothing can be shared."""
    g, pixels = problem.geometry, problem.pixels
    if g.blocks < 2:
        return None

    def send(batches):
        for r in _rows(batches):
            boxes = g.boxes(r["block"])
            near = B.near_shared(g, boxes, r["keys"])
            x = r["x"] + step * _direction(r, wanted, beta)
            found, met = B.images(g, boxes, np.ascontiguousarray(r["keys"][:, near]), x[:, near])
            for i, y, v in _shared_rows(g, boxes, found, met, B.split(boxes, r["d"], g.segments)):
                yield _one(block=pa.scalar(r["block"], pa.int32()), p=pa.scalar(i, pa.int32()), y=pa.scalar(y, pa.int32()), v=v)

    def compare(batches):
        for (p, y), owners, found, met, d in _summed(batches, g, 1):
            v = B.residual(found[0], d, met, pixels)
            for block in owners:
                yield _one(block=pa.scalar(block, pa.int32()), p=pa.scalar(p, pa.int32()), y=pa.scalar(y, pa.int32()), v=v)

    rows = blocks.mapInArrow(send, SHARED).repartition("p", "y").mapInArrow(compare, SHARED)
    rows = rows.groupBy("block").agg(F.collect_list(F.struct("p", "y", "v")).alias("rows"))
    boxes = g.boxes(g.blocks // 2)
    most = g.blocks * sum(int(b.shared.sum()) * b.columns for b in boxes) * g.segments * 8
    return rows.hint("broadcast" if most <= BROADCAST else "merge")


SCALARS = ("gg", "go", "gh", "hh")


def _advanced(problem: Problem, blocks: DataFrame, wanted: list[int], beta: float, step: float, mu: float) -> DataFrame:
    """Blocks moved by ``step`` along their direction, with the gradient ``g`` there, the direction ``h`` and the products that the next step needs."""
    g, pixels = problem.geometry, problem.pixels

    def advance(batches):
        for r in _rows(batches):
            boxes = g.boxes(r["block"])
            h = _direction(r, wanted, beta)
            x = r["x"] + step * h
            found, met = B.images(g, boxes, r["keys"], x)
            d = B.split(boxes, r["d"], g.segments)
            parts = [B.residual(found[i][0], d[i], met[i], pixels) for i in range(len(boxes))]
            for row in r.get("rows") or ():
                b = boxes[row["p"]]
                at = (row["y"] - b.low) * b.columns
                parts[row["p"]][:, at : at + b.columns] = np.frombuffer(row["v"]).reshape(g.segments, -1)
            slope = B.slopes(g, boxes, r["keys"], x, parts, wanted) + 2 * mu * x[wanted]
            h, old = h[wanted], r.get("g", np.zeros_like(slope))
            dots = {"gg": (slope, slope), "go": (slope, old), "gh": (slope, h), "hh": (h, h)}
            yield _one(block=pa.scalar(r["block"], pa.int32()), keys=r["keys"], x=x, d=r["d"], g=slope, h=h, **{k: float((a * b).sum()) for k, (a, b) in dots.items()})

    sent = _exchanged(problem, blocks, wanted, beta, step)
    rows = blocks if sent is None else blocks.join(sent, "block", "left")
    return rows.mapInArrow(advance, "block int, keys binary, x binary, d binary, g binary, h binary, " + ", ".join(f"{k} double" for k in SCALARS))


def _moved(blocks: DataFrame, wanted: list[int], beta: float, step: float) -> DataFrame:
    """(block, keys, x, d) after a step along the direction."""

    def move(batches):
        for r in _rows(batches):
            yield _one(block=pa.scalar(r["block"], pa.int32()), keys=r["keys"], x=r["x"] + step * _direction(r, wanted, beta), d=r["d"])

    return blocks.mapInArrow(move, "block int, keys binary, x binary, d binary")


def error(problem: Problem, model: DataFrame) -> float:
    """2 sum (sqrt model - sqrt data)^2 over the pixels: what a line search needs, without gradients."""
    return _errors(problem, packed(problem, model), [], 0.0, [0.0])[0][0]


def gradients(problem: Problem, model: DataFrame, wanted: list[str]) -> DataFrame:
    """``model`` with g_<parameter> for each of ``wanted``, the exact adjoint of the projection."""
    blocks = stage(packed(problem, model), "blocks")
    return unpacked(_advanced(problem, blocks, [PARAMETERS.index(w) for w in wanted], 0.0, 0.0, 0.0), wanted)


@dataclass
class Descent:
    """Where a search stands: staged blocks, the factor of their old direction, products of gradients and direction."""

    problem: Problem
    blocks: DataFrame
    wanted: list[int]
    dots: dict[str, float]
    beta: float = 0.0

    @staticmethod
    def at(problem: Problem, blocks: DataFrame, wanted: list[str], beta: float = 0.0, step: float = 0.0, mu: float = 0.0) -> Descent:
        """Steepest descent from blocks moved by ``step``: their new state is staged."""
        places = [PARAMETERS.index(w) for w in wanted]
        with _few(blocks):
            now = stage(_advanced(problem, blocks, places, beta, step, mu), "state")
        sums = now.agg(*(F.sum(k).alias(k) for k in SCALARS)).first().asDict()
        return Descent(problem, now, places, {k: float(v or 0.0) for k, v in sums.items()})

    @property
    def slope(self) -> float:
        return -self.dots["gg"] + self.beta * self.dots["gh"]

    @property
    def size(self) -> float:
        """The direction's squared length."""
        return self.dots["gg"] - 2 * self.beta * self.dots["gh"] + self.beta**2 * self.dots["hh"]

    def errors(self, steps: list[float]) -> list[tuple[float, float]]:
        """(error, sum of the squared wanted parameters) after each step."""
        return _errors(self.problem, self.blocks, self.wanted, self.beta, steps)


def _descend(problem: Problem, blocks: DataFrame, wanted: list[str], iterations: int, restart: int, mu: float, search: int, keep: bool = False) -> tuple[DataFrame, list[tuple[float, float]]]:
    """(blocks, [(error, squares)]) of ``conjugate_gradient``; the blocks it is given go unless ``keep``."""
    state = Descent.at(problem, blocks, wanted, mu=mu)
    if not keep:
        discard(blocks)
    history = state.errors([0.0])
    step, guess, before = 0.0, None, 0.0
    for number in range(iterations):
        if number:
            old, state = state, Descent.at(problem, state.blocks, wanted, state.beta, step, mu)
            discard(old.blocks)
            step = 0.0
            if number % restart:
                state.beta = max(0.0, (state.dots["gg"] - state.dots["go"]) / before) if before else 0.0
                if state.slope >= 0:
                    state.beta = 0.0
        before = state.dots["gg"]
        if not state.size > 0:
            break
        found: dict[float, tuple[float, float]] = {}

        def score(steps, state=state, found=found):
            found |= zip(steps, state.errors(steps), strict=True)
            return [found[s][0] + mu * found[s][1] for s in steps]

        now = history[-1][0] + mu * history[-1][1]
        step, value, _ = minimise(score, now / state.size if guess is None else guess, now, search, 0.05)
        if not step:
            break
        guess = step
        history.append(found[step])
        if number and 2 * abs(now - value) <= TOLERANCE * (abs(now) + abs(value) + TOLERANCE) and step * state.size**0.5 <= TOLERANCE:
            break
    with _few(state.blocks):
        model = stage(_moved(state.blocks, state.wanted, state.beta, step), "blocks")
    discard(state.blocks)
    return model, history


#: Relative change of the error and length of the step, both, below which a search has converged.
TOLERANCE = 1e-3


def conjugate_gradient(problem: Problem, model: DataFrame, wanted: list[str], iterations: int, restart: int = 25, mu: float = 0.0, search: int = 4) -> tuple[DataFrame, list[float]]:
    """(model, errors): Polak-Ribiere with a restart every ``restart`` steps or when not descending, until it converges.

    The line search needs no gradients: it brackets a minimum and refines it by
    parabolic and golden steps, ``search`` rounds of several steps at most.
    ``mu`` adds mu * sum of the squared wanted parameters.
    """
    blocks = stage(packed(problem, model), "blocks")
    found, history = _descend(problem, blocks, wanted, iterations, restart, mu, search)
    return unpacked(found), [e + mu * s for e, s in history]


def four_steps(problem: Problem, model: DataFrame, iterations: tuple[int, int, int, int]) -> tuple[DataFrame, list[float]]:
    """a0, then angles, then a2 a4 a6, then all together."""
    blocks, errors = stage(packed(problem, model), "blocks"), []
    for wanted, n in zip((["a0"], ["theta", "phi"], ["a2", "a4", "a6"], PARAMETERS), iterations, strict=True):
        blocks, history = _descend(problem, blocks, wanted, n, 25, 0.0, 4)
        errors += [e for e, _ in (history if not errors else history[1:])]
    return unpacked(blocks), errors


def l_curve(problem: Problem, model: DataFrame, wanted: list[str], weights: list[float], iterations: int) -> list[tuple[float, float, float]]:
    """(mu, error, penalty) from the same start for each weight."""
    blocks, out = stage(packed(problem, model), "blocks"), []
    for mu in weights:
        found, history = _descend(problem, blocks, wanted, iterations, 25, mu, 4, keep=True)
        discard(found)
        out.append((float(mu), *history[-1]))
    discard(blocks)
    return out
