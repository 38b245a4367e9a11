"""Vector codes: product quantisation in whole numbers.

Each vector is cut into equal parts; for each part position a codebook of few
entries is fitted by rounds of exact nearest-entry assignment and integer means.
The nearest entry is found in a vantage-point tree over the entries of the
position: branches are left out by the triangle inequality with radii rounded
outwards, visited when the bound only equals the best, and every distance that
decides is computed in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scatterlake.llm.common import stage
from scatterlake.llm.knn import quantised

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LONG_MAX = (1 << 63) - 1
#: Groups whose sums may be sent to all (a million of about 40 bytes).
FEW_GROUPS = 1_000_000

Book = list[list[list[int]]]  # by part, entry, position within the part


class Node(NamedTuple):
    """A vantage entry, and below it the entries no farther than the median distance and the rest.

    The ranges are floats that enclose the distances of the members from the entry.
    """

    entry: int
    cut: int
    near: Node | None
    near_range: tuple[float, float]
    far: Node | None
    far_range: tuple[float, float]


def _root_down(squared: np.ndarray | int) -> np.ndarray:
    """A float not above the square root of whole numbers."""
    x = np.asarray(squared).astype(float)
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(np.nextafter(x, -np.inf).clip(0)), -np.inf), -np.inf), 0.0)


def _root_up(squared: np.ndarray | int) -> np.ndarray:
    """A float not below the square root of whole numbers."""
    x = np.asarray(squared).astype(float)
    return np.nextafter(np.nextafter(np.sqrt(np.nextafter(x, np.inf)), np.inf), np.inf)


def build_tree(entries: list[list[int]]) -> Node | None:
    """The vantage-point tree over the entries of one part position."""

    def squared(a: int, b: int) -> int:
        return sum((x - y) ** 2 for x, y in zip(entries[a], entries[b], strict=True))

    def enclose(values: list[int]) -> tuple[float, float]:
        return (float(_root_down(min(values))), float(_root_up(max(values)))) if values else (0.0, 0.0)

    def grow(members: list[int]) -> Node | None:
        if not members:
            return None
        # the entry farthest from the first one has the widest spread of distances
        top = max(members, key=lambda i: (squared(members[0], i), -i))
        rest = [(squared(top, i), i) for i in members if i != top]
        cut = sorted(d for d, _ in rest)[(len(rest) - 1) // 2] if rest else 0
        near, far = [x for x in rest if x[0] <= cut], [x for x in rest if x[0] > cut]
        return Node(top, cut, grow([i for _, i in near]), enclose([d for d, _ in near]), grow([i for _, i in far]), enclose([d for d, _ in far]))

    return grow(list(range(len(entries))))


def nearest(values: np.ndarray, entries: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest entry (ties: the lowest number) of each row, and the distances computed.

    All rows walk the tree together, each into its nearer branch first.
    """
    who = np.full(len(values), len(entries), np.int64)
    best = np.full(len(values), -1, values.dtype)
    top = np.full(len(values), np.inf)  # not below the best distance
    seen = 0

    def may(rows: np.ndarray, low: np.ndarray, high: np.ndarray, reach: tuple[float, float]) -> np.ndarray:
        bound = np.maximum(np.nextafter(low - reach[1], -np.inf), np.nextafter(reach[0] - high, -np.inf))
        return bound <= top[rows]

    def visit(node: Node | None, rows: np.ndarray) -> None:
        nonlocal seen
        if node is None or not len(rows):
            return
        seen += len(rows)
        gap = values[rows] - entries[node.entry]
        d = (gap * gap).sum(axis=1)
        old, name = best[rows], who[rows]
        better = (name == len(entries)) | (d < old) | ((d == old) & (node.entry < name))
        won = rows[better]
        best[won], who[won], top[won] = d[better], node.entry, _root_up(d[better])
        low, high, inside = _root_down(d), _root_up(d), (d <= node.cut).astype(bool)
        branches = [(node.near, node.near_range), (node.far, node.far_range)]
        for first, order in ((inside, branches), (~inside, branches[::-1])):
            for branch, reach in order:
                if branch is not None:
                    go = first & may(rows, low, high, reach)
                    visit(branch, rows[go])

    visit(tree, np.arange(len(values)))
    return who, best, seen


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, padded with zeros to ``width``; Python integers where squares could exceed 64 bits."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dim = len(flat) // max(1, len(column))
    out = np.zeros((len(column), width), np.int64)
    out[:, :dim] = flat.reshape(len(column), dim)
    return out if width == 0 or int(np.abs(out.astype(float)).max(initial=0)) < 1 << 27 else out.astype(object)


def _assigner(book: Book) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(codes, squared distances) by row and part, of a matrix of whole vectors."""
    trees = [build_tree(entries) for entries in book]
    width = len(book[0][0])
    small = all(abs(x) < 1 << 27 for part in book for entry in part for x in entry)
    tables = [np.array(entries, np.int64 if small else object).reshape(len(entries), width) for entries in book]

    def assign(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = matrix if small and matrix.dtype != object else matrix.astype(object)
        found = [nearest(exact[:, p * width : (p + 1) * width], tables[p].astype(exact.dtype), trees[p])[:2] for p in range(len(book))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    return assign


def _partial_sums(book: Book) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each entry that a task's rows use: its slot, count and sums of components."""
    parts, entries, width = len(book), len(book[0]), len(book[0][0])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(book)
        count = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, width), object)
        for batch in batches:
            if not len(batch):
                continue
            matrix = _matrix(batch["__v"], parts * width)
            codes, _ = assign(matrix)
            for p in range(parts):
                count[p * entries : (p + 1) * entries] += np.bincount(codes[:, p], minlength=entries)
                here = np.zeros((entries, width), matrix.dtype)
                np.add.at(here, codes[:, p], matrix[:, p * width : (p + 1) * width])
                total[p * entries : (p + 1) * entries] += here.astype(object)
        used = np.flatnonzero(count)
        if len(used):
            columns = [pa.array([Decimal(int(x)) for x in total[used, i]], pa.decimal128(38, 0)) for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), *columns], ["slot", "n", *(f"s{i}" for i in range(width))])

    return sums


def _refined(rows: DataFrame, book: Book) -> Book:
    """One round: each entry becomes the floor of the mean of the parts assigned to it; unused ones stay."""
    entries, width = len(book[0]), len(book[0][0])
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(f"s{i}", T.DecimalType(38, 0)) for i in range(width))])
    sums = rows.select("__v").mapInArrow(_partial_sums(book), schema).groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))
    new = [[list(entry) for entry in part] for part in book]
    for r in sums.collect():  # at most one row for each entry of the codebooks
        new[r["slot"] // entries][r["slot"] % entries] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return new


class Codebooks(NamedTuple):
    """The fitted entries; a vector of ``dim`` components is padded with zeros to whole parts."""

    dim: int
    book: Book

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.book for entry in part for x in entry).encode()).hexdigest()


def usable(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vectors`` with the column __v of scaled whole components; rows without a finite, non-empty vector go."""
    return vectors.withColumn("__v", quantised(F.col(f"`{vector_col}`"), scale)).where(F.col("__v").isNotNull() & (F.size("__v") > 0))


def fit(rows: DataFrame, id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from ``usable`` rows; None if there are none.

    Starts with the rows of the smallest ids (nulls last; of one id, in the
    order of their components). Rows of another length than the first of these
    are left out.
    """
    order = [F.col(f"`{id_col}`").asc_nulls_last(), F.col("__v").asc()]
    first = rows.select(F.col(f"`{id_col}`"), "__v").orderBy(*order).limit(1).select("__v").first()
    if first is None:
        return None
    dim = len(first["__v"])
    width = -(-dim // parts)
    rows = rows.where(F.size("__v") == dim)
    start = rows.select(F.col(f"`{id_col}`"), "__v").orderBy(*order).limit(entries).select("__v").collect()
    padded = [list(r["__v"]) + [0] * (parts * width - dim) for r in start]
    book = [[v[p * width : (p + 1) * width] for v in padded] for p in range(parts)]
    for _ in range(rounds):
        book = _refined(rows, book)
    return Codebooks(dim, book)


def _encoder(model: Codebooks, code_col: str, error_col: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(model.book)
        digits = [f"{i:02x}" for i in range(len(model.book[0]))]
        for batch in batches:
            if not len(batch):
                continue
            codes, errors = assign(_matrix(batch["__v"], len(model.book) * len(model.book[0][0])))
            code = pa.array(["".join(digits[c] for c in row) for row in codes.tolist()], pa.string())
            error = pa.array([min(int(e), LONG_MAX) for e in errors.astype(object).sum(axis=1)], pa.int64())
            keep = [i for i, name in enumerate(batch.schema.names) if name != "__v"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), code, error], [*(batch.schema.names[i] for i in keep), code_col, error_col])

    return encode


def encode(rows: DataFrame, model: Codebooks, code_col: str = "__code", error_col: str = "__error") -> DataFrame:
    """``usable`` rows, without __v, with their code (two hex digits a part) and squared error.

    Rows whose vector has another length than the model's are left out. An
    error beyond a long is held at its end.
    """
    others = [c for c in rows.columns if c != "__v"]
    fields = [T.StructField(f"c{i}", rows.schema[c].dataType) for i, c in enumerate(others)]
    schema = T.StructType([*fields, T.StructField(code_col, T.StringType()), T.StructField(error_col, T.LongType())])
    # short names on the way, so that a column may have any name
    plain = rows.where(F.size("__v") == model.dim).select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), "__v")
    return plain.mapInArrow(_encoder(model, code_col, error_col), schema).toDF(*others, code_col, error_col)


def group_total(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal ``by`` (nulls together), held at the ends of a long.

    Sums meet their rows by a broadcast while there are few, else by a join that adaptive execution can split.
    """
    total = F.least(F.sum(F.col(f"`{value}`").cast("decimal(38,0)")), F.lit(Decimal(LONG_MAX))).cast("long")
    sums = stage(rows.groupBy(F.col(f"`{by}`").alias("__by")).agg(total.alias(out)), "group-sums")
    if sums.count() <= FEW_GROUPS:
        sums = F.broadcast(sums)
    return rows.join(sums, rows[f"`{by}`"].eqNullSafe(sums["__by"]), "left").drop("__by")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks | None]:
    """The rows of ``vectors`` with __code and __error in place of the vector, and the codebooks.

    Other columns stay under any names that do not start with two underscores.
    Dropped: rows whose vector is null, empty or holds null or non-finite
    components, or has another length than the kept vector of the smallest id.
    A length that ``parts`` doesn't divide is padded with zeros. Fewer kept
    rows than ``entries`` give as many entries. Rows with equal ids or vectors
    are rows of their own. Scaled components are held at the ends of a long; up
    to there all is exact. No rows: no rows and no codebooks.
    """
    rows = stage(usable(vectors, vector_col, scale).drop(vector_col), "vectors")
    model = fit(rows, id_col, parts, entries, rounds)
    if model is None:
        none = rows.drop("__v").limit(0)
        return none.select("*", F.lit("").alias("__code"), F.lit(0).cast("long").alias("__error")), None
    return encode(rows, model), model
