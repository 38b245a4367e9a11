"""SimHash near-dedup over deletion-variant signatures.

Fingerprints of 64 bits are cut into two halves: of two fingerprints at three
or fewer differing bits, one half differs by at most one bit. Each half is
indexed under its 32 one-wildcard variants, equal keys meet by an equality
shuffle, and pairs are verified there. Copies collapse first: the index holds
distinct fingerprints, never documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scatterlake.llm.common import fresh_name, keep_only, parts_for, scope, stage
from scatterlake.llm.components import components

SEED = 42
WORDS = 3
MAX_BITS = 3
#: Shingles whose bits are counted at once, and keys in one index partition.
SLICE = 1 << 16
KEYS_EACH = 2_000_000
#: Above this size a bucket is searched by enumerating variants, not pairs.
WIDE = 60_000


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    if not text:
        return 0
    tokens = text.lower().split()  # ASCII: A-Z, and blank, \t to \r
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return xxh64_intdigest(joined, SEED)
    after = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *after[: len(tokens) - words]]
    shingles = [joined[a : b - 1] for a, b in zip(starts, after[words - 1 :], strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), SLICE):
        part = shingles[i : i + SLICE]
        h = np.fromiter(map(xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = (counts * 2 > len(shingles)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(__id, __text_hash, __fp): one row per row of ``docs``; fingerprints as signed longs."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([fingerprint(t, words) for t in (x.as_py() for x in texts)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["__id", "__text_hash", "__fp"])

    source = docs.select(
        F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"), text_hash(text_col).alias("__text_hash")
    )
    return source.mapInArrow(compute, "__id long, __text_hash long, __fp long")


class _Forest:
    """Union-find over 0..n-1 with flat labels between rounds."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        differ = self.root[i] != self.root[j]
        if not differ.any():
            return
        for a, b in zip(i[differ].tolist(), j[differ].tolist(), strict=True):
            x, y = self._find(a), self._find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.links.append((a, b))
        while not np.array_equal(flat := self.root[self.root], self.root):
            self.root = flat


def _meet_first(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether differing bits ``x`` have ``key`` as the first variant they share."""
    hi, lo = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    one_hi, one_lo = np.bitwise_count(hi) <= 1, np.bitwise_count(lo) <= 1
    bit = lambda v: np.where(v == 0, 0, np.bitwise_count(v - np.uint64(1)))
    first = np.where(one_hi, bit(hi), np.where(one_lo, 32 + bit(lo), 64))
    return first == key


def _variants(wild: int) -> np.ndarray:
    """All XOR masks of one to three bits that keep a pair in the bucket of ``wild``."""
    free = [np.uint64(1) << np.uint64(b) for b in (range(32) if wild < 32 else range(32, 64))]
    free.append(np.uint64(1) << np.uint64(32 + wild if wild < 32 else wild - 32))
    masks = [0]
    for _ in range(MAX_BITS):
        masks = sorted({int(m | f) for m in masks for f in free} | set(masks))
    return np.array(masks[1:], np.uint64)


def bucket_links(keys: np.ndarray, fps: np.ndarray, wide: int = WIDE) -> list[tuple[int, int]]:
    """Spanning links of the verified pairs within runs of equal keys.

    Pairs at one to three differing bits, each judged in the first bucket it
    shares. Runs of up to ``wide`` fingerprints compare all pairs in slices;
    longer ones look up the 6,017 variants of each fingerprint, so the work
    stays linear. Nothing is capped.
    """
    fps = fps.view(np.uint64)  # unsigned order, as the look-ups below need it
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    n = len(keys)
    if n < 2:
        return []
    new = np.flatnonzero(np.diff(keys)) + 1
    ends = np.repeat(np.append(new, n), np.diff(np.concatenate(([0], new, [n]))))
    starts = np.concatenate(([0], new))
    lengths = np.diff(np.append(starts, n))
    forest = _Forest(n)
    wild = keys >> 32
    big = lengths > wide
    at = np.flatnonzero(np.repeat(~big, lengths) & (ends - np.arange(n) > 1))
    d = 1
    while len(at):
        at = at[at + d < ends[at]]
        x = fps[at] ^ fps[at + d]
        near = at[(np.bitwise_count(x) <= MAX_BITS)]
        if len(near):
            near = near[_meet_first(fps[near] ^ fps[near + d], wild[near])]
            forest.join(near, near + d)
        d += 1
    for s, size in zip(starts[big].tolist(), lengths[big].tolist(), strict=True):
        run = fps[s : s + size]
        for mask in _variants(int(wild[s])):
            other = run ^ mask
            found = np.searchsorted(run, other)
            hit = np.flatnonzero((other > run) & (run[np.minimum(found, size - 1)] == other))
            if len(hit):
                hit = hit[_meet_first(np.full(len(hit), mask), np.full(len(hit), wild[s]))]
                forest.join(s + hit, s + found[hit])
    signed = fps.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in forest.links]


def fingerprint_links(distinct_fps: DataFrame, fp_col: str, n_fps: int, keys_each: int = KEYS_EACH) -> DataFrame:
    """(a, b): links between different fingerprints that span their components."""
    fp = F.col("fp")
    wild = F.col("wild")
    half = F.when(wild < 32, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    bit = F.expr("shiftleft(1L, wild % 32)")
    key = F.expr("shiftleft(CAST(wild AS BIGINT), 32)").bitwiseOR(half.bitwiseAND(F.bitwise_not(bit)))
    rows = (
        distinct_fps.select(F.col(fp_col).alias("fp"))
        .withColumn("wild", F.explode(F.sequence(F.lit(0), F.lit(63))))
        .select(key.alias("key"), "fp")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            found = bucket_links(np.concatenate([k for k, _ in got]), np.concatenate([f for _, f in got]))
            a, b = ([x[i] for x in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts_for(64 * n_fps, keys_each, spread), "key").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(__id, __text_hash, __fp, __class, __component): the SimHash and near-duplicate class of every row.

    A-Z are lower-cased, words are runs of anything but ASCII blanks, shingles
    are ``words`` consecutive words with repeats (fewer words: the whole
    sequence). Fingerprints link at three or fewer differing bits; a class is
    named by the smallest id reachable over links.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Repeated rows and ids each return a row. A null id takes part, but
    names no class unless all ids of the class are null. No rows: no rows.
    """
    fps = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stage(fps.groupBy("__fp").agg(F.min("__id").alias("least")), "distinct-fps")
    links = fingerprint_links(distinct, "__fp", distinct.count())
    roots = components(links, "a", "b")
    labelled = distinct.join(roots, distinct["__fp"] == roots["node"], "left").select(
        "__fp", "least", F.coalesce("root", "__fp").alias("root")
    )
    # written, so that the join can split a class that a third of all fingerprints share
    least = stage(labelled.groupBy("root").agg(F.min("least").alias("__component")), "class-names")
    classes = labelled.join(least, "root").select("__fp", F.col("root").alias("__class"), "__component")
    return fps.join(classes, "__fp").select("__id", "__text_hash", "__fp", "__class", "__component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, classes_of=near_duplicates) -> DataFrame:
    """``docs`` with one row of each class of ``classes_of``: that of the smallest id, null ids last.

    Of rows with the same id the one with the smaller text hash stays, of
    equal rows one. All columns of the row stay as they are.
    """
    with scope() as made:
        classes = stage(classes_of(docs, id_col, text_col, words), "classes")
        keep_only(made, classes)
    first = classes.groupBy("__class").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__text_hash")).alias("k"))
    chosen = first.select(F.col("k.__id").alias("__kid"), F.col("k.__text_hash").alias("__khash"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__kid")) & (text_hash(text_col) == F.col("__khash"))
    kept = docs.join(chosen.hint("shuffle_hash"), same, "left_semi")
    repeated = classes.groupBy("__id", "__text_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if repeated.isEmpty():
        return kept
    # only rows that are equal in id and text can be left double
    number = Window.partitionBy(F.col(id_col), text_hash(text_col)).orderBy(F.lit(0))
    n = fresh_name(kept, "__n")
    return kept.withColumn(n, F.row_number().over(number)).where(F.col(n) == 1).drop(n)
