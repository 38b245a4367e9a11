"""Toxicity scores: FTRL-proximal logistic regression over hashed word features.

Features are presence bits of hashed words, word pairs and skip-grams. Training
is sequential over a bounded sample of labelled rows, with per-coordinate rates
and L1 sparsity; scoring sends the few non-zero weights to the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from scatterlake.llm import kernels as K
from scatterlake.llm.common import discard_path, parts_for, stage, thinned

THRESHOLD = 0.3
#: The bounds of the training sample: labelled ids, and features of their texts together (four bytes each).
MAX_ROWS = 12_000
MAX_FEATURES = 16_000_000
#: Bytes of features that the driver fetches at once.
FETCHED = 8 << 20
BITS = 20


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 3
    bits: int = BITS
    skips: tuple[int, ...] = (2,)


def feature_rows(piece: K.Slices, bits: int, skips: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, with repeats: words, neighbouring words, and words ``skips`` apart."""
    buf = K.LOWER[piece.buf]
    begins, ends = K.spans(buf, piece.starts, K.PUNCTUATION)
    tokens = K.span_hashes(buf, begins, ends)
    owner = K.piece_of(piece.starts, begins)
    found, rows = [tokens], [owner]
    for gap in (1, *skips):
        if len(tokens) > gap:
            same = owner[:-gap] == owner[gap:]
            joint = K.mix(tokens[:-gap] * K.U64(2 * gap + 1) + (tokens[gap:] ^ K.U64(K.MIX[gap % 2])))
            found.append(joint[same])
            rows.append(owner[:-gap][same])
    # the sign-free hash trick: the top bits are the best mixed
    return piece.rows[np.concatenate(rows)], (np.concatenate(found) >> K.U64(64 - bits)).astype(np.int64)


def batch_features(column: pa.Array, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for piece in K.text_slices(column):
        yield feature_rows(piece, settings.bits, settings.skips)


class Ftrl:
    """McMahan et al. (2013): w_i = 0 if |z_i| <= l1, else a closed form of z_i and n_i."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros((1 << settings.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)  # the intercept isn't shrunk
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def update(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-min(35.0, max(-35.0, w.sum())))) - label
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] += g * g


@dataclass(frozen=True)
class Model:
    """The non-zero weights, by feature, and the intercept."""

    features: np.ndarray
    values: np.ndarray
    intercept: float
    settings: Settings

    @property
    def trained(self) -> bool:
        return bool(len(self.features)) or self.intercept != 0


def gathered(rows: DataFrame, n: int) -> tuple[np.ndarray, list[tuple]]:
    """The ``n`` features of (o, i, y, x) rows in one array, and (o, i, y, size, first features, place) of each row.

    A few MB of rows come at a time: neither the driver's JVM nor Python holds
    them all beside the array.
    """
    flat, keys, at = np.empty(n, np.int32), [], 0
    for o, i, y, packed in rows.coalesce(parts_for(4 * n, FETCHED)).toLocalIterator():
        x = np.frombuffer(packed, "<i4")
        flat[at : at + len(x)] = x
        keys.append((o, i, y, len(x), x[:16].tobytes(), at))
        at += len(x)
    return flat[:at], keys


def occurrences(flat: np.ndarray, n: int) -> np.ndarray:
    """How often each of 0..n-1 occurs; in pieces, as numpy widens what it counts to eight bytes."""
    seen = np.zeros(n, np.int64)
    for a in range(0, len(flat), n):
        seen += np.bincount(flat[a : a + n], minlength=n)
    return seen


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    settings: Settings = Settings(),
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
) -> Model:
    """A model from the texts of at most ``max_rows`` labelled ids.

    Whole texts teach. The ids are taken in their order until their texts have
    ``max_features`` features together, so that very long texts can't fill the
    driver; no id is taken in part.

    Ids of ``labels`` that are not held out and whose label is 0 or 1 are drawn
    and ordered by a hash of the id: a top-k over all of them, whatever their
    partitions. Only the drawn ids, a bounded number, are sent to the texts.
    An id with several labels or texts teaches each of them; null ids, other
    labels and texts without a word teach nothing, repeated rows teach again.
    Without any row, as with empty tables, the model scores one half everywhere.
    """
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    drawn = thinned(known.withColumn("o", F.xxhash64(F.lit(7), F.col("i"))), "o", max_rows).orderBy("o", "i", "y").limit(max_rows).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__t"))
    sample = texts.join(F.broadcast(drawn), F.col("__id") == F.col("i")).select("o", "i", "y", "__t")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [b""] * batch.num_rows
            for rows_, feats in batch_features(batch.column(3), settings):
                # a text lies in one piece, so its features come together
                pairs = np.unique((rows_ << settings.bits) | feats)
                of = pairs >> settings.bits
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(of)).tolist(), strict=True):
                    packed[of[a]] = (pairs[a:b] & ((1 << settings.bits) - 1)).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], ["o", "i", "y", "x"])

    found = stage(sample.mapInArrow(extract, "o long, i long, y int, x binary"), "toxicity-sample")
    # one row for each drawn hash, max_rows at most
    sizes = found.groupBy("o").agg(F.sum(F.octet_length("x") / 4).alias("n")).orderBy("o").collect()
    total = np.cumsum([r["n"] for r in sizes])
    fits = int(np.searchsorted(total, max_features, "right"))
    last = 1 << settings.bits
    ftrl = Ftrl(settings)
    if fits:
        n = int(total[fits - 1])
        flat, keys = gathered(found.where(F.col("o") <= sizes[fits - 1]["o"]), n)
        seen = occurrences(flat, last)
        # a feature's sum of gradients moves by at most one an example: those that
        # can't pass the L1 bound in all epochs have no weight and are left out
        can = seen * settings.epochs > settings.l1
        examples, end = [], 0
        for o, i, y, size, first, at in keys:  # in place: what stays is never longer than what was read
            x = flat[at : at + size]
            x = x[can[x]]
            flat[end : end + len(x)] = x
            examples.append((o, i, y, size, first, end, end + len(x)))
            end += len(x)
        # rows of one id and label in the order of their features, whatever the partitions
        examples.sort()
        for _ in range(settings.epochs):
            for _, _, y, size, _, a, b in examples:
                if size:
                    ftrl.update(np.append(flat[a:b], np.int32(last)), y)
        del flat
    discard_path(found)
    every = ftrl.weights(np.arange(last + 1))
    kept = np.flatnonzero(every[:last])
    return Model(kept.astype(np.int32), every[kept].astype(np.float32), float(every[last]), settings)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "__score") -> DataFrame:
    """``docs`` with the probability of the label 1 in ``out_col``.

    Whole texts are read. A feature counts once per text. Null and empty texts
    get the score of the intercept; repeated rows each get theirs. No rows: no
    rows. All columns stay; an input column named ``out_col`` is replaced.
    """
    spark, docs = docs.sparkSession, docs.drop(out_col)
    sent = spark.sparkContext.broadcast(model)  # at most 2^bits weights
    schema = docs.schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights = np.zeros(1 << m.settings.bits, np.float32)
        weights[m.features] = m.values
        for batch in batches:
            total = np.full(batch.num_rows, m.intercept)
            for rows, feats in batch_features(batch.column(schema.fieldNames().index(text_col)), m.settings):
                hit = weights[feats] != 0
                pairs = np.unique((rows[hit] << m.settings.bits) | feats[hit])
                np.add.at(total, pairs >> m.settings.bits, weights[pairs & ((1 << m.settings.bits) - 1)])
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(apply, StructType([*schema.fields]).add(out_col, DoubleType()))


def held_out(id_col: Column) -> Column:
    """Whether a row's label is held out: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
