"""Benchmark decontamination: MinHash containment search with exact verification.

Items fall into classes by their number of shingles. An item that a text holds
to a share of ``threshold`` misses at most the floor of (1 - threshold) x size
of its shingles, so if the class keeps one more than that of the item's
smallest shingle hashes, at least one of them occurs in the text: the search
loses nothing. Candidates are verified by exact containment on the spot.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scatterlake.llm import kernels as K

WORDS = 5
THRESHOLD = 0.8
#: UTF-8 bytes of items searched for at once; more items make more passes.
BLOCK_BYTES = 8 << 20


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    """The distinct shingles: ``words`` consecutive words, A-Z lower-cased; of fewer, the whole sequence."""
    tokens = text.lower().split()
    if not tokens:
        return []
    n = max(1, len(tokens) - words + 1)
    return list(dict.fromkeys(b" ".join(tokens[i : i + words]) for i in range(n)))


def least_shared(size: int, threshold: float) -> int:
    """How many of ``size`` shingles make a share of ``threshold`` or more."""
    return max(1, math.ceil(size * threshold - 1e-9))


def shingle_hashes(piece: K.Slices, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, piece number, first byte, end byte) of each shingle of the lower-cased pieces, and those bytes."""
    buf = K.LOWER[piece.buf]
    begins, ends = K.spans(buf, piece.starts)
    tokens = K.span_hashes(buf, begins, ends)
    owner = K.piece_of(piece.starts, begins)
    h = K.gram_hashes(tokens, words)
    n = len(h)
    whole = owner[:n] == owner[words - 1 :] if n else np.zeros(0, bool)
    out = [h[whole], owner[:n][whole], begins[:n][whole], ends[words - 1 :][whole]]
    counts = np.bincount(owner, minlength=len(piece.rows))
    for size in range(1, words):  # rows of fewer words have one shingle, the whole sequence
        few = np.flatnonzero(counts == size)
        if len(few):
            at = np.searchsorted(owner, few)
            short = K.gram_hashes(tokens, size)[at] ^ K.U64(size)
            for k, more in enumerate((short, few, begins[at], ends[at + size - 1])):
                out[k] = np.concatenate([out[k], more])
    return (*out, buf)


@dataclass(frozen=True)
class Index:
    """Items by number, their signature hashes, and all their shingles' hashes."""

    ids: list
    texts: list[list[bytes]]
    needs: list[int]
    signature: np.ndarray
    items: dict[int, list[int]]
    members: np.ndarray


def size_class(size: int) -> int:
    """Classes end at powers of two; a class keeps what its largest size needs."""
    return 1 << (size - 1).bit_length()


def gram_list_hashes(grams: list[bytes], words: int) -> np.ndarray:
    """The hash of each shingle, taken as a text of its own."""
    ends = np.cumsum([len(g) for g in grams])
    piece = K.Slices(np.frombuffer(b"".join(grams), np.uint8), np.concatenate(([0], ends)), np.arange(len(grams)), np.zeros(len(grams), np.int64))
    h, owner, *_ = shingle_hashes(piece, words)
    out = np.zeros(len(grams), K.U64)
    out[owner] = h
    return out


def build_index(rows: list[tuple], words: int, threshold: float) -> Index:
    """Signatures of (id, text) rows, by size class."""
    ids, texts, needs, members = [], [], [], []
    items = defaultdict(list)
    for item_id, text in rows:
        grams = shingles((text or "").encode(), words)
        if not grams:
            continue
        top = size_class(len(grams))
        least = np.unique(gram_list_hashes(grams, words))
        for x in least[: top - least_shared(top, threshold) + 1].tolist():
            items[x].append(len(ids))
        members.append(least)
        ids.append(item_id)
        texts.append(grams)
        needs.append(least_shared(len(grams), threshold))
    every = np.unique(np.concatenate(members)) if members else np.zeros(0, K.U64)
    return Index(ids, texts, needs, np.array(sorted(items), K.U64), dict(items), every)


def _among(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)] == h


def search(piece: K.Slices, index: Index, words: int) -> Iterator[tuple[int, int, int]]:
    """(piece number, item number, shared shingles) of every piece that holds an item."""
    h, owner, begins, ends, buf = shingle_hashes(piece, words)
    if not len(h) or not len(index.signature):
        return
    hit = _among(index.signature, h)
    candidates = defaultdict(set)
    for x, o in zip(h[hit].tolist(), owner[hit].tolist(), strict=True):
        candidates[o].update(index.items[x])
    if not candidates:
        return
    have = defaultdict(set)
    for i in np.flatnonzero(_among(index.members, h)).tolist():
        if (o := int(owner[i])) in candidates:
            have[o].add(b" ".join(buf[begins[i] : ends[i]].tobytes().split()))
    for o, numbers in candidates.items():
        for i in sorted(numbers):
            shared = sum(g in have[o] for g in index.texts[i])
            if shared >= index.needs[i]:
                yield o, i, shared


def item_blocks(items: DataFrame, item_id_col: str, item_text_col: str, words: int, threshold: float, block_bytes: int) -> Iterator[Broadcast]:
    """Indexes of the items in blocks of about ``block_bytes`` of text, each broadcast by itself."""
    spark = items.sparkSession
    wanted = items.select(F.col(item_id_col).alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").isNotNull())
    blocks = max(1, math.ceil((wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect()
        yield spark.sparkContext.broadcast(build_index([(r["i"], r["t"]) for r in rows], words, threshold))


def without_items(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are, as ``contained_items`` finds them."""
    at = docs.columns.index(text_col)
    for sent in item_blocks(items, item_id_col, item_text_col, words, threshold, block_bytes):

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for piece in K.text_slices(batch.column(at)):
                    for o, _, _ in search(piece, sent.value, words):
                        clean[piece.rows[o]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(__id, __item, __shared, __size): each row of ``docs`` with each item that it holds.

    A row holds an item if it has ``threshold`` or more of the item's distinct
    shingles. Items are read in blocks of about ``block_bytes``, drawn by a hash
    of the text; each block is one broadcast of that size and one pass over
    ``docs`` without a shuffle. Items or rows without words never match. Null
    ids are kept; repeated rows and items each return their pairs.
    """
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    item_arrow = to_arrow_type(items.schema[item_id_col].dataType)
    id_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_id_col)))
    out = None
    for sent in item_blocks(items, item_id_col, item_text_col, words, threshold, block_bytes):

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                got = [
                    (int(piece.rows[o]), index.ids[i], shared, len(index.texts[i]))
                    for piece in K.text_slices(batch.column(1))
                    for o, i, shared in search(piece, index, words)
                ]
                if got:
                    at, item, shared, size = zip(*got, strict=True)
                    columns = [batch.column(0).take(pa.array(at)), pa.array(item, item_arrow), pa.array(shared, pa.int64()), pa.array(size, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["__id", "__item", "__shared", "__size"])

        found = source.mapInArrow(find, f"__id {id_type}, __item {item_type}, __shared long, __size long")
        out = found if out is None else out.union(found)
    return out
