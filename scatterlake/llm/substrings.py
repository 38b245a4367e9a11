"""Suffix-array dedup: bytes under strings that start in an earlier document go.

Which segments of different blocks are equal, and which windows of different
segments, is read from sorted order: multikey quicksort, then blind tries. A
block tells copies within itself by their text before it reports them once.
Rows whose whole text stands in an earlier document take no part in that: they
lose everything, and no other row loses a byte to them alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.llm import repeats as R
from scatterlake.llm.common import stage
from scatterlake.llm.suffixes import sort_suffixes, sorted_names

ALPHABET = R.Bytes()


def judge(segments: list[bytes], lead: np.ndarray, doc: np.ndarray, start: np.ndarray, alphabet: R.Bytes = ALPHABET) -> np.ndarray:
    """Masks of the windows that some other segment holds for a smaller document.

    Equal windows have equal minimizers, so only segments that share theirs
    with another one are sorted.
    """
    mask = np.zeros(len(segments), np.uint64)
    grams = defaultdict(list)
    for i, (text, at) in enumerate(zip(segments, lead.tolist(), strict=True)):
        if at != R.ALONE:
            grams[text[at : at + alphabet.k]].append(i)
    several = np.array([i for g in grams.values() if len(g) > 1 for i in g], np.int64)
    if not len(several):
        return mask
    sizes = np.array([len(segments[i]) for i in several.tolist()])
    offsets = np.cumsum(sizes) - sizes
    windows = sizes - (alphabet.window - 1)
    of = np.repeat(np.arange(len(several)), windows)
    place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, group = sort_suffixes(b"".join(segments[i] for i in several.tolist()), offsets[of] + place, alphabet.window)
    own = doc[several][of][order]
    least = np.minimum.reduceat(own, np.flatnonzero(np.diff(group, prepend=-1)))
    gone = order[own > least[group]]
    np.add.at(mask, several[of[gone]], np.uint64(1) << place[gone].astype(np.uint64))
    return mask


def gone_intervals(row: np.ndarray, start: np.ndarray, count: np.ndarray, later: np.ndarray, masked: np.ndarray, mask: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the symbols under the runs in ``later``, and under the windows in the ``mask`` of those in ``masked``."""
    rows, first, last = [row[later]], [start[later]], [start[later] + count[later] + (window - 1)]
    at = np.flatnonzero(masked)
    bits = mask[at]
    for o in range(64):
        hit = at[(bits >> np.uint64(o)) & np.uint64(1) == 1]
        if len(hit):
            rows.append(row[hit])
            first.append(start[hit] + o)
            last.append(start[hit] + o + window)
    return np.concatenate(rows), np.concatenate(first), np.concatenate(last)


def merge_by_row(row: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of each row, in order of the rows."""
    base = np.cumsum(sizes + 1) - (sizes + 1)  # a gap keeps rows apart
    a, b = R.union_of(first + base[row], last + base[row])
    of = np.searchsorted(base, a, "right") - 1
    return of, a - base[of], b - base[of]


def marked_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __text, __copy): every row, with whether a smaller id has the very same text, told by its SHA-256."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text"))
    rows = rows.select("*", F.coalesce("__id", F.lit(R.NO_ID)).alias("__order"), F.unhex(F.sha2("__text", 256)).alias("__hash"))
    several = rows.groupBy("__hash").agg(F.min("__order").alias("__first"), F.max("__order").alias("__last")).where("__first < __last")
    several = stage(several.select("__hash", "__first"), "repeat-copies")
    # never broadcast: hashes that repeat grow with the rows, and a plan that changes with the size has costs that can't be carried on
    return rows.join(several.hint("merge"), "__hash", "left").select("__id", "__text", F.coalesce(F.col("__order") > F.col("__first"), F.lit(False)).alias("__copy"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = R.BLOCK_BYTES, hot_blocks: int = R.HOT_BLOCKS) -> DataFrame:
    """(__id, __kept, __n_bytes, __spans): every row without the bytes that an earlier document has.

    A byte goes if a string of ``window`` bytes over it also starts in a row
    with a smaller id; strings are judged on the input and never cross rows.
    ``__kept`` holds the remaining bytes, ``__spans`` the maximal removed runs
    as (start, end), end exclusive.

    Null text: empty. Rows with the same id are one document's in that neither
    loses bytes to the other. Null ids come after all others and are equal.
    Texts shorter than ``window`` stay whole. No rows: no rows. ``window`` is
    at most 81. Other columns of ``docs`` are not read.
    """
    alphabet = R.Bytes(window, min(18, window))

    def judged(*given):
        return judge(*given, alphabet=alphabet)

    def apply(block: R.Block, doc: np.ndarray, start: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = block.orders()[block.row]
        later = own > doc[block.segment]
        sizes = np.array([len(t) for t in block.texts], np.int64)
        of, a, b = merge_by_row(*gone_intervals(block.row, block.first, block.count, later, ~later & (mask[block.segment] != 0), mask[block.segment], window), sizes)
        cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
        kept = []
        for i, text in enumerate(block.texts):
            if cuts[i] == cuts[i + 1]:
                kept.append(text)
                continue
            parts, at = [], 0
            for x, y in zip(a[cuts[i] : cuts[i + 1]].tolist(), b[cuts[i] : cuts[i + 1]].tolist(), strict=True):
                parts.append(text[at:x])
                at = y
            kept.append(b"".join([*parts, text[at:]]))
        spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids, pa.int64()), pa.array(kept, pa.binary()), pa.array(sizes), spans], ["__id", "__kept", "__n_bytes", "__spans"]
        )

    schema = "__id long, __kept binary, __n_bytes long, __spans array<struct<start: long, end: long>>"
    rows = stage(marked_copies(docs, id_col, text_col), "repeat-rows")
    spans_type = "array<struct<start: long, end: long>>"
    n = F.octet_length("__text").cast("long")
    gone = n >= window
    copies = rows.where("__copy").select(
        "__id",
        F.when(gone, F.lit(b"")).otherwise(F.col("__text")).alias("__kept"),
        n.alias("__n_bytes"),
        F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))).otherwise(F.array().cast(spans_type)).cast(spans_type).alias("__spans"),
    )
    first = R.exchange(rows.where("NOT __copy"), "__id", "__text", alphabet, judged, apply, schema, block_bytes, hot_blocks, names=sorted_names)
    return first.unionByName(copies)
