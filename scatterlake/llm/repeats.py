"""What byte strings and word passages share: the exchange under both repeat removers.

A window is a fixed number of symbols (bytes or words). The minimizer of a
window is the least of its k-gram hashes, so equal windows have equal minimizers
at equal places. Four steps, none of which ships a window by itself:

1. every text block reports its minimizers; those that occur twice survive;
2. blocks cut the runs of windows under a surviving minimizer into segments
   and report each distinct segment with its first occurrence;
3. shards of segments judge, for each segment, which of its windows occur
   earlier;
4. blocks apply the verdicts: to the runs that they cut again, or, if the
   verdicts carry the passages, to the places where these are found anew.

Rows move as compressed blobs, one for each pair of block and shard. Copies of a
passage cost each block one entry, however many they are. A minimizer that very
many blocks hold may stand in as many different surroundings: its windows are
then reported one by one and dealt by a hash of the whole window, so no shard
gathers the surroundings of a passage that a third of all rows share.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.llm import kernels as K
from scatterlake.llm.common import parts_for, text_bytes

#: UTF-8 bytes of text in one block, and minimizers gathered before they are sent.
BLOCK_BYTES = 16 << 20
FLUSH = 4_000_000
#: A minimizer in so many blocks is dealt by whole windows; the mark of its keys, and the place given for its segments.
HOT_BLOCKS = 256
HOT = np.uint64(1 << 63)
ALONE = -1
#: Ids that are null come after all others.
NO_ID = np.iinfo(np.int64).max

DOCS, KEYS, VERDICTS = 2, 0, 1
BLOB = "block int, kind int, bucket int, payload binary"


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def squeeze_array(values: np.ndarray) -> bytes:
    """Sorted or similar 64-bit values, byte planes together."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze_array(data: bytes, dtype=np.uint64) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(dtype).ravel()


@dataclass(frozen=True)
class Runs:
    """Runs of windows under one minimizer, in one group of texts: arrays by run."""

    row: np.ndarray  # row of the batch
    first: np.ndarray  # first window's start, in symbols of the whole text
    count: np.ndarray  # windows
    lead: np.ndarray  # place of the minimizer after that start
    gram: np.ndarray  # hash of the minimizer
    texts: Callable[[np.ndarray], list[bytes]]  # canonical bytes of the chosen runs


def find_runs(hashes: np.ndarray, owner: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, minimizer place) of each run, in symbols of the group."""
    n = len(owner) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    least = K.minimizers(hashes, window - k + 1)
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    least = least[at]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(least) != 0) | (np.diff(at) != 1)))) if len(at) else at
    return at[new], np.diff(np.append(new, len(at))), least[new]


class Alphabet:
    """How texts become symbols. ``window`` symbols match; ``k`` of them make a gram."""

    window: int
    k: int

    def runs(self, column: pa.Array) -> Iterator[Runs]:
        raise NotImplementedError

    def windows(self, text: bytes) -> list[bytes]:
        """The windows of a run's canonical bytes."""
        raise NotImplementedError


@dataclass(frozen=True)
class Bytes(Alphabet):
    window: int = 50
    k: int = 18

    def windows(self, text: bytes) -> list[bytes]:
        return [text[o : o + self.window] for o in range(len(text) - self.window + 1)]

    def runs(self, column: pa.Array) -> Iterator[Runs]:
        for piece in K.text_slices(column, overlap=self.window - 1):
            hashes = K.byte_gram_hashes(piece.buf, self.k)
            owner = np.repeat(np.arange(len(piece.rows)), np.diff(piece.starts))
            first, count, place = find_runs(hashes, owner, self.window, self.k)
            of = owner[first]

            def texts(which, first=first, count=count, buf=piece.buf):
                data = buf.tobytes()
                ends = first + count + (self.window - 1)
                return [data[a:b] for a, b in zip(first[which].tolist(), ends[which].tolist(), strict=True)]

            yield Runs(piece.rows[of], first - piece.starts[of] + piece.skips[of], count, place - first, hashes[place], texts)


@dataclass(frozen=True)
class Words(Alphabet):
    window: int = 20
    k: int = 6

    def windows(self, text: bytes) -> list[bytes]:
        words = text.split(b" ")
        return [b" ".join(words[o : o + self.window]) for o in range(len(words) - self.window + 1)]

    def runs(self, column: pa.Array) -> Iterator[Runs]:
        for piece in K.text_slices(column):
            begins, ends = K.spans(piece.buf, piece.starts)
            hashes = K.gram_hashes(K.span_hashes(piece.buf, begins, ends), self.k)
            owner = K.piece_of(piece.starts, begins)
            first, count, place = find_runs(hashes, owner, self.window, self.k)
            of = owner[first]
            before = np.searchsorted(owner, np.arange(len(piece.rows)))  # words of the group before each text

            def texts(which, first=first, count=count, buf=piece.buf, begins=begins, ends=ends):
                data = buf.tobytes()
                a = begins[first[which]]
                b = ends[first[which] + count[which] + (self.window - 2)]
                return [b" ".join(data[x:y].split()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]

            yield Runs(piece.rows[of], first - before[of], count, place - first, hashes[place], texts)


def gram_keys(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the upper, further bits of the hash in the lower half."""
    return ((grams % K.U64(buckets)) << K.U64(32)) | (grams >> K.U64(32))


def at_most_twice(values: np.ndarray) -> np.ndarray:
    """Sorted values without their third and further copies."""
    keep = np.ones(len(values), bool)
    keep[2:] = values[2:] != values[:-2]
    return values[keep]


def by_bucket(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted keys."""
    buckets = (keys >> K.U64(32)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)])) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(buckets[a]), slice(a, b)


def groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows by equal values of a column by which the partition is sorted."""
    from itertools import groupby

    def rows():
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in columns)

    yield from groupby(rows(), key=lambda r: r[column])


@dataclass(frozen=True)
class Plan:
    """Counts of blocks and buckets, both in proportion to the bytes of text."""

    blocks: int
    buckets: int
    hot_blocks: int = HOT_BLOCKS

    @staticmethod
    def of(docs: DataFrame, text_col: str, block_bytes: int, hot_blocks: int) -> "Plan":
        spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = parts_for(text_bytes(docs, text_col), block_bytes, spread)
        return Plan(n, n, hot_blocks)


def keyed_docs(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """(__block, __id, __text): the block of a row depends on its content alone."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(plan.blocks)).cast("int").alias("__block"),
        F.col(id_col).cast("long").alias("__id"),
        text.alias("__text"),
    )


def surviving_keys(rows: DataFrame, alphabet: Alphabet, plan: Plan) -> DataFrame:
    """Blobs (block, KEYS, bucket, keys): a block's minimizers that occur twice anywhere."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in held])
            blocks = np.concatenate([b for _, b in held])
            order = np.lexsort((blocks, keys))
            keys, blocks = keys[order], blocks[order]
            out = []
            for bucket, at in by_bucket(keys):
                entries = ((keys[at] & K.U64(0xFFFFFFFF)) << K.U64(32)) | blocks[at].astype(K.U64)
                out.append((bucket, squeeze_array(at_most_twice(entries))))
            if out:
                b, p = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.binary())], ["bucket", "payload"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            for runs in alphabet.runs(batch.column(2)):
                held.append((gram_keys(runs.gram, plan.buckets), block[runs.row]))
                size += len(runs.gram)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows_ in groups(batches, 0):
            entries = np.sort(np.concatenate([unsqueeze_array(r[1]) for r in rows_]))
            key = entries >> K.U64(32)
            twice = np.zeros(len(key), bool)
            same = key[1:] == key[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            entries = np.unique(entries[twice])
            block = (entries & K.U64(0xFFFFFFFF)).astype(np.int64)
            entries = (entries >> K.U64(32)) | K.U64(bucket << 32)
            _, of, blocks = np.unique(entries, return_inverse=True, return_counts=True)
            entries = np.where(blocks[of] >= plan.hot_blocks, entries | HOT, entries)
            order = np.argsort(block, kind="stable")
            block, entries = block[order], entries[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            payload = [squeeze_array(x) for x in np.split(entries, cuts[1:])] if len(block) else []
            yield blob_batch(block[cuts].tolist() if len(block) else [], KEYS, bucket, payload)

    sent = rows.mapInArrow(report, "bucket int, payload binary")
    return sent.repartitionById(plan.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(survive, BLOB)


def blob_batch(block: list[int], kind: int, bucket: int | list[int], payload: list[bytes]) -> pa.RecordBatch:
    n = len(block)
    bucket = [bucket] * n if isinstance(bucket, int) else bucket
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())],
        ["block", "kind", "bucket", "payload"],
    )


def doc_blobs(rows: DataFrame) -> DataFrame:
    """Blobs (block, DOCS, 0, texts): the texts of a batch by block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            numbers, payload = [], []
            for b in np.unique(block).tolist():
                at = pa.array(np.flatnonzero(block == b))
                ids, texts = batch.column(1).take(at).to_pylist(), batch.column(2).take(at).to_pylist()
                for i in range(0, len(ids), 4096):
                    numbers.append(b)
                    payload.append(squeeze(pickle.dumps((ids[i : i + 4096], texts[i : i + 4096]), 5)))
                    if len(payload) >= 64:
                        yield blob_batch(numbers, DOCS, 0, payload)
                        numbers, payload = [], []
            if payload:
                yield blob_batch(numbers, DOCS, 0, payload)

    return rows.mapInArrow(pack, BLOB)


def by_block(blobs: DataFrame, plan: Plan) -> DataFrame:
    return blobs.repartitionById(plan.blocks, "block").sortWithinPartitions("block", "kind", "bucket")


@dataclass
class Block:
    """One block: its rows, and the runs under surviving minimizers by segment."""

    ids: list
    texts: list[bytes]
    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    segment: np.ndarray  # number in ``segments``
    segments: list[bytes]
    bucket: np.ndarray  # by segment
    lead: np.ndarray  # by segment

    def orders(self) -> np.ndarray:
        return np.array([NO_ID if i is None else i for i in self.ids], np.int64)


def read_block(rows: Iterator[tuple], alphabet: Alphabet, plan: Plan) -> tuple[Block, dict[int, bytes]]:
    """The block of sorted blobs, and the verdicts by bucket that came with them."""
    from xxhash import xxh64_intdigest

    keys, verdicts, ids, texts, parts = [], {}, [], [], []
    known = None
    number: dict[bytes, int] = {}
    bucket, lead = [], []
    for _, kind, b, payload in rows:
        if kind == KEYS:
            keys.append(unsqueeze_array(payload))
        elif kind == VERDICTS:
            verdicts[b] = payload
        else:
            if known is None:
                known = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                hot = (known & HOT) != 0
                known = known & ~HOT
                order = np.argsort(known)
                known, hot = known[order], hot[order]
            some_ids, some_texts = pickle.loads(unsqueeze(payload))
            base = len(ids)
            ids += some_ids
            texts += some_texts
            if not len(known):
                continue
            for runs in alphabet.runs(pa.array(some_texts, pa.large_binary())):
                k = gram_keys(runs.gram, plan.buckets)
                place = np.minimum(np.searchsorted(known, k), len(known) - 1)
                alike = known[place] == k
                lone = np.flatnonzero(alike & hot[place])
                for j, text in zip(lone.tolist(), runs.texts(lone), strict=True):
                    windows = alphabet.windows(text)
                    found = np.empty(len(windows), np.int64)
                    for o, part in enumerate(windows):
                        n = number.get(part)
                        if n is None:
                            n = number[part] = len(number)
                            bucket.append(xxh64_intdigest(part) % plan.buckets)
                            lead.append(ALONE)
                        found[o] = n
                    many = len(windows)
                    parts.append((np.full(many, runs.row[j] + base), runs.first[j] + np.arange(many), np.ones(many, np.int64), found))
                which = np.flatnonzero(alike & ~hot[place])
                if not len(which):
                    continue
                found = np.empty(len(which), np.int64)
                of_bucket, of_lead = (k[which] >> K.U64(32)).tolist(), runs.lead[which].tolist()
                for j, text in enumerate(runs.texts(which)):
                    n = number.get(text)
                    if n is None:
                        n = number[text] = len(number)
                        bucket.append(of_bucket[j])
                        lead.append(of_lead[j])
                    found[j] = n
                parts.append((runs.row[which] + base, runs.first[which], runs.count[which], found))
    joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
    return Block(ids, texts, *joined, list(number), np.array(bucket, np.int64), np.array(lead, np.int64)), verdicts


def in_order(block: Block) -> Iterator[tuple[int, list[int]]]:
    """(bucket, segment numbers in byte order): the same for the same set of texts."""
    order = sorted(range(len(block.segments)), key=lambda i: (block.bucket[i], block.segments[i]))
    buckets = block.bucket[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(buckets)) + 1, [len(order)])) if order else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(buckets[a]), order[a:b]


def first_places(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start) of each segment's first occurrence in the block, and whether it has others there."""
    n = len(block.segments)
    order = block.orders()[block.row] if len(block.row) else np.zeros(0, np.int64)
    at = np.lexsort((block.first, order, block.segment))
    lead = np.flatnonzero(np.diff(block.segment[at], prepend=-1))
    doc, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    doc[block.segment[at][lead]] = order[at][lead]
    start[block.segment[at][lead]] = block.first[at][lead]
    return doc, start, np.bincount(block.segment, minlength=n) > 1


def report_segments(blobs: DataFrame, alphabet: Alphabet, plan: Plan) -> DataFrame:
    """Blobs (block, 0, bucket, segments) of every block's distinct segments."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in groups(batches, 0):
            block, _ = read_block(rows, alphabet, plan)
            doc, start, again = first_places(block)
            buckets, payload = [], []
            for bucket, which in in_order(block):
                buckets.append(bucket)
                segments = [block.segments[i] for i in which]
                payload.append(squeeze(pickle.dumps((segments, block.lead[which].astype(np.int16), doc[which], start[which], again[which]), 5)))
                if len(payload) >= 64:
                    yield blob_batch([number] * len(payload), 0, buckets, payload)
                    buckets, payload = [], []
            if payload:
                yield blob_batch([number] * len(payload), 0, buckets, payload)

    return by_block(blobs, plan).mapInArrow(report, BLOB)


Judge = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def seen_names(texts: list[bytes]) -> np.ndarray:
    """The number of each text among the distinct ones, in the order in which they come."""
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(t, len(number)) for t in texts], np.int64)


def verdicts(segments: DataFrame, judge: Judge, plan: Plan, carry: bool, names: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Blobs (block, VERDICTS, bucket, (order, start, mask)) aligned with the block's report.

    With ``carry`` they hold (passages, order, start, mask) instead, and only
    those of the block's passages that it must lose somewhere.

    ``names`` tells equal segments of different blocks, as numbers from 0.
    ``judge`` gets distinct segments, their minimizer places and their first
    occurrences, and returns a mask of the windows that occur earlier elsewhere.
    Segments placed ALONE are single windows that no other segment holds.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches, 2):
            every, leads, reports = [], [], []
            for block, _, _, payload in rows:
                segments_, lead, doc, start, again = pickle.loads(unsqueeze(payload))
                every += segments_
                leads.append(lead)
                reports.append((block, slice(len(every) - len(segments_), len(every)), doc, start, again))
            at = names(every)
            reports = [(block, at[of], *more) for block, of, *more in reports]
            doc, start = (np.concatenate([r[i] for r in reports]) for i in (2, 3))
            order = np.lexsort((start, doc, at))
            first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
            doc, start = doc[first], start[first]
            texts = [every[i] for i in first.tolist()]
            mask = judge(texts, np.concatenate(leads)[first].astype(np.int64), doc, start)
            if not carry:
                payload = [squeeze(np.concatenate([doc[a], start[a], mask[a].view(np.int64)]).tobytes()) for _, a, *_ in reports]
                yield blob_batch([r[0] for r in reports], VERDICTS, bucket, payload)
                continue
            blocks, payload = [], []
            for block, a, own_doc, own_start, again in reports:
                lost = a[again | (mask[a] != 0) | (own_doc != doc[a]) | (own_start != start[a])]
                if len(lost):
                    blocks.append(block)
                    payload.append(squeeze(pickle.dumps(([texts[i] for i in lost.tolist()], doc[lost], start[lost], mask[lost]), 5)))
            if payload:
                yield blob_batch(blocks, VERDICTS, bucket, payload)

    return segments.repartitionById(plan.buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(decide, BLOB)


def apply_verdicts(block: Block, given: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, mask) by segment number of the block."""
    n = len(block.segments)
    doc, start, mask = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for bucket, which in in_order(block):
        values = np.frombuffer(unsqueeze(given[bucket]), np.int64)
        if len(values) != 3 * len(which):
            raise RuntimeError("a block read other texts than before; the input changed during the run")
        doc[which], start[which] = values[: len(which)], values[len(which) : 2 * len(which)]
        mask[which] = values[2 * len(which) :].view(np.uint64)
    return doc, start, mask


def read_passages(rows: Iterator[tuple]) -> tuple[list, list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(ids, texts, passages, order, start, mask) of a block whose verdicts carry the passages."""
    ids, texts, passages, parts = [], [], [], []
    for _, kind, _, payload in rows:
        if kind == VERDICTS:
            some, *values = pickle.loads(unsqueeze(payload))
            passages += some
            parts.append(values)
        else:
            some_ids, some_texts = pickle.loads(unsqueeze(payload))
            ids += some_ids
            texts += some_texts
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    doc, start, mask = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
    return ids, texts, passages, doc, start, mask


def union_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open intervals merged where they touch or overlap."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > last[:-1]))
    return first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]


def exchange(docs: DataFrame, id_col: str, text_col: str, alphabet: Alphabet, judge: Judge, apply, schema: str, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS, carry: bool = False, names=seen_names) -> DataFrame:
    """Batches of ``schema`` over all blocks: ``apply(block, order, start, mask)``,
    or, with ``carry``, ``apply(ids, texts, passages, order, start, mask)``."""
    from scatterlake.llm.common import stage

    # a mask has 64 bits, one for each window of a segment
    if not alphabet.k <= alphabet.window <= alphabet.k + 63:
        raise ValueError(f"windows of {alphabet.window} symbols don't fit a mask: at most {alphabet.k + 63}")
    plan = Plan.of(docs, text_col, block_bytes, hot_blocks)
    rows = keyed_docs(docs, id_col, text_col, plan)
    keys = stage(surviving_keys(rows, alphabet, plan), "repeat-keys")
    given = stage(verdicts(report_segments(keys.union(doc_blobs(rows)), alphabet, plan), judge, plan, carry, names), "repeat-verdicts")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows_ in groups(batches, 0):
            if carry:
                yield from apply(*read_passages(rows_))
                continue
            block, got = read_block(rows_, alphabet, plan)
            yield from apply(block, *apply_verdicts(block, got))

    blobs = given if carry else keys.union(given)
    return by_block(blobs.union(doc_blobs(rows)), plan).mapInArrow(finish, schema)
