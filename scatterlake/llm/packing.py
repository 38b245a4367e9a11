"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous: documents and gaps are range-sorted by size, each range is
swept from large to small against a stack of gaps (the successor of a document
is the smallest gap that holds it), what a range leaves over is matched across
ranges by rank, gaps are updated, and the next round begins.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.llm.common import stage
from scatterlake.llm.tokens import word_tokenizer

LENGTH = 4096
END_ID = 1
#: Documents and gaps in one range of a sweep.
ROWS_EACH = 100_000

ITEM, GAP, PLACED, LATER = 0, 1, 2, 3
SWEPT = "part int, kind int, id long, size long, seq long, offset long, rank long"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(rid, doc_id, piece, start, length, ids_crc32): documents as token runs of at most ``length``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for i, encoded in enumerate(tokenizer.encode_all(batch.column(1).to_pylist())):
                ids = np.append(encoded, end_id).astype("<u4")
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            columns = [
                pa.array(range(number, number + len(row)), pa.int64()), batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc)),
            ]
            number += len(row)
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col), F.col(text_col))
    return source.mapInArrow(cut, f"rid long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def sweep(rows: Iterator[tuple[int, int, int]], length: int) -> list[tuple[int, int, int, int | None, int | None, int | None]]:
    """Best fit over (kind, id, size) rows sorted from large to small, gaps first among equals.

    The stack holds the open gaps that fit the current size, the smallest on
    top. What a placement leaves is a gap again as soon as sizes are down to
    it. Returns (kind, id, size, seq, offset, rank): placed items, items that
    found no gap, gaps still on the stack from bottom to top, and gaps that
    are too small for what comes directly after.
    """
    stack: list[tuple[int, int]] = []
    waiting: list[tuple[int, int]] = []
    out, left = [], 0
    for kind, ident, size in rows:
        while waiting and -waiting[0][0] >= size:
            rest, seq = heapq.heappop(waiting)
            stack.append((-rest, seq))
        if kind == GAP:
            stack.append((size, ident))
        elif stack:
            gap, seq = stack.pop()
            out.append((PLACED, ident, size, seq, length - gap, None))
            if gap > size:
                heapq.heappush(waiting, (size - gap, seq))
        else:
            out.append((ITEM, ident, size, None, None, left))
            left += 1
    out += [(GAP, seq, gap, None, None, rank) for rank, (gap, seq) in enumerate(stack)]
    out += [(LATER, seq, -rest, None, None, None) for rest, seq in waiting]
    return out


def handovers(left: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """(item range, first rank, count, gap range, last gap rank + 1) of what ranges hand on.

    ``left`` counts the items and gaps left in each range. Ranges come from
    large to small, so a later range takes the gaps on top of all before it.
    """
    out, stack = [], []
    for part in sorted({p for p, _ in left}):
        n, first = left.get((part, ITEM), 0), 0
        while n and stack:
            source, count = stack.pop()
            take = min(n, count)
            out.append((part, first, take, source, count))
            if count > take:
                stack.append((source, count - take))
            first, n = first + take, n - take
        if gaps := left.get((part, GAP), 0):
            stack.append((part, gaps))
    return out


def cut_ranges(counts: list[tuple[int, int, int]], each: int) -> list[tuple[int, int, int, int]]:
    """(size, kind, first range, ranges) for (size, kind, rows) in sort order, about ``each`` rows to a range.

    Ranges follow the order; a class with more rows than a range holds is dealt
    over several.
    """
    out, part, held = [], 0, 0
    for size, kind, rows in counts:
        if held and held + rows > each:
            part, held = part + 1, 0
        share = -(-rows // each)
        out.append((size, kind, part, share))
        part, held = part + share - 1, held + rows if share == 1 else each
    return out


def _sweep_ranges(items: DataFrame, gaps: DataFrame, length: int, rows_each: int) -> DataFrame:
    spark = items.sparkSession
    both = items.select(F.lit(ITEM).alias("kind"), "id", "size").union(gaps.select(F.lit(GAP).alias("kind"), "id", "size"))
    # at most ``length`` sizes of two kinds: the splitters of the range sort come from exact counts
    counts = both.groupBy("size", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size"), F.desc("kind")).collect()
    ranges = cut_ranges([tuple(r) for r in counts], rows_each)
    cuts = F.broadcast(spark.createDataFrame(ranges, "cut long, of int, part int, share int"))
    dealt = both.join(cuts, (F.col("size") == F.col("cut")) & (F.col("kind") == F.col("of")))
    dealt = dealt.withColumn("part", (F.col("part") + F.pmod(F.xxhash64("id"), F.col("share"))).cast("int"))
    order = [F.desc("size"), F.desc("kind"), F.asc("id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        if found := sweep(rows, length):
            kind, ident, size, seq, offset, rank = zip(*found, strict=True)
            columns = [pa.array([TaskContext.get().partitionId()] * len(found), pa.int32()), pa.array(kind, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (ident, size, seq, offset, rank)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SWEPT.split(", ")])

    n = ranges[-1][2] + ranges[-1][3]
    sorted_ = dealt.repartitionById(n, "part").select("kind", "id", "size").sortWithinPartitions(*order)
    return sorted_.mapInArrow(run, SWEPT)


def _match_across(swept: DataFrame, length: int) -> DataFrame:
    """``swept`` with the items and gaps matched that ranges handed on."""
    left = {(r["part"], r["kind"]): r["n"] for r in swept.where(F.col("rank").isNotNull()).groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    flows = handovers(left)  # at most two rows for each range
    if not flows:
        return swept
    spark = swept.sparkSession
    f = F.broadcast(spark.createDataFrame(flows, "to int, first long, n long, source int, top long"))
    s = swept.alias("s")
    given = s.where(F.col("kind") == ITEM).join(
        f, (F.col("part") == F.col("to")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")), "left"
    )
    given = given.withColumn("place", F.col("top") - 1 - (F.col("rank") - F.col("first")))
    wanted = given.where(F.col("source").isNotNull()).select(F.col("id").alias("item"), F.col("size").alias("need"), "source", "place")
    # gaps that are handed on have the ranks from the last one's down
    lent = F.broadcast(spark.createDataFrame([(x[3], x[4] - x[2], x[4]) for x in flows], "lender int, low long, high long"))
    taken = (F.col("part") == F.col("lender")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    gaps = s.where(F.col("kind") == GAP).join(lent, taken, "left")
    offered = gaps.where(F.col("lender").isNotNull()).select("part", F.col("rank").alias("at"), F.col("id").alias("gap"), F.col("size").alias("room"))
    met = wanted.join(offered, (F.col("source") == F.col("part")) & (F.col("place") == F.col("at")))
    null = F.lit(None).cast("long")
    row = lambda kind, ident, size, seq, offset: F.struct(
        F.lit(kind).alias("kind"), F.col(ident).alias("id"), size.alias("size"), seq.alias("seq"), offset.alias("offset")
    )
    need, room = F.col("need"), F.col("room")
    pair = F.array(row(PLACED, "item", need, F.col("gap"), F.lit(length) - room), row(LATER, "gap", room - need, null, null))
    columns = ["kind", "id", "size", "seq", "offset"]
    kept = [swept.where(F.col("rank").isNull()), given.where(F.col("source").isNull()), gaps.where(F.col("lender").isNull())]
    return met.select(F.inline(pair)).union(kept[0].select(*columns)).union(kept[1].select(*columns)).union(kept[2].select(*columns))


def place(sizes: DataFrame, length: int = LENGTH, rows_each: int = ROWS_EACH) -> DataFrame:
    """(id, seq, offset) for every (id, size) row, 1 <= size <= ``length``.

    New sequences are opened, as many as what is left needs at least, when no
    open gap holds any of it; the largest left over begin them. Rounds end when
    all is placed. The state of a round is a table in the shared folder.
    """
    spark = sizes.sparkSession
    items = sizes.select("id", "size")
    n_items, total, least = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.min("size")).first()
    none = spark.range(0).select("id", F.lit(0).cast("long").alias("size"))
    gaps, n_gaps, opened, moved, done = none, 0, 0, 0, []
    while n_items:
        if not moved or not n_gaps:
            new = -(-total // length)
            fresh = spark.range(opened, opened + new).select("id", F.lit(length).cast("long").alias("size"))
            gaps, n_gaps, opened = gaps.union(fresh), n_gaps + new, opened + new
        swept = stage(_sweep_ranges(items, gaps, length, rows_each), "sweep")
        met = _match_across(swept, length)
        state = swept if met is swept else stage(met, "round")
        done.append(state.where(F.col("kind") == PLACED).select("id", "seq", "offset"))
        is_item, is_gap = F.col("kind") == ITEM, F.col("kind").isin(GAP, LATER)
        n_items, total, least, moved = state.agg(
            F.count(F.when(is_item, 1)), F.coalesce(F.sum(F.when(is_item, F.col("size"))), F.lit(0)),
            F.min(F.when(is_item, F.col("size"))), F.count(F.when(F.col("kind") == PLACED, 1)),
        ).first()
        items = state.where(is_item).select("id", "size")
        gaps = state.where(is_gap & (F.col("size") >= (least or 0))).select("id", "size")
        n_gaps = gaps.count() if n_items else 0
    out = none.select("id", F.col("size").alias("seq"), F.col("size").alias("offset"))
    for placed in done:
        out = out.union(placed)
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, rows_each: int = ROWS_EACH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row, placed.

    A document is its token ids and then ``end_id``; a null or empty text is
    ``end_id`` alone. Only documents longer than ``length`` are cut, into pieces
    of ``length``; the last may be shorter. Sequences are filled from offset 0
    without gaps. Repeated rows, repeated and null ids are documents of their
    own. No rows: no rows. The same input gives the same number of sequences;
    which equal-sized document lies where may differ between runs.
    """
    cut = stage(pieces(docs, tokenizer_path, id_col, text_col, length, end_id), "pieces")
    placed = place(cut.select(F.col("rid").alias("id"), F.col("length").alias("size")), length, rows_each)
    joined = cut.join(placed, cut["rid"] == placed["id"])
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed token ids, for ids that are unique in ``docs``."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            row, number, ids = [], [], []
            for i, encoded in enumerate(tokenizer.encode_all(batch.column(1).to_pylist())):
                every = np.append(encoded, end_id)
                for k, at in enumerate(range(0, len(every), length)):
                    row.append(i)
                    number.append(k)
                    ids.append(every[at : at + length])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(ids, pa.list_(pa.int32()))],
                ["__id", "__piece", "__ids"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(id_col, text_col).mapInArrow(tokens, f"__id {id_type}, __piece int, __ids array<int>")
    joined = placed.join(cut, (placed["doc_id"] == cut["__id"]) & (placed["piece"] == cut["__piece"]))
    parts = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "__ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["__ids"])).alias("ids"))
