"""Exact dedup by a content sort.

Texts are compared after all ASCII blanks are deleted. Sampled splitters
range-partition the normalised bytes, an external sort places equal texts next
to each other, neighbours are compared in full, and the first row of a run of
equals stays. The order of a run is part of the sort key, so a run of any size
is cut into pieces that fit a task; pieces at the edges of partitions are put
together by a table of two rows for each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scatterlake.llm.common import parts_for, stage, text_bytes
from scatterlake.llm.lines import BLANK

#: Text bytes that one task sorts.
PART_BYTES = 32 << 20
#: Leading bytes of a text in its sort key; its digest follows. Splitters of bounded size can then cut between texts with one opening.
HEAD = 64
#: Rows that each partition gives to the sample of splitters, and the setting that says so.
SAMPLED, SAMPLE_SIZE = 20, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
#: Partitions whose edge rows (two each, about 100 bytes) may be sent to all.
FEW_PARTS = 200_000


def normalised(text: Column) -> Column:
    """The text without blanks of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def _runs(carried: list[str], schema: T.StructType) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Judges the rows of one sorted partition; a run that touches an edge stays undecided.

    Only the open run is held, and a partition bounds it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def decided(rows: pa.Table, sizes: np.ndarray, part: int, edge: int | None) -> pa.RecordBatch:
        """``rows`` are whole runs of the given sizes, or a piece of one at an ``edge``."""
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        place = np.repeat(first, sizes)
        head = place == np.arange(len(place))
        n, middle = len(place), edge is None
        columns = {
            **{c: rows[c] for c in carried},
            "__sha": rows["__sha"],
            "__keep": rows["__id"].take(pa.array(place)),
            "__size": pa.array(np.repeat(sizes, sizes), pa.int64()),
            "__kept": pa.array(head),
            "__part": pa.array(np.full(n, part), pa.int32()),
            "__edge": pa.nulls(n, pa.int32()) if middle else pa.array(np.full(n, edge), pa.int32()),
            "__edge_text": pa.nulls(n, pa.string()) if middle else pa.array([rows["__norm"][0].as_py()] + [None] * (n - 1), pa.string()),
        }
        out = pa.table([columns[f.name].cast(f.type) for f in arrow], schema=arrow).combine_chunks()
        return out.to_batches()[0]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, closed, last = TaskContext.get().partitionId(), 0, None
        open_run: list[pa.Table] = []

        def close(edge: int | None) -> pa.RecordBatch:
            rows = pa.concat_tables(open_run)
            open_run.clear()
            return decided(rows, np.array([len(rows)]), part, edge)

        for batch in batches:
            if not len(batch):
                continue
            rows, norm = pa.table(batch), batch["__norm"]
            fresh = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[last is None or norm[0].as_py() != last], fresh]))
            last = norm[len(norm) - 1].as_py()
            if not len(starts):
                open_run.append(rows)
                continue
            if starts[0]:
                open_run.append(rows.slice(0, int(starts[0])))
            if open_run:
                yield close(None if closed else 0)
                closed += 1
            begin = int(starts[0])
            if not closed and len(starts) > 1:  # the very first run of the partition, whole in this batch
                open_run.append(rows.slice(begin, int(starts[1]) - begin))
                yield close(0)
                closed, begin, starts = 1, int(starts[1]), starts[1:]
            if len(starts) > 1:
                yield decided(rows.slice(begin, int(starts[-1]) - begin), np.diff(starts), part, None)
                closed += len(starts) - 1
            open_run.append(rows.slice(int(starts[-1])))
        if open_run:
            yield close(1 if closed else 0)

    return judge


def exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(__id, __keep, __size, __kept, __sha) for each row of ``docs``, and its columns ``carry`` (any names).

    Rows with equal normalised texts form a group of ``__size`` rows. The one
    with the most code points in its original text stays, of several that of
    the smallest id: ``__kept``; ``__keep`` is its id. ``__sha`` is the SHA-256
    of the normalised text in UTF-8.

    Null or empty texts, and texts of blanks only, are one group. Rows with one
    id are documents of their own; of full ties exactly one row stays, any. A
    null id comes after all others. No rows: no rows. A text of any length goes
    to one task; a group of any size is shared by as many as its bytes need.
    Equal digests place texts next to each other; the comparison of whole
    texts decides.
    """
    spark = docs.sparkSession
    named = [(f"__c{i}", c) for i, c in enumerate(carry or [])]
    norm = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        norm.alias("__norm"),
        (-F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("__order"),
        F.unhex(F.sha2(norm, 256)).alias("__sha"),
        *(F.col(f"`{c}`").alias(short) for short, c in named),
    )
    # leading bytes, digest, then the order inside a group: the key of splitters and sort
    key = [F.substring(F.encode("__norm", "UTF-8"), 1, HEAD).asc(), F.col("__sha").asc(), F.col("__order").asc(), F.col("__id").asc_nulls_last()]
    parts = parts_for(text_bytes(docs, text_col), part_bytes)
    id_type = rows.schema["__id"].dataType
    schema = T.StructType(
        [f for f in rows.schema if f.name not in ("__norm", "__order")]
        + [T.StructField("__keep", id_type), T.StructField("__size", T.LongType()), T.StructField("__kept", T.BooleanType())]
        + [T.StructField("__part", T.IntegerType()), T.StructField("__edge", T.IntegerType()), T.StructField("__edge_text", T.StringType())]
    )
    before = spark.conf.get(SAMPLE_SIZE, None)
    spark.conf.set(SAMPLE_SIZE, str(SAMPLED))
    try:
        sorted_rows = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
        judged = stage(sorted_rows.mapInArrow(_runs(["__id", *(short for short, _ in named)], schema), schema), "content-sort")
    finally:
        if before is None:
            spark.conf.unset(SAMPLE_SIZE)
        else:
            spark.conf.set(SAMPLE_SIZE, before)
    # pieces of one run at the edges of neighbouring partitions: that of the lowest partition holds the first row
    pieces = judged.where(F.col("__edge_text").isNotNull()).select("__edge_text", "__part", "__edge", "__size", "__keep")
    whole = pieces.groupBy("__edge_text").agg(
        F.sum("__size").alias("__total"),
        F.min(F.struct("__part", "__edge", "__keep")).alias("__front"),
        F.collect_list(F.struct("__part", "__edge")).alias("__pieces"),
    )
    whole = whole.select(
        F.explode("__pieces").alias("__at"), "__total", F.col("__front.__keep").alias("__first"),
        F.struct("__front.__part", "__front.__edge").alias("__front_at"),
    ).select("__at.*", "__total", "__first", (F.col("__at") == F.col("__front_at")).alias("__is_front"))
    if parts <= FEW_PARTS:
        whole = F.broadcast(whole)
    out = ["__id", *(short for short, _ in named)]
    inner = judged.where(F.col("__edge").isNull()).select(*out, "__keep", "__size", "__kept", "__sha")
    outer = judged.where(F.col("__edge").isNotNull()).join(whole, ["__part", "__edge"]).select(
        *out, F.col("__first").alias("__keep"), F.col("__total").alias("__size"), (F.col("__kept") & F.col("__is_front")).alias("__kept"), "__sha"
    )
    both = inner.unionByName(outer)
    return both.select("__id", "__keep", "__size", "__kept", F.lower(F.hex("__sha")).alias("__sha"), *(F.col(short).alias(c) for short, c in named))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that ``exact_copies`` keeps."""
    # renamed on the way, so that a column may have any name
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    judged = exact_copies(plain, at[id_col], at[text_col], list(plain.columns), part_bytes)
    return judged.where("__kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
