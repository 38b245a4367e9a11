"""Line dedup: lines that many documents share are kept in one document only.

Native: DataFrame functions throughout. Lines are exploded, normalised and
hashed; documents are counted per hash with map-side combine; lines over the
threshold go; the rest is reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.llm.common import fresh_name, stage

MIN_CHARS = 40
MIN_DOCS = 5
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _keyed(text: Column, min_chars: int) -> Column:
    """array<struct<pos, h1, h2>> of the lines long enough to be judged."""
    keyed = F.transform(_lines(text), lambda line, i: F.struct(i.alias("pos"), _key(line).alias("key")))
    long = F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars)
    # 128 bits from two seeds: at 10^12 distinct lines a collision stays out of reach
    return F.transform(
        long,
        lambda x: F.struct(
            x["pos"].alias("pos"),
            F.xxhash64(x["key"]).alias("h1"),
            F.xxhash64(F.lit(4), x["key"]).alias("h2"),
        ),
    )


def dropped_positions(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(__id, __text_hash, __drops): the sorted line numbers that each row loses.

    Rows that lose nothing are absent. A row is a document: its lines count
    once, however often they repeat in it.
    """
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__text_hash"),
        _keyed(F.col(text_col), min_chars).alias("keyed"),
    ).where(F.size("keyed") > 0)
    # in-row distinct, so that a plain count with map-side combine counts documents
    once = rows.select(
        "__id", F.explode(F.array_distinct(F.transform("keyed", lambda x: F.struct(x["h1"], x["h2"])))).alias("k")
    )
    common = (
        once.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("__id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # written and read again, the keys reach the join straight from an exchange:
    # so do the lines, and adaptive execution can split a key that a third of
    # the rows share, or send the keys to all if they are small
    common = stage(common, "common-lines")
    hits = (
        rows.select("__id", "__text_hash", F.explode("keyed").alias("k"))
        .select("__id", "__text_hash", "k.*")
        .join(common, ["h1", "h2"])
        .where(~F.col("__id").eqNullSafe(F.col("keeper")))
    )
    return hits.groupBy("__id", "__text_hash").agg(F.sort_array(F.collect_set("pos")).alias("__drops"))


def _is_dropped(drops: Column) -> Column:
    """array<boolean> up to the last dropped line, in time linear in its length."""
    runs = F.transform(
        drops,
        lambda d, i: F.concat(
            F.array_repeat(F.lit(False), d - F.when(i == 0, F.lit(-1)).otherwise(F.get(drops, i - 1)) - 1),
            F.array(F.lit(True)),
        ),
    )
    return F.flatten(runs)


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with common lines cut from ``text_col``; adds __n_lines and __n_dropped, last (with underscores after them where ``docs`` has such names).

    Lines are split at \\n. A line's key is the line stripped of ASCII blanks at
    both ends, A-Z lower-cased. Keys of ``min_chars`` code points or more found
    in ``min_docs`` rows or more lose all their lines, except in the row with
    the largest id that holds it. All columns of ``docs`` stay.

    Null or empty text: one empty line, returned as the empty string. Rows with
    the same id are documents of their own and, as ties for the largest id, all
    keep the line. A null id is smaller than any other; if all holders of a key
    have null ids, all keep it. No rows: no rows.
    """
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    text_hash = fresh_name(docs, "__text_hash")
    d = docs.withColumn(text_hash, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # the decisions are the small side: hashed, so that no text is sorted
    joined = d.alias("d").join(
        drops.hint("shuffle_hash").alias("x"),
        F.col(f"d.{id_col}").eqNullSafe(F.col("x.__id")) & (F.col(f"d.{text_hash}") == F.col("x.__text_hash")),
        "left",
    )
    lines = _lines(F.col(f"d.{text_col}"))
    marked = F.arrays_zip(lines.alias("line"), _is_dropped(F.coalesce(F.col("x.__drops"), F.array().cast("array<int>"))).alias("gone"))
    kept = F.transform(F.filter(marked, lambda x: ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["line"])
    return joined.select(
        *[
            (F.when(F.col("x.__drops").isNull(), F.coalesce(F.col(f"d.{c}"), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c))
            for c in docs.columns
        ],
        F.size(lines).cast("long").alias(fresh_name(docs, "__n_lines")),
        F.coalesce(F.size("x.__drops"), F.lit(0)).cast("long").alias(fresh_name(docs, "__n_dropped")),
    )
