"""Scan logs: text lines with #S, #D, #P, #L, data and #X, as columns.

Lines come as (file, line_no, text). The scan a line belongs to is the last #S
before it, a running value by file; files are the unit of a log, so windows
never span them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_scan(lines: DataFrame) -> DataFrame:
    """``lines`` with the number of the scan that each belongs to, null before the first."""
    number = F.regexp_extract("text", r"^#S ([0-9]+)", 1)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("scan", F.last(F.when(number != "", number.cast("int")), True).over(w))


def scans(lines: DataFrame) -> DataFrame:
    """(file, scan, started, motors, counters, n_rows, total): one row for each scan, total sums the first counter."""
    rows = with_scan(lines).where(F.col("scan").isNotNull())
    part = lambda mark: F.max(F.when(F.startswith("text", F.lit(mark)), F.trim(F.regexp_replace("text", r"^#[A-Z][0-9]* ", ""))))
    data = F.col("text").rlike("^[-+0-9.]")
    first = F.split("text", " +")[0].try_cast("double")
    return rows.groupBy("file", "scan").agg(
        part("#D").alias("started"),
        F.size(F.split(part("#P"), " +")).alias("motors"),
        F.size(F.split(part("#L"), " +")).alias("counters"),
        F.count(F.when(data, 1)).alias("n_rows"),
        F.round(F.coalesce(F.sum(F.when(data, first)), F.lit(0.0)), 6).alias("total"),
    )


def find_scans(lines: DataFrame, marker: str) -> DataFrame:
    """(file, line_no, scan) of the lines that are exactly ``marker`` and one more character."""
    hit = F.startswith("text", F.lit(marker)) & (F.length("text") == len(marker) + 1)
    return with_scan(lines).where(hit & F.col("scan").isNotNull()).select("file", "line_no", "scan")


def states(lines: DataFrame) -> DataFrame:
    """(file, scan, finished, overtaken): an exact '#X n' line exists; a later #S line exists."""
    number = lambda mark: F.regexp_extract("text", rf"^#{mark} ([0-9]+)$" if mark == "X" else rf"^#{mark} ([0-9]+)", 1)
    begun = lines.select("file", "line_no", number("S").alias("n")).where(F.col("n") != "").select("file", "line_no", F.col("n").cast("int").alias("scan"))
    ended = lines.select("file", number("X").alias("n")).where(F.col("n") != "").select("file", F.col("n").cast("int").alias("scan"), F.lit(True).alias("x")).distinct()
    w = Window.partitionBy("file").orderBy("line_no")
    begun = begun.withColumn("overtaken", F.lead("scan").over(w).isNotNull())
    return begun.join(ended, ["file", "scan"], "left").select("file", "scan", F.coalesce("x", F.lit(False)).alias("finished"), "overtaken")
