"""Detector files as DataFrames: Spark lists and reads the files, numpy decodes their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.functions import formats

SCHEMA = "path string, frame int, rows int, columns int, data array<double>"


def read_frames(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, glob: str | None = None) -> DataFrame:
    """(path, frame, rows, columns, data) of CBF, EDF, SPE and text files, row by row, cut to half-open ranges.

    File splits replace reader threads; a file is decoded where it is read, and
    any store that Spark reads will do.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (source.option("pathGlobFilter", glob) if glob else source).load(path).select("path", "content")
    row_cut, column_cut = slice(*(rows or (None, None))), slice(*(columns or (None, None)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                images = formats.decode(name, content)[:, row_cut, column_cut].astype(np.float64)
                n, r, c = images.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array([r] * n, pa.int32()), pa.array([c] * n, pa.int32()), pa.array([i.ravel() for i in images])],
                    ["path", "frame", "rows", "columns", "data"],
                )

    return files.mapInArrow(decode, SCHEMA)


def pixels(frames: DataFrame) -> DataFrame:
    """(path, frame, row, col, counts): one row for each pixel."""
    rows = frames.select("path", "frame", "columns", F.posexplode("data").alias("k", "counts"))
    return rows.select("path", "frame", F.expr("CAST(k div columns AS INT)").alias("row"), (F.col("k") % F.col("columns")).alias("col"), "counts")
