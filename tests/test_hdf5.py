"""HDF5: bytes against arrays, old and new headers, chunks skipped, the data source's splits, filters and commits."""

import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scatterlake.functions import hdf5
from scatterlake.functions.hdf5 import Hdf5File, frame_file
from scatterlake.sources.hdf5 import SCHEMA, read_hdf5, write_hdf5


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        self.data, self.bytes = data, 0

    def read_at(self, size, offset):
        self.bytes += size
        return self.data[offset : offset + size]


@pytest.mark.parametrize("n,per_chunk,dtype", [(1, 1, "f8"), (7, 3, "u2"), (300, 1, "i4"), (5000, 1, "f4"), (9, 16, "i8")])
def test_written_file_reads_back(n, per_chunk, dtype):
    frames = np.random.default_rng(n).integers(0, 60000, (n, 6, 5)).astype(dtype)
    file = Hdf5File(pa.BufferReader(frame_file(frames, np.arange(n) * 3, per_chunk)))
    data = file.dataset("/entry/data")
    assert data.shape == frames.shape and data.dtype == np.dtype(dtype)
    assert (np.concatenate([file.load(data, c) for c in file.chunks(data)]) == frames).all()
    assert (file.values(file.dataset("/entry/label"), n // 2, n) == np.arange(n // 2, n) * 3).all()
    with pytest.raises(KeyError):
        file.dataset("/entry/nothing")


def test_index_and_chunks_outside_a_range_are_not_read():
    frames = np.random.default_rng(0).normal(size=(5000, 8, 8))
    source = Counted(frame_file(frames, np.arange(5000)))
    file = Hdf5File(source)
    data = file.dataset("/entry/data")
    before = source.bytes
    found = list(file.chunks(data, 4000, 4002))
    assert [c.offset[0] for c in found] == [4000, 4001]
    assert source.bytes - before < 10_000  # of 79 leaves of 2.6 kB, one
    assert (file.load(data, found[1])[0] == frames[4001]).all()


def _message(kind, body):
    return struct.pack("<BHB", kind, len(body), 0) + body


def _new_header(*messages):
    body = b"".join(_message(*m) for m in messages)
    return b"OHDR" + struct.pack("<BBH", 2, 1, len(body)) + body + bytes(4)


def test_new_superblock_headers_and_links_behind_a_user_block():
    """Put together from the format's description: a superblock of version 3 at 512, a contiguous big-endian dataset."""
    values = np.arange(12, dtype=">i2").reshape(3, 4)
    space = struct.pack("<BBBBQQ", 2, 2, 0, 1, 3, 4)
    kind = struct.pack("<BBBBIHH", 0x10, 0x09, 0, 0, 2, 0, 16)
    data = _new_header((hdf5.DATASPACE, space), (hdf5.DATATYPE, kind), (hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, 400, 24)))
    link = struct.pack("<BBB", 1, 0, 5) + b"image" + struct.pack("<Q", 200)
    no_dense = struct.pack("<BBQQ", 0, 0, hdf5.UNDEFINED, hdf5.UNDEFINED)
    root = _new_header((hdf5.LINK_INFO, no_dense), (hdf5.LINK, link))
    head = hdf5.SIGNATURE + struct.pack("<BBBBQQQQ", 3, 8, 8, 0, 512, hdf5.UNDEFINED, 424, 48) + bytes(4)
    whole = bytearray(512 + 424)
    for at, piece in ((0, head), (48, root), (200, data), (400, values.tobytes())):
        whole[512 + at : 512 + at + len(piece)] = piece
    file = Hdf5File(pa.BufferReader(bytes(whole)))
    found = file.dataset("image")
    assert (np.concatenate([file.load(found, c) for c in file.chunks(found)]) == values).all()
    assert [c.offset for c in file.chunks(found, 1, 2)] == [(0, 0)]  # small entries share a block


def test_no_hdf5_raises():
    with pytest.raises(ValueError, match="signature"):
        Hdf5File(pa.BufferReader(b"text"))


def _frames(spark, n):
    rows = spark.range(n, numPartitions=3).select(
        (F.col("id") * 7).alias("label"), F.lit(4).alias("rows"), F.lit(5).alias("columns"),
        F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: (F.col("id") * 20 + k).cast("double")).alias("data"), F.lit("x").alias("path"),
    )
    return rows


def _cells(df):
    rows = df.select("label", "row", "column", "columns", F.posexplode("data").alias("k", "v")).collect()
    return sorted((r.label, r.row + r.k // r.columns, r.column + r.k % r.columns, r.v) for r in rows)


@pytest.mark.parametrize("split", [300, 1 << 27])
def test_source_reads_every_frame_once_whatever_the_splits(spark, tmp_path, split):
    path = f"file://{tmp_path}/h"
    write_hdf5(_frames(spark, 200), path, dtype="uint16", framesPerChunk=3, fileBytes=20 * 2 * 25)
    assert len(os.listdir(tmp_path / "h")) > 3 and not any(f.startswith(".") for f in os.listdir(tmp_path / "h"))
    df = read_hdf5(spark, path, labels="/entry/label", splitBytes=split)
    assert (df.rdd.getNumPartitions() > 20) == (split == 300)
    assert _cells(df) == [(7 * i, r, c, float(20 * i + 5 * r + c)) for i in range(200) for r in range(4) for c in range(5)]
    window = read_hdf5(spark, path, labels="/entry/label", rows="1:3", columns="2:", splitBytes=split)
    assert _cells(window) == [(7 * i, r, c, float(20 * i + 5 * r + c)) for i in range(200) for r in (1, 2) for c in (2, 3, 4)]


def test_filters_reach_the_source(spark, tmp_path):
    path = f"{tmp_path}/h"
    write_hdf5(_frames(spark, 90).coalesce(1), path, framesPerChunk=4)
    whole = read_hdf5(spark, path, labels="/entry/label")
    cut = whole.where("frame >= 10 AND frame < 13")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "FilterExec" not in plan and ">= 10" not in plan.split("BatchScan")[0]
    assert sorted(r.label for r in cut.collect()) == [70, 77, 84]
    assert [r.label for r in whole.where("frame = 5").collect()] == [35]
    name = whole.first().path
    assert whole.where(F.col("path") == name).count() == 90 and whole.where(F.col("path") == "none").count() == 0
    assert whole.where("label % 2 = 0 AND frame > 80").count() == 4  # 82, 84, 86, 88


def test_overwrite_empty_and_refused(spark, tmp_path):
    path = f"{tmp_path}/h"
    write_hdf5(_frames(spark, 5), path)
    write_hdf5(_frames(spark, 2), path, mode="overwrite")
    assert read_hdf5(spark, path).count() == 2
    assert [r.label for r in read_hdf5(spark, path).collect()] == [None, None]
    write_hdf5(_frames(spark, 0), f"{tmp_path}/none")
    assert read_hdf5(spark, f"{tmp_path}/none").collect() == []
    holes = spark.sql("SELECT 1L AS label, 1 AS `rows`, 2 AS columns, array(1D, NULL) AS data")
    write_hdf5(holes, f"{tmp_path}/holes")
    assert np.isnan(read_hdf5(spark, f"{tmp_path}/holes").first().data[1])
    for bad in ("SELECT 1L AS label, 1 AS `rows`, 2 AS columns, array(1D) AS data", "SELECT 1L AS label, 1 AS `rows`, 1 AS columns, array(-1D) AS data"):
        with pytest.raises(Exception, match="needed|can't hold"):
            write_hdf5(spark.sql(bad), f"{tmp_path}/bad", dtype="uint8")
    assert [f for f in os.listdir(tmp_path / "bad") if not f.startswith(".")] == []
    assert read_hdf5(spark, path).schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
