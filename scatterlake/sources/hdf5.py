"""HDF5 and NeXus frames as a Spark data source: ``spark.read.format("hdf5")`` and ``df.write.format("hdf5")``.

Files are split by bytes, as columnar files are: a task reads the index of its
file and takes the chunks stored within its range, so nothing but the listing
happens on the driver, and one large file keeps many tasks busy. Ranges of
frames, rows and columns and filters on ``frame`` and ``path`` reach the index:
chunks outside are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from scatterlake.functions import hdf5

SCHEMA = "path string, label long, frame long, row int, column int, rows int, columns int, data array<double>"
END = 2**62


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _range(text: str | None) -> tuple[int, int]:
    first, _, last = (text or ":").partition(":")
    return int(first or 0), int(last or END)


class Hdf5Source(DataSource):
    """Options: path (file or folder), dataset, labels (a dataset of one axis), frames, rows, columns (half-open ``a:b``), splitBytes.

    Written with dtype, framesPerChunk and fileBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredReader if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema.names, overwrite)


@dataclass
class _Split(InputPartition):
    """Byte ranges of files: (path, first byte, last byte)."""

    pieces: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.dataset, self.labels = options.get("dataset", "/entry/data"), options.get("labels")
        self.frames, self.rows, self.columns = (_range(options.get(axis)) for axis in ("frames", "rows", "columns"))
        self.split_bytes = int(options.get("splitBytes", 128 << 20))
        self.paths: set[str] | None = None

    def partitions(self) -> list[_Split]:
        """Pieces of large files, and small files together, of about ``splitBytes`` each."""
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        shown = [f for f in found if f.is_file and not f.base_name.startswith((".", "_")) and f.base_name.endswith((".h5", ".hdf5", ".nxs", ".nx5"))]
        splits, open_pieces, room = [], [], self.split_bytes
        for f in sorted(shown, key=lambda f: f.path):
            if self.paths is not None and f.path not in self.paths:
                continue
            for start in range(0, f.size, self.split_bytes):
                end = min(start + self.split_bytes, f.size)
                if open_pieces and end - start > room:
                    splits.append(_Split(open_pieces))
                    open_pieces, room = [], self.split_bytes
                open_pieces.append((f.path, start, end))
                room -= end - start
        return [*splits, _Split(open_pieces)] if open_pieces else splits or [_Split([])]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        for path, start, end in partition.pieces:
            with fs.open_input_file(path) as source:
                yield from self._tiles(path, hdf5.Hdf5File(source), start, end)

    def _tiles(self, path: str, file: hdf5.Hdf5File, start: int, end: int) -> Iterator[pa.RecordBatch]:
        data = file.dataset(self.dataset)
        if len(data.shape) > 3:
            raise ValueError(f"{path}: {self.dataset} has {len(data.shape)} axes, at most three are read")
        labels = file.dataset(self.labels) if self.labels else None
        for chunk in file.chunks(data, *self.frames):
            place = chunk.address + file.base if data.kind != "compact" else 0
            if not start <= place < end:
                continue
            # axes: frame; row, if there are three; column, if there are two
            f0, r0, c0 = _three(chunk.offset, 0)
            _, height, width = _three(chunk.shape, 1)
            if r0 >= self.rows[1] or r0 + height <= self.rows[0] or c0 >= self.columns[1] or c0 + width <= self.columns[0]:
                continue
            tile = file.load(data, chunk)
            tile = tile.reshape(_three(tile.shape, 1))
            cut = [slice(max(0, a - o), max(0, b - o)) for (a, b), o in zip((self.frames, self.rows, self.columns), (f0, r0, c0), strict=True)]
            tile = tile[tuple(cut)]
            n, rows, columns = tile.shape
            if tile.size == 0:
                continue
            first = f0 + cut[0].start
            named = pa.array(file.values(labels, first, first + n).astype(np.int64)) if labels else pa.nulls(n, pa.int64())
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (rows * columns))
            constant = lambda value: pa.array(np.full(n, value, np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n), named, pa.array(np.arange(first, first + n)), constant(r0 + cut[1].start), constant(c0 + cut[2].start),
                 constant(rows), constant(columns), pa.ListArray.from_arrays(offsets, pa.array(tile.astype(np.float64).ravel()))],
                ["path", "label", "frame", "row", "column", "rows", "columns", "data"],
            )


def _three(axes: tuple[int, ...], missing: int) -> tuple[int, int, int]:
    """Up to three axes as frame, row and column."""
    if len(axes) == 3:
        return axes
    return (axes[0], missing, axes[1]) if len(axes) == 2 else ((axes[0] if axes else missing), missing, missing)


class _FilteredReader(_Reader):
    def pushFilters(self, filters):
        """Ranges of frames and names of files are taken over whole; the rest is left to Spark."""
        for f in filters:
            name, first, last = f.attribute[0] if hasattr(f, "attribute") else None, *self.frames
            if name == "frame" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    first = max(first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    last = min(last, f.value + (not isinstance(f, LessThan)))
                self.frames = first, last
            elif name == "path" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Files of about ``fileBytes`` before compression, under hidden names until the job commits."""

    def __init__(self, options, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], names, overwrite
        self.dtype = np.dtype(options.get("dtype", "float64"))
        self.per_chunk, self.file_bytes = int(options.get("framesPerChunk", 1)), int(options.get("fileBytes", 64 << 20))
        if self.dtype.kind not in "iuf" or self.dtype == np.float16 or self.per_chunk < 1:
            raise ValueError("dtype must be an integer or a float of four or eight bytes, framesPerChunk at least 1")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        written, held, labels, shape = [], [], [], None

        def flush():
            if held:
                name = f"part-{uuid.uuid4().hex}.h5"
                with fs.open_output_stream(f"{root}/.{name}") as out:
                    out.write(hdf5.frame_file(np.stack(held), np.array(labels, np.int64), min(self.per_chunk, len(held))))
                written.append(name)
                held.clear()
                labels.clear()

        for batch in iterator:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                label, rows, columns = (column[c][i].as_py() for c in ("label", "rows", "columns"))
                data = column["data"][i]
                if label is None or rows is None or columns is None or not data.is_valid or len(data) != rows * columns or not len(data):
                    raise ValueError(f"frame {label}: label, rows, columns and rows x columns values are needed")
                values = data.values.to_numpy(zero_copy_only=False)  # nulls become NaN
                if self.dtype.kind != "f":
                    whole = np.isfinite(values) & (values >= np.iinfo(self.dtype).min) & (values <= np.iinfo(self.dtype).max)
                    if not whole.all():
                        raise ValueError(f"frame {label} has values that {self.dtype} can't hold")
                if shape != (rows, columns) or (len(held) + 1) * rows * columns * self.dtype.itemsize > self.file_bytes:
                    flush()
                    shape = rows, columns
                held.append(values.astype(self.dtype).reshape(shape))
                labels.append(label)
        flush()
        return _Written(written)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.startswith("part-")] if self.overwrite else []
        for message in messages:
            for name in message.files if message else []:
                fs.move(f"{root}/.{name}", f"{root}/{name}")
        for path in before:
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, root = _open(self.path)
        for message in messages:
            for name in message.files if message else []:
                fs.delete_file(f"{root}/.{name}")


def read_hdf5(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, label, frame, row, column, rows, columns, data): a row for each stored tile of each frame, its values row by row.

    ``dataset`` has up to three axes: frame, row, column; of two axes the last
    is the column. ``labels`` names a dataset with an entry for each frame;
    without it label is null. A frame that was never written has no row; a file
    without the dataset raises, a folder without files has no rows. Filters are
    pushed down where spark.sql.python.filterPushdown.enabled is on; the
    options frames, rows and columns work always. Integers beyond 2^53 lose
    digits. Other columns of the source don't exist, so none can clash.
    """
    spark.dataSource.register(Hdf5Source)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("hdf5").options(pushdown=pushed, **options).load(path)


def write_hdf5(frames: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Frames (label, rows, columns, data; other columns are left out) as HDF5 files, for ``read_hdf5(labels="/entry/label")``.

    A task holds one file's frames, ``fileBytes`` at most. Files appear when the
    job commits: a task that is lost or run twice leaves hidden files only.
    Null pixels become NaN; frames without label or shape raise, as do values
    that ``dtype`` can't hold; repeated labels are kept; no rows, no files.
    """
    frames.sparkSession.dataSource.register(Hdf5Source)
    frames.select("label", "rows", "columns", "data").write.format("hdf5").options(**options).mode(mode).save(path)
