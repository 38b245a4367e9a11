"""A stream of files that are there whole: not empty, and unchanged for a while."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from scatterlake.sources.hdf5 import _open


class SettledFiles(DataSource):
    """Options: path (a folder), age (seconds without a change), suffix."""

    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> str:
        return "path string, size long, modified_ns long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Settled(self.options)


class _Settled(SimpleDataSourceStreamReader):
    """The place in the stream is the time of the newest file told, and its path."""

    def __init__(self, options):
        self.path, self.age_ns, self.suffix = options["path"], int(float(options.get("age", 1)) * 1e9), options.get("suffix", "")

    def initialOffset(self) -> dict:
        return {"ns": -1, "path": ""}

    def _files(self) -> list[tuple[str, int, int]]:
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        shown = (f for f in found if f.is_file and f.size and not f.base_name.startswith((".", "_")) and f.base_name.endswith(self.suffix))
        return sorted(((f.path, f.size, f.mtime_ns) for f in shown), key=lambda f: (f[2], f[0]))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        settled = time.time_ns() - self.age_ns
        rows = [f for f in self._files() if (start["ns"], start["path"]) < (f[2], f[0]) and f[2] <= settled]
        return iter(rows), {"ns": rows[-1][2], "path": rows[-1][0]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([f for f in self._files() if (start["ns"], start["path"]) < (f[2], f[0]) <= (end["ns"], end["path"])])


def settled_files(spark: SparkSession, folder: str, age: float, suffix: str = "") -> DataFrame:
    """Stream (path, size, modified_ns): files below ``folder`` once they hold something and rest for ``age`` seconds.

    A file that is changed after it was told comes again, under its new time.
    One that is moved in with a time before the newest told file's is missed:
    writers must not keep old times. The clocks of store and driver must agree
    better than ``age``. Names alone pass the driver; an absent folder is an
    empty one; hidden names are left out.
    """
    spark.dataSource.register(SettledFiles)
    return spark.readStream.format("settled_files").options(path=folder, age=age, suffix=suffix).load()
