"""An appender with ready marks: batches of a stream, each visible whole, once, and in order.

A batch is written to a folder of its number and marked by a file that is
renamed into place after the data. A batch that is replayed after a crash finds
its mark and is skipped, or overwrites what an unmarked attempt has left.
Readers look at marked batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class MarkedTable:
    """A table below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/ready"))

    def is_ready(self, batch: int) -> bool:
        return self._fs.exists(self._path(f"{self.root}/ready/{batch:012d}"))

    def write(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: the batch's rows, then its mark; nothing if it is marked already."""
        if self.is_ready(batch):
            return
        rows.write.mode("overwrite").parquet(self._folder(batch))
        self.mark(batch)

    def mark(self, batch: int) -> None:
        aside = self._path(f"{self.root}/ready/.{batch:012d}")
        self._fs.create(aside, True).close()
        self._fs.rename(aside, self._path(f"{self.root}/ready/{batch:012d}"))

    def _folder(self, batch: int) -> str:
        return f"{self.root}/data/batch-{batch:012d}"

    def batches(self) -> list[int]:
        """Marked batches in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/ready"))]
        return sorted(int(n) for n in names if not n.startswith("."))

    def read(self, schema: StructType, since: int = -1) -> DataFrame:
        """Rows of the marked batches after ``since``; none before the first."""
        folders = [self._folder(b) for b in self.batches() if b > since]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
