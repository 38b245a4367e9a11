"""Results kept by what they were made from: parameters and the version of the input files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def input_version(spark: SparkSession, df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files that ``df`` reads."""
    found = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, int(status.getLen()), int(status.getModificationTime())))
    return found


def cached(root: str, source: DataFrame, parameters: dict, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """(``compute(source)``, whether it was read from the folder ``root``).

    A result is found again if its parameters (JSON values) and input files are
    the same; a changed range or file makes a new one. A result counts once its
    write has ended with the mark of success, so a crash leaves none in part.
    """
    spark = source.sparkSession
    key = json.dumps([parameters, input_version(spark, source)], sort_keys=True)
    path = f"{root.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(path), True
    compute(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False
