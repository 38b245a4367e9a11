"""Tables, shared scratch space and sizes used by the training-data operators."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files are deleted as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []
_staged: list[tuple[SparkSession, str]] = []
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def thinned(df: DataFrame, order: str, wanted: int) -> DataFrame:
    """``df`` with about twice ``wanted`` rows, drawn by the hash column ``order``, if it has many more.

    Goes before a top-k of ``wanted`` rows, so that what the partitions send on doesn't grow with their number.
    """
    share = df.count() // (2 * wanted)
    return df.where(F.pmod(F.xxhash64(F.lit(17), order), F.lit(share)) == 0) if share > 1 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master that names none (tests, a laptop) gets a local one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="scatterlake-"))
    return _own_dir[0]


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hpath = _filesystem(spark, path)
    fs.delete(hpath, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    the work above is done once however often the result is used. The shuffle
    files of the write go with it: nothing reads them once the table stands.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``release`` like a staged table."""
    path = f"{shared_dir(spark)}/scatterlake/{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    for scope in _scopes.get():
        scope.append(path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """Gathers the paths of what is staged within, by this thread only."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)


def keep_only(made: list[str], *tables: DataFrame) -> None:
    """Deletes what a scope has staged, but what ``tables`` read."""
    names = {part for t in tables for file in t.inputFiles() for part in file.split("/")}
    gone = [path for path in made if path.rsplit("/", 1)[1] not in names]
    release(gone)
    made[:] = [path for path in made if path not in gone]


def discard_path(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    names = {part for file in df.inputFiles() for part in file.split("/")}
    release([path for path in staged_paths() if path.rsplit("/", 1)[1] in names])


def staged_paths() -> list[str]:
    """Paths made by this module that haven't been deleted, oldest first."""
    return [path for _, path in _staged]


def release(paths: list[str] | None = None) -> None:
    """Deletes staged tables, all by default; call when no result that reads them is needed."""
    wanted = set(staged_paths() if paths is None else paths)
    for spark, path in [x for x in _staged if x[1] in wanted]:
        _staged.remove((spark, path))
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(release)


def parts_for(total: float, each: float, least: int = 1) -> int:
    """How many partitions hold ``total`` at about ``each`` apiece."""
    return max(least, math.ceil(total / each))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one pruned scan, one number to the driver."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
