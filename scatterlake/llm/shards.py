"""A table of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as runs of small parquet shards. Runs of similar size are
merged, without a shuffle, into files of a target size. Every change is one new
manifest, written aside and renamed to the next version: readers see a version
whole or not at all, and of two writers with the same version one fails, reads
the other's version and tries again. A writer announces its folder before it
writes and withdraws the note after its commit, so that clean-up never takes
files that a commit is about to name. The table's schema is the union of all
that was appended: a column that an append lacks is null there.

The commit needs a file system whose rename is atomic and refuses to overwrite
(HDFS, a local or network file system, object stores with a real directory
tree). A plain object store gives neither; keep the manifests elsewhere there.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scatterlake.llm.common import fresh_name

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: How often a change is tried anew after another writer has committed.
TRIES = 20
#: Seconds after which a writer that has neither committed nor ended counts as lost.
LEASE_S = 86_400


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Expired(RuntimeError):
    """A writer's lease ended before its commit; its files may be gone."""


def merged_schema(old: str | None, new: str) -> str:
    """JSON of the columns of both, in order, all nullable; names are compared in any case.

    ValueError where a column would change its type.
    """
    fields = {f.name.lower(): f for f in _typed(old).fields}
    for f in _typed(new).fields:
        known = fields.setdefault(f.name.lower(), f)
        if known.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in the table and {f.dataType.simpleString()} in the rows")
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()]).json()


def _typed(schema: str | None) -> StructType:
    return StructType.fromJson(json.loads(schema)) if schema else StructType([])


@dataclass(frozen=True)
class Run:
    """One append or merge: a folder of shards that never changes."""

    name: str
    shards: tuple[tuple[str, int], ...]  # (file, bytes)

    @property
    def size(self) -> int:
        return sum(n for _, n in self.shards)


@dataclass(frozen=True)
class Manifest:
    version: int
    runs: tuple[Run, ...]
    schema: str | None = None


class ShardTable:
    """A sharded table below ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, lease_s: float = LEASE_S):
        self.spark, self.root, self.target, self.fan_in, self.lease_s = spark, root.rstrip("/"), target_bytes, fan_in, lease_s
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("manifests", "writers"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    # files -----------------------------------------------------------------

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """(path below the root, bytes) of the parquet files below ``folder``."""
        found, listed = [], self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
        while listed.hasNext():
            status = listed.next()
            path = status.getPath()
            if path.getName().endswith(".parquet"):
                whole = path.toString()
                found.append((whole[whole.index(f"/{folder}") + 1 :], int(status.getLen())))
        return sorted(found)

    # writers ---------------------------------------------------------------

    @contextmanager
    def _writing(self) -> Iterator[str]:
        """A new folder for one run, announced to ``vacuum`` from before its first file until after its commit.

        A writer that fails takes its files with it. One that dies leaves its
        note, which ends after the lease.
        """
        name = uuid.uuid4().hex
        note = self._path(f"{self.root}/writers/{name}")
        self._fs.create(note, False).close()
        try:
            yield f"runs/{name}"
        except BaseException:
            self._fs.delete(self._path(f"{self.root}/runs/{name}"), True)
            self._fs.delete(note, False)
            raise
        self._fs.delete(note, False)

    def _still_writing(self, folder: str) -> None:
        """Expired, unless the writer's note stands."""
        if not self._fs.exists(self._path(f"{self.root}/writers/{folder.rsplit('/', 1)[1]}")):
            raise Expired(f"{folder} took longer than {self.lease_s:g} s")

    # manifests -------------------------------------------------------------

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Manifest(0, ())
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            raw = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        runs = tuple(Run(r["name"], tuple((f, n) for f, n in r["shards"])) for r in raw["runs"])
        return Manifest(raw["version"], runs, raw["schema"])

    def commit(self, old: Manifest, runs: tuple[Run, ...], schema: str | None) -> Manifest:
        """The next version after ``old``, or Conflict if that exists."""
        new = Manifest(old.version + 1, runs, schema)
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        try:
            out.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._path(f"{self.root}/manifests/v{new.version:010d}.json"), no_overwrite)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new.version} exists") from e
            raise
        return new

    # data ------------------------------------------------------------------

    def append(self, rows: DataFrame) -> Manifest:
        """``rows`` as one run of shards, one for each of its partitions that has rows."""
        return self.append_arrivals(rows, F.lit(0))

    def append_arrivals(self, rows: DataFrame, arrival: Column) -> Manifest:
        """One run for each value of ``arrival``, in its order with nulls first; written in one pass, committed as one version."""
        column, schema = fresh_name(rows, "__arrival"), rows.schema.json()
        merged_schema(self.manifest().schema, schema)  # fails before anything is written
        with self._writing() as folder:
            rows.withColumn(column, arrival.cast("int")).write.partitionBy(column).option("compression", "zstd").parquet(f"{self.root}/{folder}")
            by_arrival = defaultdict(list)
            for file, size in self._files(folder):
                by_arrival[file.rsplit("/", 2)[1]].append((file, size))
            number = lambda name: (0, 0) if name.endswith("__HIVE_DEFAULT_PARTITION__") else (1, int(name.partition("=")[2]))
            new = tuple(Run(f"{folder}/{name.partition('=')[2]}", tuple(by_arrival[name])) for name in sorted(by_arrival, key=number))
            self._still_writing(folder)
            return self._change(lambda old: (*old.runs, *new), schema)

    def _change(self, runs_of, schema: str | None = None) -> Manifest | None:
        """Commits ``runs_of(the last manifest)``, anew after a conflict; nothing if that is None."""
        for _ in range(TRIES):
            old = self.manifest()
            if (runs := runs_of(old)) is None:
                return None
            try:
                return self.commit(old, runs, merged_schema(old.schema, schema) if schema else old.schema)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} tries met other writers")

    def tier(self, run: Run) -> int:
        """Runs of one tier differ in size by less than the fan-in."""
        return int(math.log(max(run.size, 1), self.fan_in))

    def compact(self) -> Manifest:
        """Merges ``fan_in`` or more runs of one tier, or neighbouring ones, until no tier has that many.

        A merge reads the shards of its runs and writes files of about the
        target size; partitions are coalesced, so no row is shuffled. Files of
        a merge that another writer has overtaken are named by no manifest, and
        ``vacuum`` takes them.
        """
        while True:
            manifest = self.manifest()
            tiers = defaultdict(list)
            for run in manifest.runs:
                tiers[self.tier(run)].append(run)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)
            if full is None:
                return manifest
            merged = tiers[full]
            files = max(1, math.ceil(sum(r.size for r in merged) / self.target))
            gone = {r.name for r in merged}

            def swapped(old: Manifest, gone=gone) -> tuple[Run, ...] | None:
                if not gone <= {r.name for r in old.runs}:
                    return None
                return (*(r for r in old.runs if r.name not in gone), run)

            with self._writing() as folder:
                self._read(merged, manifest.schema).coalesce(files).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
                run = Run(folder, tuple(self._files(folder)))
                self._still_writing(folder)
                self._change(swapped)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes files and manifests that none of the last ``keep`` versions needs; how many files went.

        Files of writers at work stay, whatever the versions say: files are
        listed first, then the writers' notes, then the versions are read, so a
        run is either announced or committed when it is judged. Notes older
        than the lease are withdrawn. A reader of a version older than the last
        ``keep`` loses its files.
        """
        files = [f for f, _ in self._files("runs")]
        # the file system's own clock, against which the notes are dated
        probe = self._path(f"{self.root}/writers/.{uuid.uuid4().hex}")
        self._fs.create(probe, False).close()
        now = self._fs.getFileStatus(probe).getModificationTime()
        self._fs.delete(probe, False)
        writing = set()
        for status in self._fs.listStatus(self._path(f"{self.root}/writers")):
            if status.getPath().getName().startswith("."):
                continue
            if now - status.getModificationTime() > 1000 * self.lease_s:
                self._fs.delete(status.getPath(), False)
            else:
                writing.add(status.getPath().getName())
        versions = self.versions()
        live = {f for v in versions[-keep:] for r in self.manifest(v).runs for f, _ in r.shards}
        gone = [f for f in files if f not in live and f.split("/")[1] not in writing]
        for file in gone:
            self._fs.delete(self._path(f"{self.root}/{file}"), False)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        return len(gone)

    def _read(self, runs, schema: str | None) -> DataFrame:
        typed = _typed(schema)
        files = [f"{self.root}/{f}" for r in runs for f, _ in r.shards]
        if not files:
            return self.spark.createDataFrame([], typed)
        return self.spark.read.schema(typed).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default; an empty table without columns before the first."""
        manifest = self.manifest(version)
        return self._read(manifest.runs, manifest.schema)


def shard(rows: DataFrame, root: str, arrival: Column, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardTable:
    """``rows`` appended by ``arrival`` to the table at ``root``, compacted, old files deleted.

    Every row is in exactly one shard, with all its columns unchanged: nulls,
    empty and long texts, repeated rows. A null arrival is one of its own,
    the first. No rows: a version without shards. Rows that lack a column of
    the table have nulls there, and a new column is null in the older rows; a
    column of another type raises before anything is written. Other writers'
    files that aren't committed yet stay.
    """
    table = ShardTable(rows.sparkSession, root, target_bytes, fan_in)
    table.append_arrivals(rows, arrival)
    table.compact()
    table.vacuum()
    return table
