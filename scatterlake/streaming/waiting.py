"""Waiting for frames: in order, with patience for gaps, until the final one has come."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Scans of neighbouring numbers that share a state.
SCANS = 64
STATE = "timer long, scans array<struct<scan: long, next: long, closed: boolean, frames: array<long>, times: array<long>, finals: array<boolean>>>"


class _Frames(StatefulProcessor):
    """State of SCANS scans: of each the next frame and whether it is closed, and frames held behind a gap with the time they came.

    All of it is one value, read and written whole: each call to the state is a
    round trip between processes, which takes longer than the work on a scan.
    """

    def __init__(self, patience_ms: int, first: int):
        self.patience, self.first = patience_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, scans = self._state()
        now = timerValues.getCurrentWatermarkInMs()
        # by number within a batch: what came together isn't late to itself
        for scan, some in groupby(sorted(rows, key=lambda r: (r["scan"], r["frame"], r["at"])), key=lambda r: r["scan"]):
            start, closed, behind = scans.get(scan, (self.first, False, {}))
            # gaps whose time is up go before what comes now, whatever the batches
            out, start, closed = self._give_up(scan, start, closed, behind, now)
            yield from out
            for row in some:
                frame = row["frame"]
                if closed or frame < start:
                    yield Row(scan=scan, frame=frame, status="late")
                elif frame in behind:
                    yield Row(scan=scan, frame=frame, status="repeated")
                else:
                    behind[frame] = (row["at"], row["final"])
                    out, start, closed = self._release(scan, start, behind)
                    yield from out
            scans[scan] = (start, closed, behind)
        self._keep(timer, scans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, scans = self._state()
        now = timerValues.getCurrentWatermarkInMs()
        for scan, (start, closed, behind) in scans.items():
            out, start, closed = self._give_up(scan, start, closed, behind, now)
            yield from out
            scans[scan] = (start, closed, behind)
        self._keep(-1 if timer <= now else timer, scans)

    def _state(self) -> tuple[int, dict[int, tuple[int, bool, dict[int, tuple[int, bool]]]]]:
        known = self.known.get()
        if known is None:
            return -1, {}
        timer, scans = known
        return timer, {scan: (start, closed, {f: (at, final) for f, at, final in zip(*held, strict=True)}) for scan, start, closed, *held in scans}

    def _give_up(self, scan: int, start: int, closed: bool, behind: dict, now: int) -> tuple[list[Row], int, bool]:
        """Everything up to the last frame that has waited long enough; what lacks before it is missing."""
        due = max((f for f, (at, _) in behind.items() if at + self.patience <= now), default=-1)
        out: list[Row] = []
        while not closed and behind and start <= due:
            nearest = min(behind)
            out += [Row(scan=scan, frame=gap, status="missing") for gap in range(start, nearest)]
            told, start, closed = self._release(scan, nearest, behind)
            out += told
        return out, start, closed

    def _release(self, scan: int, start: int, behind: dict) -> tuple[list[Row], int, bool]:
        out = []
        while start in behind:
            _, final = behind.pop(start)
            out.append(Row(scan=scan, frame=start, status="final" if final else "released"))
            start += 1
            if final:
                # whatever was numbered beyond the final frame comes too late
                out += [Row(scan=scan, frame=f, status="late") for f in sorted(behind)]
                behind.clear()
                return out, start, True
        return out, start, False

    def _keep(self, timer: int, scans: dict) -> None:
        due = min((at for *_, behind in scans.values() for at, _ in behind.values()), default=-1 - self.patience) + self.patience
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        held = [(scan, start, closed, list(behind), [at for at, _ in behind.values()], [final for _, final in behind.values()]) for scan, (start, closed, behind) in scans.items()]
        self.known.update((due, held))

    def close(self) -> None:
        pass


def waited_frames(stream: DataFrame, scan: str, frame: str, at: str, final: Column, patience: float, disorder: str = "0 seconds", first: int = 0) -> DataFrame:
    """(scan, frame, status) of a stream of frames, numbered from ``first`` within each scan.

    A frame is ``released`` once all before it were; one behind a gap waits
    until the watermark of ``at``, the time of arrival, is ``patience`` seconds
    past its own: then all that lacks before it is ``missing``. The final frame closes its scan
    and is ``final``. Frames that were given up, released already or numbered
    past the final one are ``late``, a second copy of a waiting one is
    ``repeated``. Arrivals more than ``disorder`` behind the newest are dropped
    by the watermark. State holds the waiting frames of open scans and an entry
    for each scan ever seen, so that a closed one stays closed. Rows with null
    scan, frame or time are left out, a null mark isn't final; no rows, none.
    """
    stream.sparkSession.conf.set(STORE, ROCKS)
    whole = F.col(scan).isNotNull() & F.col(frame).isNotNull() & F.col(at).isNotNull()
    rows = stream.where(whole).select(
        F.col(scan).cast("long").alias("scan"), F.col(frame).cast("long").alias("frame"), F.col(at).cast("timestamp").alias("__time"), F.coalesce(final, F.lit(False)).alias("final")
    )
    rows = rows.withWatermark("__time", disorder).withColumn("at", F.unix_millis("__time"))
    rows = rows.withColumn("__share", F.floor(F.col("scan") / SCANS))
    return rows.groupBy("__share").transformWithState(_Frames(int(patience * 1000), first), "scan long, frame long, status string", "append", "eventTime")


def run_until(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, stop: str, every: str = "2 seconds", poll: float = 0.5) -> int:
    """Runs a stream batch by batch until the file ``stop`` appears, then what is at hand, and ends; the number of the last batch.

    ``write`` takes a batch and its number, as ``MarkedTable.write``. A failed
    batch raises; a new call with the same ``checkpoint`` goes on where it stopped.
    """
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stop)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        while not fs.exists(path):
            if query.awaitTermination(poll):
                break
        query.processAllAvailable()
        return query.lastProgress["batchId"] if query.lastProgress else -1
    finally:
        query.stop()
