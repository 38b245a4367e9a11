"""Frames waited for, over several batches: gaps given up, late and repeated frames, final marks, a stream that stops on a mark."""

import datetime
import threading
import time

from pyspark.sql import functions as F

from scatterlake.streaming.live import run_available
from scatterlake.streaming.sink import MarkedTable
from scatterlake.streaming.waiting import _Frames, run_until, waited_frames

SCHEMA = "scan long, frame long, at timestamp, last boolean"


def _stream(spark, folder, batches):
    start = datetime.datetime(2024, 1, 1)
    for number, rows in enumerate(batches):
        data = [(s, f, None if t is None else start + datetime.timedelta(seconds=t), last) for s, f, t, last in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")
        time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def _statuses(df):
    return sorted((r.scan, r.frame, r.status) for r in df.collect())


def test_gaps_late_and_final_frames_over_batches(spark, tmp_path):
    batches = [
        [(1, 0, 0, None), (1, 2, 1, None), (2, 1, 1, None), (None, 5, 1, None), (1, None, 1, None)],
        [(1, 1, 5, None), (1, 2, 5, None), (3, 0, 5, True), (3, 4, 5, None)],  # 1 comes in time; 3 is closed at once
        [(1, 5, 10, None), (1, 5, 10, None), (2, 3, 11, None)],  # 3 and 4 of scan 1 are a gap
        [(4, 0, 60, False)],  # time passes: gaps of scans 1 and 2 are given up
        [(1, 4, 61, None), (1, 6, 62, True), (2, 0, 62, None), (3, 1, 62, None)],
    ]
    found = _statuses(run_available(waited_frames(_stream(spark, tmp_path / "in", batches), "scan", "frame", "at", F.col("last"), patience=20), "t"))
    assert found == [
        (1, 0, "released"), (1, 1, "released"), (1, 2, "late"), (1, 2, "released"), (1, 3, "missing"), (1, 4, "late"), (1, 4, "missing"),
        (1, 5, "released"), (1, 5, "repeated"), (1, 6, "final"),
        (2, 0, "late"), (2, 0, "missing"), (2, 1, "released"), (2, 2, "missing"), (2, 3, "released"),
        (3, 0, "final"), (3, 1, "late"), (3, 4, "late"),
        (4, 0, "released"),
    ]


def test_what_still_waits_is_not_told(spark, tmp_path):
    stream = _stream(spark, tmp_path / "in", [[(1, 1, 0, None)], [(1, 2, 5, None)]])
    assert _statuses(run_available(waited_frames(stream, "scan", "frame", "at", F.lit(None).cast("boolean"), patience=20), "t")) == []
    stream = _stream(spark, tmp_path / "first", [[(1, 1, 0, None)]])
    assert _statuses(run_available(waited_frames(stream, "scan", "frame", "at", F.col("last"), patience=20, first=1), "t")) == [(1, 1, "released")]


def test_calls_to_the_state_do_not_grow_with_the_frames():
    """Each is a round trip between processes: there are as many for 3 frames of a scan held behind gaps as for 300 of each of 20."""

    class State:
        def __init__(self):
            self.value, self.calls = None, 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name == "update":
                    self.value = args[0]
                return {"get": self.value, "exists": self.value is not None, "iterator": iter(())}.get(name)

            return call

    def calls(frames, scans):
        every = State()
        handle = type("Handle", (), {"getValueState": lambda *_: every, "getMapState": lambda *_: every, "registerTimer": every.registerTimer, "deleteTimer": every.deleteTimer})()
        watermark = type("Times", (), {"getCurrentWatermarkInMs": lambda self: self.now})()
        processor = _Frames(1000, 0)
        processor.init(handle)
        watermark.now = 0
        told = list(processor.handleInputRows((1,), [{"scan": s, "frame": 2 * i + 1, "at": 5, "final": False} for s in range(scans) for i in range(frames)], watermark))
        watermark.now = 5000
        told += list(processor.handleExpiredTimer((1,), watermark, None))
        assert [(r.scan, r.frame, r.status) for r in told] == [(s, i, "released" if i % 2 else "missing") for s in range(scans) for i in range(2 * frames)]
        return every.calls

    assert calls(3, 1) == calls(300, 20) <= 6


def test_stream_runs_until_the_stop_mark(spark, tmp_path):
    stream = _stream(spark, tmp_path / "in", [[(1, 0, 0, None)], [(1, 1, 1, None)]])
    table = MarkedTable(spark, f"file://{tmp_path}/out")
    mark = tmp_path / "stop"
    threading.Timer(4, mark.touch).start()
    began = time.time()
    last = run_until(stream, table.write, f"{tmp_path}/ck", f"file://{mark}", every="0 seconds", poll=0.1)
    assert time.time() - began >= 3.9 and table.batches() == list(range(last + 1))
    assert table.read(stream.schema).count() == 2
    # again, with the mark in place and a new file: only that is worked on
    spark.createDataFrame([(1, 2, None, None)], SCHEMA).write.parquet(f"{tmp_path}/in/new")
    run_until(stream, table.write, f"{tmp_path}/ck", f"file://{mark}", every="0 seconds")
    assert table.read(stream.schema, since=last).count() == 1
