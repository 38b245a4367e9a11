"""Files are told once they aren't empty and have rested."""

import os
import threading
import time

from scatterlake.sources.settled import _Settled, settled_files
from scatterlake.streaming.sink import MarkedTable
from scatterlake.streaming.waiting import run_until


def _aged(path, seconds, text="x"):
    path.write_text(text)
    os.utime(path, (time.time() - seconds,) * 2)


def test_empty_and_young_files_wait(tmp_path):
    reader = _Settled({"path": str(tmp_path), "age": "30", "suffix": ".cbf"})
    assert list(reader.read(reader.initialOffset())[0]) == []
    _aged(tmp_path / "a.cbf", 100)
    _aged(tmp_path / "empty.cbf", 100, "")
    _aged(tmp_path / "young.cbf", 5)
    _aged(tmp_path / ".hidden.cbf", 100)
    _aged(tmp_path / "a.txt", 100)
    rows, place = reader.read(reader.initialOffset())
    assert [os.path.basename(r[0]) for r in rows] == ["a.cbf"]
    assert list(reader.read(place)[0]) == [] and reader.read(place)[1] == place
    _aged(tmp_path / "empty.cbf", 40, "full")
    _aged(tmp_path / "twin.cbf", 40)
    later, end = reader.read(place)
    later = list(later)
    assert sorted(os.path.basename(r[0]) for r in later) == ["empty.cbf", "twin.cbf"]
    assert list(reader.readBetweenOffsets(place, end)) == later
    assert list(_Settled({"path": f"{tmp_path}/none"}).read(reader.initialOffset())[0]) == []


def test_stream_tells_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _aged(folder / "a", 100)
    stop = tmp_path / "stop"
    threading.Timer(3, lambda: _aged(folder / "b", 50, "more")).start()
    threading.Timer(8, stop.touch).start()
    table = MarkedTable(spark, f"file://{tmp_path}/out")
    stream = settled_files(spark, f"file://{folder}", age=10)
    run_until(stream, table.write, f"{tmp_path}/ck", f"file://{stop}", every="500 milliseconds", poll=0.1)
    assert sorted((os.path.basename(r.path), r.size) for r in table.read(stream.schema).collect()) == [("a", 1), ("b", 4)]
