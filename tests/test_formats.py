import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scatterlake.functions import formats as M
from scatterlake.sources.frames import pixels, read_frames


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(-200, 200), st.integers(-(2**33), 2**33)), max_size=60))
def test_byte_offset_round_trip(values):
    a = np.array(values, np.int64)
    assert M.byte_offset_decode(M.byte_offset_encode(a), len(a)).tolist() == values


def test_truncated_data_is_an_error():
    with pytest.raises(ValueError):
        M.byte_offset_decode(b"\x01", 3)


def test_files_of_all_formats(spark, tmp_path):
    image = (np.arange(12).reshape(3, 4) * 1000).astype("uint16")
    (tmp_path / "a.cbf").write_bytes(M.cbf_write(image))
    (tmp_path / "b.edf").write_bytes(M.edf_write(image))
    (tmp_path / "c.spe").write_bytes(M.spe_write(np.stack([image, image + 1])))
    (tmp_path / "d.dat").write_text("# head\n" + "\n".join(" ".join(map(str, r)) for r in image))
    got = {(r["path"][-5:], r["frame"]): np.array(r["data"]).reshape(r["rows"], r["columns"]) for r in read_frames(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("a.cbf", 0), ("b.edf", 0), ("c.spe", 0), ("c.spe", 1), ("d.dat", 0)]
    assert all((v == image + k[1]).all() for k, v in got.items())
    cut = pixels(read_frames(spark, str(tmp_path), rows=(1, 3), columns=(0, 2), glob="*.cbf")).orderBy("row", "col").collect()
    assert [(r["row"], r["col"], r["counts"]) for r in cut] == [(0, 0, 4000.0), (0, 1, 5000.0), (1, 0, 8000.0), (1, 1, 9000.0)]


def test_orientation_and_vtk():
    a = np.arange(6).reshape(2, 3)
    assert M.oriented(a, True, True, False).tolist() == [[2, 5], [1, 4], [0, 3]]
    assert M.vtk_vectors((2, 1, 1), np.zeros((2, 3))).count(b"\x00") == 24
