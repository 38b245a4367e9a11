"""Detector file formats as bytes: CBF (byte offset), EDF, SPE, plain text; and VTK and ASCII exports."""

from __future__ import annotations

import re

import numpy as np

#: Fixed values of the formats: the mark before CBF data, EDF type names, SPE places and type codes.
CBF_MARK = b"\x0c\x1a\x04\xd5"
EDF_TYPES = {"SignedByte": "i1", "UnsignedByte": "u1", "SignedShort": "i2", "UnsignedShort": "u2", "SignedInteger": "i4", "UnsignedInteger": "u4",
             "SignedLong": "i4", "UnsignedLong": "u4", "Signed64": "i8", "Unsigned64": "u8", "FloatValue": "f4", "DoubleValue": "f8"}
SPE_HEADER, SPE_WIDTH, SPE_TYPE, SPE_HEIGHT, SPE_FRAMES = 4100, 42, 108, 656, 1446
SPE_TYPES = {0: "<f4", 1: "<i4", 2: "<i2", 3: "<u2"}


def byte_offset_encode(values: np.ndarray) -> bytes:
    """Differences in one byte; those that don't fit follow an escape in two, four or eight."""
    d = np.diff(values.astype(np.int64).ravel(), prepend=0)
    out, at = bytearray(), 0
    for i in np.flatnonzero(np.abs(d) > 127).tolist():
        out += d[at:i].astype(np.int8).tobytes()
        x = int(d[i])
        out += b"\x80"
        if abs(x) <= 32767:
            out += x.to_bytes(2, "little", signed=True)
        elif abs(x) <= 2**31 - 1:
            out += b"\x00\x80" + x.to_bytes(4, "little", signed=True)
        else:
            out += b"\x00\x80" + b"\x00\x00\x00\x80" + x.to_bytes(8, "little", signed=True)
        at = i + 1
    return bytes(out + d[at:].astype(np.int8).tobytes())


def byte_offset_decode(data: bytes, count: int) -> np.ndarray:
    """The first ``count`` values. Stretches between escapes are taken whole."""
    raw = np.frombuffer(data, np.int8)
    escapes = np.flatnonzero(raw == -128)
    parts, at, have, k = [], 0, 0, 0
    while have < count:
        k = int(np.searchsorted(escapes, at))
        stop = min(int(escapes[k]) if k < len(escapes) else len(raw), at + count - have)
        if stop > at:
            parts.append(raw[at:stop].astype(np.int64))
            have, at = have + stop - at, stop
        if have == count:
            break
        if at >= len(raw):
            raise ValueError(f"{count} values are announced, {have} are there")
        x, at = int.from_bytes(data[at + 1 : at + 3], "little", signed=True), at + 3
        if x == -32768:
            x, at = int.from_bytes(data[at : at + 4], "little", signed=True), at + 4
            if x == -(2**31):
                x, at = int.from_bytes(data[at : at + 8], "little", signed=True), at + 8
        parts.append(np.array([x], np.int64))
        have += 1
    return np.cumsum(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def cbf_write(image: np.ndarray) -> bytes:
    data = byte_offset_encode(image)
    head = (
        "###CBF: VERSION 1.5\r\ndata_image\r\n_array_data.data\r\n;\r\n--CIF-BINARY-FORMAT-SECTION--\r\n"
        'Content-Type: application/octet-stream;\r\n     conversions="x-CBF_BYTE_OFFSET"\r\nContent-Transfer-Encoding: BINARY\r\n'
        f"X-Binary-Size: {len(data)}\r\nX-Binary-Number-of-Elements: {image.size}\r\n"
        f"X-Binary-Size-Fastest-Dimension: {image.shape[1]}\r\nX-Binary-Size-Second-Dimension: {image.shape[0]}\r\n\r\n"
    )
    return head.encode() + CBF_MARK + data + b"\r\n--CIF-BINARY-FORMAT-SECTION----\r\n;\r\n"


def cbf_read(data: bytes) -> np.ndarray:
    at = data.index(CBF_MARK)
    head = data[:at].decode("latin-1")
    if "x-CBF_BYTE_OFFSET" not in head:
        raise ValueError("only byte-offset compression is read")
    field = lambda name: int(re.search(rf"{name}:\s*(\d+)", head)[1])
    columns, rows = field("X-Binary-Size-Fastest-Dimension"), field("X-Binary-Size-Second-Dimension")
    return byte_offset_decode(data[at + 4 : at + 4 + field("X-Binary-Size")], rows * columns).reshape(rows, columns)


def edf_write(image: np.ndarray) -> bytes:
    kind = next(k for k, v in EDF_TYPES.items() if np.dtype(v) == image.dtype)
    data = image.astype(image.dtype.newbyteorder("<")).tobytes()
    head = f"{{\nByteOrder = LowByteFirst ;\nDataType = {kind} ;\nDim_1 = {image.shape[1]} ;\nDim_2 = {image.shape[0]} ;\nSize = {len(data)} ;\n"
    return head.encode().ljust(-(-(len(head) + 2) // 1024) * 1024 - 2) + b"}\n" + data


def edf_read(data: bytes) -> np.ndarray:
    end = data.index(b"}") + 1
    end += 2 if data[end : end + 2] == b"\r\n" else 1
    fields = dict(re.findall(r"(\w+)\s*=\s*([^;]*?)\s*;", data[:end].decode("latin-1")))
    order = ">" if fields.get("ByteOrder") == "HighByteFirst" else "<"
    rows, columns = int(fields["Dim_2"]), int(fields["Dim_1"])
    return np.frombuffer(data, order + EDF_TYPES[fields["DataType"]], rows * columns, end).reshape(rows, columns)


def spe_write(frames: np.ndarray) -> bytes:
    code = next(k for k, v in SPE_TYPES.items() if np.dtype(v) == frames.dtype)
    head = bytearray(SPE_HEADER)
    for place, value, size in ((SPE_WIDTH, frames.shape[2], 2), (SPE_TYPE, code, 2), (SPE_HEIGHT, frames.shape[1], 2), (SPE_FRAMES, frames.shape[0], 4)):
        head[place : place + size] = value.to_bytes(size, "little")
    return bytes(head) + frames.tobytes()


def spe_read(data: bytes) -> np.ndarray:
    number = lambda place, size: int.from_bytes(data[place : place + size], "little")
    shape = (number(SPE_FRAMES, 4), number(SPE_HEIGHT, 2), number(SPE_WIDTH, 2))
    return np.frombuffer(data, SPE_TYPES[number(SPE_TYPE, 2)], int(np.prod(shape)), SPE_HEADER).reshape(shape)


def text_read(data: bytes) -> np.ndarray:
    """Rows of numbers; lines that begin with # are left out."""
    lines = [x for x in data.decode("latin-1").splitlines() if x.strip() and not x.startswith("#")]
    return np.array([[float(v) for v in x.split()] for x in lines])


def decode(name: str, data: bytes) -> np.ndarray:
    """A file's frames as (frame, row, column), by its extension."""
    readers = {"cbf": cbf_read, "edf": edf_read, "spe": spe_read, "dat": text_read, "txt": text_read}
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    image = readers[kind](data)
    return image if image.ndim == 3 else image[None]


def oriented(image: np.ndarray, transpose: bool = False, flip_rows: bool = False, flip_columns: bool = False) -> np.ndarray:
    image = image.T if transpose else image
    image = image[::-1] if flip_rows else image
    return image[:, ::-1] if flip_columns else image


def vtk_vectors(shape: tuple[int, int, int], vectors: np.ndarray, name: str = "vectors") -> bytes:
    """A legacy VTK file of structured points with one vector for each, x fastest."""
    nx, ny, nz = shape
    head = f"# vtk DataFile Version 2.0\n{name}\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} {nz}\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA {nx * ny * nz}\nVECTORS {name} float\n"
    return head.encode() + vectors.astype(">f4").tobytes() + b"\n"
