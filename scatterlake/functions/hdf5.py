"""HDF5 files as bytes: groups, contiguous and chunked datasets read by range, and files of frames written.

Read: superblocks 0 to 3, object headers 1 and 2, symbol tables and compact
links, compact, contiguous and B-tree chunked layouts, integers and floats, the
filters shuffle, deflate and Fletcher-32 (not verified). Anything else raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Fixed values of the format: signature, undefined address, message types, filters, tree widths.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = 2**64 - 1
DATASPACE, DATATYPE, FILL, LINK, LAYOUT, FILTERS, CONTINUED, SYMBOLS, LINK_INFO = 0x1, 0x3, 0x5, 0x6, 0x8, 0xB, 0x10, 0x11, 0x2
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
LEAF_K, GROUP_K, CHUNK_K = 4, 16, 32

#: Contiguous data are read in blocks of about this many bytes.
BLOCK = 1 << 20


class Chunk(NamedTuple):
    offset: tuple[int, ...]
    shape: tuple[int, ...]
    address: int
    size: int
    mask: int


class Dataset(NamedTuple):
    shape: tuple[int, ...]
    dtype: np.dtype
    kind: str
    address: int
    chunk: tuple[int, ...]
    filters: list[tuple[int, list[int]]]
    inline: bytes = b""


class Hdf5File:
    """A file behind ``read_at(size, offset)``, as of pyarrow's random access files."""

    def __init__(self, source):
        self._source, self.base, at = source, 0, 0
        while (head := source.read_at(96, at))[:8] != SIGNATURE:
            if len(head) < 8:
                raise ValueError("no HDF5 signature")
            at = at * 2 or 512
        version = head[8]
        sizes = head[13:15] if version < 2 else head[9:11]
        if version > 3 or sizes != b"\x08\x08":
            raise ValueError(f"superblock {version} with sizes {tuple(sizes)} isn't read")
        if version < 2:
            start = 24 if version == 0 else 28
            self.base = struct.unpack_from("<Q", head, start)[0]
            self.root = struct.unpack_from("<Q", head, start + 40)[0]
        else:
            self.base, self.root = struct.unpack_from("<Q", head, 12)[0], struct.unpack_from("<Q", head, 36)[0]

    def read(self, at: int, size: int) -> bytes:
        data = self._source.read_at(size, self.base + at)
        if len(data) < size:
            raise ValueError(f"HDF5 file ends at {at + len(data)}, wanted {at + size}")
        return data

    def _messages(self, address: int) -> list[tuple[int, bytes]]:
        head = self._source.read_at(64, self.base + address)
        new, found = head[:4] == b"OHDR", []
        if new:
            flags, at = head[5], 6 + 16 * bool(head[5] & 32) + 4 * bool(head[5] & 16)
            width = 1 << (flags & 3)
            blocks = [(address + at + width, int.from_bytes(head[at : at + width], "little"))]
            prefix = 4 + 2 * bool(flags & 4)
        else:
            if head[0] != 1:
                raise ValueError(f"object header {head[0]} isn't read")
            blocks, prefix = [(address + 16, struct.unpack_from("<I", head, 8)[0])], 8
        while blocks:
            start, size = blocks.pop(0)
            block, at = self.read(start, size), 0
            while at + prefix <= size:
                kind, length, flags = struct.unpack_from("<BHB" if new else "<HHB", block, at)
                body = block[at + prefix : at + prefix + length]
                at += prefix + length
                if flags & 2:
                    raise ValueError("shared messages aren't read")
                if kind == CONTINUED:
                    there, length = struct.unpack("<QQ", body[:16])
                    blocks.append((there + 4, length - 8) if new else (there, length))
                else:
                    found.append((kind, body))
        return found

    def members(self, address: int) -> dict[str, int]:
        """Names of a group and the addresses of their object headers; soft links are left out."""
        found: dict[str, int] = {}
        for kind, body in self._messages(address):
            if kind == SYMBOLS:
                tree, heap = struct.unpack("<QQ", body[:16])
                size, _, data = struct.unpack("<QQQ", self.read(heap + 8, 24))
                names = self.read(data, size)
                for node in self._leaves(tree):
                    count = struct.unpack("<H", self.read(node + 6, 2))[0]
                    for name, header, cached in struct.iter_unpack("<QQI20x", self.read(node + 8, 40 * count)):
                        if cached != 2:
                            found[names[name : names.index(b"\0", name)].decode()] = header
            elif kind == LINK:
                flags, at = body[1], 2
                soft = bool(flags & 8) and body[2] != 0
                at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                length = int.from_bytes(body[at : at + width], "little")
                at += width
                if not soft:
                    found[body[at : at + length].decode()] = struct.unpack_from("<Q", body, at + length)[0]
            elif kind == LINK_INFO and struct.unpack_from("<Q", body, 2 + 8 * (body[1] & 1))[0] != UNDEFINED:
                raise ValueError("groups with dense links aren't read")
        return found

    def _leaves(self, address: int) -> Iterator[int]:
        head = self.read(address, 24)
        count = struct.unpack_from("<H", head, 6)[0]
        body = self.read(address + 24, 16 * count + 8)
        for i in range(count):
            child = struct.unpack_from("<Q", body, 16 * i + 8)[0]
            yield from self._leaves(child) if head[5] else [child]

    def dataset(self, path: str) -> Dataset:
        """The dataset at an absolute path; KeyError if there is none."""
        address = self.root
        for name in filter(None, path.split("/")):
            address = self.members(address)[name]
        shape, dtype, place, filters = (), None, None, []
        for kind, body in self._messages(address):
            if kind == DATASPACE:
                shape = struct.unpack_from(f"<{body[1]}Q", body, 8 if body[0] == 1 else 4)
            elif kind == DATATYPE:
                dtype = _dtype(body)
            elif kind == LAYOUT:
                place = body
            elif kind == FILTERS:
                filters = _filters(body)
        if dtype is None or place is None:
            raise KeyError(f"{path} is no dataset")
        if place[0] != 3:
            raise ValueError(f"layout {place[0]} isn't read")
        if place[1] == 0:
            return Dataset(shape, dtype, "compact", UNDEFINED, shape, [], place[4 : 4 + struct.unpack_from("<H", place, 2)[0]])
        if place[1] == 1:
            return Dataset(shape, dtype, "contiguous", struct.unpack_from("<Q", place, 2)[0], shape, [])
        rank = place[2] - 1
        return Dataset(shape, dtype, "chunked", struct.unpack_from("<Q", place, 3)[0], struct.unpack_from(f"<{rank}I", place, 11), filters)

    def chunks(self, data: Dataset, first: int = 0, last: int | None = None) -> Iterator[Chunk]:
        """Stored chunks that touch ``first <= i < last`` of the first axis; nodes of the index that can't are not read.

        Contiguous data come in blocks of whole entries. What was never written has no chunk.
        """
        n = data.shape[0] if data.shape else 1
        last = n if last is None else min(last, n)
        if first >= last or data.address == UNDEFINED and data.kind != "compact":
            return
        if data.kind == "compact":
            yield Chunk((0,) * len(data.shape), data.shape, UNDEFINED, len(data.inline), 0)
        elif data.kind == "contiguous":
            entry = data.dtype.itemsize * int(np.prod(data.shape[1:], dtype=np.int64))
            step = max(1, BLOCK // max(1, entry))
            for at in range(first - first % step, last, step):
                many = min(step, n - at)
                yield Chunk((at,) + (0,) * (len(data.shape) - 1), (many, *data.shape[1:]) if data.shape else (), data.address + at * entry, many * entry, 0)
        else:
            yield from self._chunks(data, data.address, first, last)

    def _chunks(self, data: Dataset, address: int, first: int, last: int) -> Iterator[Chunk]:
        rank = len(data.chunk)
        head = self.read(address, 24)
        level, count = head[5], struct.unpack_from("<H", head, 6)[0]
        key = struct.Struct(f"<II{rank + 1}Q")
        body = self.read(address + 24, count * (key.size + 8) + key.size)
        keys = [key.unpack_from(body, i * (key.size + 8)) for i in range(count + 1)]
        for i in range(count):
            child = struct.unpack_from("<Q", body, i * (key.size + 8) + key.size)[0]
            start = keys[i][2]
            if level:
                if start < last and keys[i + 1][2] + data.chunk[0] > first:
                    yield from self._chunks(data, child, first, last)
            elif start < last and start + data.chunk[0] > first:
                yield Chunk(keys[i][2 : 2 + rank], data.chunk, child, keys[i][0], keys[i][1])

    def load(self, data: Dataset, chunk: Chunk) -> np.ndarray:
        """The values of a chunk, cut to the dataset where it reaches beyond."""
        raw = data.inline if data.kind == "compact" else self.read(chunk.address, chunk.size)
        for i, (kind, values) in reversed(list(enumerate(data.filters))):
            if chunk.mask >> i & 1:
                continue
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == SHUFFLE:
                raw = np.frombuffer(raw, np.uint8).reshape(values[0], -1).T.tobytes()
            elif kind == FLETCHER:
                raw = raw[:-4]
            else:
                raise ValueError(f"filter {kind} isn't read")
        whole = np.frombuffer(raw, data.dtype).reshape(chunk.shape)
        return whole[tuple(slice(0, max(0, n - o)) for n, o in zip(data.shape, chunk.offset, strict=True))]

    def values(self, data: Dataset, first: int, last: int) -> np.ndarray:
        """Entries ``first <= i < last`` of a dataset of one axis; what was never written is 0."""
        out = np.zeros(last - first, data.dtype)
        for chunk in self.chunks(data, first, last):
            at = chunk.offset[0]
            part = self.load(data, chunk)
            a, b = max(at, first), min(at + len(part), last)
            out[a - first : b - first] = part[a - at : b - at]
        return out


def _dtype(body: bytes) -> np.dtype:
    kind, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1 and size in (2, 4, 8):
        return np.dtype(f"{order}f{size}")
    raise ValueError(f"datatype class {kind} of {size} bytes isn't read")


def _filters(body: bytes) -> list[tuple[int, list[int]]]:
    found, old = [], body[0] == 1
    at = 8 if old else 2
    for _ in range(body[1]):
        kind = struct.unpack_from("<H", body, at)[0]
        named = old or kind >= 256
        name = struct.unpack_from("<H", body, at + 2)[0] if named else 0
        at += 4 if named else 2
        _, count = struct.unpack_from("<HH", body, at)
        at += 4 + (name + 7 & ~7 if old else name)
        found.append((kind, list(struct.unpack_from(f"<{count}I", body, at))))
        at += 4 * count + (4 if old and count % 2 else 0)
    return found


class _Image:
    """A file that grows; every piece starts at a multiple of eight."""

    def __init__(self):
        self.data = bytearray(96)

    def put(self, piece: bytes) -> int:
        at = len(self.data)
        self.data += piece + bytes(-len(piece) % 8)
        return at

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b""
        for kind, message in messages:
            message += bytes(-len(message) % 8)
            body += struct.pack("<HHB3x", kind, len(message), 0) + message
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def group(self, members: dict[str, int]) -> int:
        if len(members) > 2 * LEAF_K:
            raise ValueError("a written group has at most eight members")
        heap, entries, place = bytearray(8), b"", 0
        for name in sorted(members):
            place = len(heap)
            heap += name.encode() + bytes(8 - len(name.encode()) % 8)
            entries += struct.pack("<QQI20x", place, members[name], 0)
        names = self.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(heap), 1, len(self.data) + 32) + heap)
        node = self.put(struct.pack("<4sBxH", b"SNOD", 1, len(members)) + entries.ljust(40 * 2 * LEAF_K, b"\0"))
        tree = struct.pack("<4sBBHQQ", b"TREE", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, node, place)
        return self.header([(SYMBOLS, struct.pack("<QQ", self.put(tree.ljust(24 + 8 * (4 * GROUP_K + 1), b"\0")), names))])

    def index(self, stored: list[tuple[int, int, int]], chunk: tuple[int, ...]) -> int:
        """The B-tree over (first entry, size, address) of chunks that span all later axes."""
        rest = (0,) * len(chunk)
        key = lambda size, first: struct.pack(f"<II{len(chunk) + 1}Q", size, 0, first, *rest)
        level, end = 0, stored[-1][0] + chunk[0]
        width = 24 + (2 * CHUNK_K + 1) * len(key(0, 0)) + 2 * CHUNK_K * 8
        while True:
            groups = [stored[i : i + 2 * CHUNK_K] for i in range(0, len(stored), 2 * CHUNK_K)]
            start, above = len(self.data), []
            size = width + -width % 8
            for i, group in enumerate(groups):
                left = start + (i - 1) * size if i else UNDEFINED
                right = start + (i + 1) * size if i + 1 < len(groups) else UNDEFINED
                node = struct.pack("<4sBBHQQ", b"TREE", 1, level, len(group), left, right)
                node += b"".join(key(n, first) + struct.pack("<Q", address) for first, n, address in group)
                node += key(0, groups[i + 1][0][0] if i + 1 < len(groups) else end)
                above.append((group[0][0], group[0][1], self.put(node.ljust(width, b"\0"))))
            if len(above) == 1:
                return above[0][2]
            stored, level = above, level + 1


def _type_message(dtype: np.dtype) -> bytes:
    bits = 8 * dtype.itemsize
    if dtype.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, 8 * (dtype.kind == "i"), 0, 0, dtype.itemsize, 0, bits)
    exponent, mantissa, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[dtype.itemsize]
    return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, bits - 1, 0, dtype.itemsize, 0, bits, mantissa, exponent, 0, mantissa, bias)


def frame_file(frames: np.ndarray, labels: np.ndarray, per_chunk: int = 1) -> bytes:
    """A file with ``/entry/data`` (frame, row, column), shuffled and deflated by chunks of whole frames, and ``/entry/label``."""
    n, kind = len(frames), frames.dtype.newbyteorder("<")
    image, chunk, stored = _Image(), (per_chunk, *frames.shape[1:]), []
    for first in range(0, n, per_chunk):
        part = np.zeros(chunk, kind)
        part[: min(per_chunk, n - first)] = frames[first : first + per_chunk]
        packed = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, kind.itemsize).T.tobytes(), 4)
        stored.append((first, len(packed), image.put(packed)))
    fill = (FILL, struct.pack("<BBBB", 2, 3, 0, 0))
    space = lambda shape: (DATASPACE, struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape))
    pipeline = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", SHUFFLE, 0, 1, 1, kind.itemsize, 0) + struct.pack("<HHHHII", DEFLATE, 0, 1, 1, 4, 0)
    tree = image.index(stored, chunk)
    layout = struct.pack("<BBBQ4I", 3, 2, 4, tree, *chunk, kind.itemsize)
    data = image.header([space(frames.shape), (DATATYPE, _type_message(kind)), fill, (FILTERS, pipeline), (LAYOUT, layout)])
    place = image.put(np.ascontiguousarray(labels, "<i8").tobytes())
    label = image.header([space((n,)), (DATATYPE, _type_message(np.dtype("<i8"))), fill, (LAYOUT, struct.pack("<BBQQ", 3, 1, place, 8 * n))])
    root = image.group({"entry": image.group({"data": data, "label": label})})
    head = SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, LEAF_K, GROUP_K, 0)
    head += struct.pack("<QQQQ", 0, UNDEFINED, len(image.data), UNDEFINED) + struct.pack("<QQII16x", 0, root, 0, 0)
    image.data[:96] = head
    return bytes(image.data)
