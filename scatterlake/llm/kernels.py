"""Vectorised text kernels: slices of texts, word spans, rolling hashes, minimizers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Fixed constants of the hash: an odd base, its inverse mod 2^64 and the mixer's multipliers.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
MASK = (1 << 64) - 1

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Anything but ASCII letters, digits and the bytes of other scripts.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i < n at least."""
    size = 1 << 20
    while size < n:
        size <<= 1
    return _powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h *= U64(MIX[0])
    h ^= h >> U64(33)
    h *= U64(MIX[1])
    h ^= h >> U64(33)
    return h


@dataclass
class Slices:
    """Pieces of texts, one after the other. Piece i is buf[starts[i]:starts[i + 1]],
    of row rows[i], beginning at byte skips[i] of the whole text."""

    buf: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    skips: np.ndarray


def text_slices(column: pa.Array, each: int = 1 << 19, overlap: int = 0) -> Iterator[Slices]:
    """The texts of an Arrow string or binary column in groups of about ``each`` bytes.

    A text longer than twice that is cut into pieces that share ``overlap``
    bytes, if ``overlap`` is given, and is a group of its own otherwise. Null
    counts as empty.
    """
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        size = ends[i + 1] - ends[i]
        if size > 2 * each:
            text = whole[ends[i] : ends[i + 1]]
            step = each if overlap else int(size)
            for skip in range(0, max(1, int(size) - overlap), step):
                piece = text[skip : skip + step + overlap]
                yield Slices(piece, np.array([0, len(piece)]), np.array([i]), np.array([skip]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + each, "right")) - 1)
        j = min(j, n)
        yield Slices(whole[ends[i] : ends[j]], ends[i : j + 1] - ends[i], np.arange(i, j), np.zeros(j - i, np.int64))
        i = j


def spans(buf: np.ndarray, starts: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of non-separators; runs stop where a piece stops."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = starts[starts < len(buf)]
    first[at] = inside[at]
    at = starts[starts > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (byte + 1) * BASE^j for j < i, mod 2^64."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, each: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span, a function of its bytes alone. Long buffers go in parts."""
    if len(buf) > 2 * each and len(begins) > 1:
        cuts = np.unique(np.searchsorted(begins, np.arange(0, len(buf) + each, each)))
        parts = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        low = [int(begins[a]) for a, _ in parts]
        return np.concatenate(
            [_span_hashes(buf[o : int(ends[b - 1])], begins[a:b] - o, ends[a:b] - o) for o, (a, b) in zip(low, parts, strict=True)]
        )
    return _span_hashes(buf, begins, ends)


def _span_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p = prefix(buf)
    return mix((p[ends] - p[begins]) * powers(len(buf) + 1)[1][begins])


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive token hashes, len(tokens) - k + 1 of them."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = powers(k + 1)[0]
    out = np.zeros(n, U64)
    for j in range(k):
        out += tokens[j : j + n] * p[j + 1]
    return mix(out)


def byte_gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive bytes."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = prefix(buf)
    return mix((p[k:] - p[:-k]) * powers(len(buf) + 1)[1][:n])


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, len(values) - w + 1 of them."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Where the leftmost least hash of each w consecutive ones stands.

    Equal windows have their minimizer at the same place in them, so matches
    are sought under it alone.
    """
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    # always 33 bits of hash and 31 of place, so that the choice depends on the window alone
    packed = ((hashes >> U64(31)) << U64(31)) | np.arange(len(hashes), dtype=U64)
    return (sliding_least(packed, w) & U64((1 << 31) - 1)).astype(np.int64)


def piece_of(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The piece in which each place lies."""
    return np.searchsorted(starts, at, "right") - 1
