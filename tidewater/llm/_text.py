"""Vectorised text primitives over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole slice of documents at once, so
no Python object is made for a word. Null texts count as empty ones here;
callers that tell the two apart look at the validity of the Arrow array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\v\f\r"
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array, nulls as empty strings."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


@lru_cache(4)
def table(separators: bytes = SPACES) -> np.ndarray:
    """True for the bytes that separate words."""
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


@lru_cache(1)
def punctuation() -> np.ndarray:
    """True for white space, control characters and ASCII punctuation."""
    out = np.ones(256, bool)
    out[128:] = False
    for a, b in ((48, 58), (65, 91), (97, 123)):
        out[a:b] = False
    return out


@lru_cache(1)
def lower() -> np.ndarray:
    """ASCII lower case by byte."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def words(buf: np.ndarray, offs: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words of all rows; where each row's words begin."""
    n = len(buf)
    gap = np.empty(n + 1, bool)
    gap[:n] = seps[buf]
    gap[n] = True
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge))
    ends = np.flatnonzero(~before[1:] & (gap[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hash of each word; with fold, ASCII case doesn't count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    x = (lower()[buf] if fold else buf).astype(np.uint64)
    x += np.uint64(1)
    x *= up[: len(buf)]
    np.cumsum(x, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every k successive word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1, 0xD1342543DE82EF95)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])
