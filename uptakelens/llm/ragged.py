"""Texts of an Arrow column as one array of bytes with offsets, for work by the column."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more than texts); null is empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "") if column.null_count else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[pa.Array]:
    """The column in runs of texts of about `most` bytes, to bound what the arrays made from
    them take; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(column):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        yield column.slice(begin, end - begin)
        begin = end


def released() -> None:
    """Give memory that was freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBRARY, "malloc_trim"):  # where the C library is glibc
        _LIBRARY.malloc_trim(0)


_LIBRARY = ctypes.CDLL(None)
_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between batches. It keeps one thing: workers serve one stage
    after the other, and what an earlier one needed goes."""
    if key not in _HELD:
        _HELD.clear()
        released()
        _HELD[key] = make()
    return _HELD[key]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values stirred by a bijection (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


#: Spans of more bytes than this are hashed one by one, by a cryptographic hash.
_SHORT = 64


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: eight bytes at a time, stirred after each, so that no
    pattern of letters makes two spans alike (sums of powers have such patterns)."""
    size = end - begin
    out = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    rows = np.flatnonzero((size > 0) & (size <= _SHORT))
    for k in range(0, _SHORT, 8):
        if k:
            rows = rows[size[rows] > k]
        if not len(rows):
            break
        blank = (8 * (8 - np.minimum(size[rows] - k, 8))).astype(np.uint64)
        chunk = wide[begin[rows] + k] << blank
        out[rows] = mixed((out[rows] ^ chunk) + np.uint64(_BASE))
    for i in np.flatnonzero(size > _SHORT).tolist():
        own = hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(own, "little")
    return out


def gram_hashes(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n bytes that lies within one text, and the text's number."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        value = value * np.uint64(_BASE) + _BYTE_VALUES[data[i : len(data) - n + 1 + i]]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(value)]
    inside = np.arange(len(value)) + n <= at[1:][text]
    return mixed(value[inside] + np.uint64(n)), text[inside]


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes that are no gap, cut at the ends of texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(data), bool)
    first[at[:-1][at[:-1] < len(data)]] = True
    inside = ~gap
    begin = inside.copy()
    begin[1:] &= gap[:-1] | first[1:]
    last = inside.copy()
    last[:-1] &= gap[1:] | first[1:]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1
