"""Vectorised word spans and hashes over Arrow string columns.

Texts of a record batch stay in one byte buffer; words are found and hashed with
numpy, so no Python object is made per word.  A word is a maximal run of bytes
other than ``\\x20 \\x09-\\x0D`` (UTF-8 never holds those inside a character).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: list[np.ndarray] = []
_LIBC = ctypes.CDLL(None)


def slices(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges holding at most ``limit`` bytes of text (one row at least)."""
    offsets = _offsets(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
    release()


def release() -> None:
    """Give freed memory back to the system: workers are reused, and what each has ever taken would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def buffer(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of rows lo..hi with a newline after each, and each row's start and end.

    A null is an empty text.
    """
    offsets = _offsets(column)[lo : hi + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    shift = np.arange(hi - lo)
    return np.insert(data, offsets[1:], 10), offsets[:-1] + shift, offsets[1:] + shift


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends in white space."""
    space = _IS_SPACE[buf]
    edge = np.empty(len(buf), bool)
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def word_hashes(buf: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words, worked out block by block.

    ``values`` gives other numbers for the 256 bytes, and so another hash.
    """
    starts, ends = spans(buf)
    hashes = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = buf[base : ends[hi - 1]]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        number = part.astype(np.uint64) + np.uint64(1) if values is None else values[part]
        np.cumsum(up[: len(part)] * number, out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        hashes[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return starts, ends, hashes


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two hash arrays."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(31))))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive entries, built by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out: np.ndarray | None = None
    at, size, power = 0, 1, h
    while True:
        if n & size:
            piece = power[at:]
            out = piece if out is None else pair(out[: len(piece)], piece[: len(out)])
            at += size
        size *= 2
        if size > n:
            break
        power = pair(power[: len(power) - size // 2], power[size // 2 :])
    return out[: len(h) - n + 1]
