"""Words, word hashes and shingle hashes of whole texts, a batch of texts at a time in numpy.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased; in UTF-8 these bytes
occur only as the characters themselves. A word's identity is a 64-bit hash of its bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
"""Bytes handled at once, few enough for a core's cache; a longer text is handled in pieces that end between words."""

_U = np.uint64


def _lean() -> None:
    """Give freed memory back at once: workers live long, and large arrays come and go with each batch."""
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())
    except (OSError, AttributeError):  # another C library
        pass


_lean()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) on uint64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_COEF = mix(np.arange(1001, 1065, dtype=np.uint64)) | _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse, i < n, modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + (1 << 16))
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        if size <= 4 * PIECE:
            _powers[0] = have
    return have[0][:n], have[1][:n]


def _words_of(buf: np.ndarray, begins: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the bytes and each word's first byte; begins: where texts begin in buf.

    With prefixes, a row for each word: its hash and those of its first so many bytes (of all, if it has fewer).
    """
    if not len(buf):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, _U), np.zeros(0, np.int64)
    solid = ~_SPACE[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = True
    edge[1:-1] = ~solid[:-1]
    edge[begins] = True
    edge[-1] = True
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:-1] |= ~solid
    edge[0] = False
    ends = np.flatnonzero(solid & edge[1:]) + 1
    up, down = _power(len(buf))
    total = np.empty(len(buf) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[buf]] * up, out=total[1:])

    def upto(ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))

    if prefixes:
        return np.stack([upto(ends), *(upto(np.minimum(starts + n, ends)) for n in prefixes)], axis=1), starts
    return upto(ends), starts


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a string array; null counts as empty."""
    if tokens := sys.modules.get("recordloom.llm.tokens"):
        tokens.release()  # a worker that hashes words now is done with encoding
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def groups(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first text, end text, word hashes, bounds): runs of texts of about PIECE bytes.

    The words of text first + i are hashes[bounds[i]:bounds[i + 1]]; with prefixes, each has a row (see _words_of).
    """
    raw, off = _buffers(texts)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + PIECE, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        if off[hi] - off[lo] <= PIECE:
            buf = raw[off[lo] : off[hi]]
            begins = (off[lo : hi + 1] - off[lo]).astype(np.int64)
            hashes, starts = _words_of(buf, begins, prefixes)
            yield lo, hi, hashes, np.searchsorted(starts, begins)
        else:
            parts, at, end = [], int(off[lo]), int(off[hi])
            while at < end:
                cut = min(at + PIECE, end)
                while cut < end and not _SPACE[raw[cut]]:
                    after = np.flatnonzero(_SPACE[raw[cut : cut + PIECE]])
                    cut = cut + int(after[0]) if len(after) else min(cut + PIECE, end)
                parts.append(_words_of(raw[at:cut], np.zeros(1, np.int64), prefixes)[0])
                at = cut
            hashes = np.concatenate(parts)
            yield lo, hi, hashes, np.array([0, len(hashes)])
        lo = hi


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of width words; with fewer words, of the whole sequence as one."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(n, width)
    h = np.full(n - size + 1, _U(size), _U)
    for j in range(size):
        h += hashes[j : n - size + 1 + j] * _COEF[j]
    return mix(h)


def spark_xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64() of one bigint column, as uint64."""
    p1, p2, p3, p4, p5 = (_U(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    x = x.astype(np.int64, copy=False).view(_U)
    with np.errstate(over="ignore"):
        k = x * p2
        k = ((k << _U(31)) | (k >> _U(33))) * p1
        h = (_U(42) + p5 + _U(8)) ^ k
        h = ((h << _U(27)) | (h >> _U(37))) * p1 + p4
        h = (h ^ (h >> _U(33))) * p2
        h = (h ^ (h >> _U(29))) * p3
    return h ^ (h >> _U(32))


def in_bitmap(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether store.bitmap() may hold each value of x."""
    h = spark_xxhash64(x) & _U(len(bits) * 64 - 1)
    return ((bits[(h >> _U(6)).astype(np.int64)] >> (h & _U(63))) & _U(1)).astype(bool)
