"""Vectorised word hashing over Arrow binary columns: one numpy pass over the bytes, no Python object per word.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]; A-Z hash like a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
C1, C2, C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * C2
    x ^= x >> U64(27)
    x *= C3
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * C1)


BYTE = stream(256, 1)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
BYTE[SPACE] = 0
_place = stream(256, 1 << 20) | U64(1)


def place(n: int) -> np.ndarray:
    """Odd multipliers for the first n bytes of a word; longer words extend the same stream."""
    global _place
    if len(_place) < n:
        _place = stream(max(n, 2 * len(_place)), 1 << 20) | U64(1)
    return _place


class Words:
    """hash: a 64-bit hash a word; start, length: its bytes in buf; bounds[i]:bounds[i+1]: the words of text i."""

    __slots__ = ("bounds", "buf", "hash", "length", "offsets", "start")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        inside = ~SPACE[buf]
        first, last = inside.copy(), inside.copy()
        if len(buf):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begins = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[begins] = inside[begins]  # a word never crosses from one text into the next
            ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        self.bounds = np.searchsorted(self.start, offsets)
        if not len(self.start):
            self.hash = np.empty(0, U64)
            return
        head = int(self.start[0])
        spans = np.diff(np.append(self.start, len(buf)))
        at = np.arange(len(buf) - head) - np.repeat(self.start - head, spans)
        value = BYTE[buf[head:]]
        value *= place(int(spans.max()))[at]
        self.hash = mix(np.add.reduceat(value, self.start - head) + self.length.astype(U64) * C1)


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow binary array, without a copy; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def slices(col: pa.Array, most: int = 1 << 20, rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most `rows` rows with about `most` bytes: first row, end row, their bytes, their offsets. A longer text comes alone and whole."""
    if not len(col):
        return
    data, offsets = binary_parts(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def grams(hashes: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hashes of all runs of n consecutive words; runs that leave a text are the caller's to skip."""
    if len(hashes) < n:
        return np.empty(0, U64)
    m = stream(n, seed) | U64(1)
    out = np.zeros(len(hashes) - n + 1, U64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * m[k]
    return mix(out)
