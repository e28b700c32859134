"""Words of whole Arrow columns at once, as byte ranges and hashes, with numpy.

UTF-8 keeps bytes below 0x80 for ASCII, so words that are split at ASCII
characters can be found and hashed byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 20
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a fixed permutation)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, U64(self.base), U64), np.full(size, U64(_inverse(self.base)), U64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(int(_BASE)), _Powers(int(_STEP))
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * _BASE)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between white space.
SPACED = ~_IS_SPACE
#: Bytes of words of letters and digits; all of non-ASCII counts as letters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of some texts: bytes, where each word starts and ends, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _BYTE_POWERS.get(max(n, 1))
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUES[self.data] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first text, text after the last, their words), a slice of the column at a time."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        own = data[offsets[lo] : offsets[hi]]
        yield lo, hi, _split(_LOWER[own] if lower else own, offsets[lo : hi + 1] - offsets[lo], kind)
        lo = hi


def _split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    inside = kind[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(data, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of each window of ``width`` words that lies within one text,
    and the place of its first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    up, down = _WORD_POWERS.get(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + width <= ends)
    return mix((sums[at + width] - sums[at]) * down[at]), at


def covered(n: int, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """True for each of ``n`` words inside a window that starts at one of ``at``."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return np.cumsum(marks[:-1]) > 0
