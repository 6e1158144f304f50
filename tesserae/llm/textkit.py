"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch at a time, on the UTF-8 bytes of whole texts; nulls read as
empty texts. Fingerprints are 64-bit polynomial hashes over prefix sums, so the hash of any span of
bytes or of words costs one subtraction and one multiplication, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers and their inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Texts are handled in slices of about this many bytes, so that temporaries stay near 100 MB.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least; grown on demand and kept by the worker."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        up = np.full(size, U(BASE))
        down = np.full(size, U(pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the murmur3 finaliser)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Spans:
    """Prefix sums over a sequence of 64-bit values: the hash of values[a:b] in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self._down = _power_table(n + 1)
        self._sums = np.empty(n + 1, np.uint64)
        self._sums[0] = 0
        np.cumsum(values * up[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of each span; spans of equal values are equal wherever they stand."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of `width` values, by start; empty if there are fewer values."""
        n = len(self._sums) - width
        return mix((self._sums[width:] - self._sums[:-width]) * self._down[:n]) if n > 0 else np.empty(0, np.uint64)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: (first row, end row, bytes, offsets from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than x20 and x09-x0D: (starts, ends, first word of each text and the total)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SEPARATOR[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = ~word[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(word & edge[:-1])
    edge[:-1] = ~word
    edge[-1] = True
    edge[offsets] = True
    ends = np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice: (hashes, starts, ends, first word of each text and the total)."""
    starts, ends, bounds = words(data, offsets)
    values = BYTE_VALUES[LOWER[data] if lower else data]
    return Spans(values).hash(starts, ends), starts, ends, bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """For bounds of consecutive groups, the group of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
