"""Pre-tokens of byte-level BPE, found for a whole slice of texts at once, and a worker's cache of their ids.

The split is that of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
as class changes of code points: letters, numbers, white space and the rest.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import numpy as np

from .textkit import BYTE_VALUES, Spans

LETTER, NUMBER, SPACE = 1, 2, 3
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point; built once in a worker."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        # Code points with the Unicode property White_Space (fixed values).
        table[[*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _classes.append(table)
    return _classes[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places at which the pre-tokens of a slice start, and the first pre-token of each text and the total."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kind = classes()[points]
    m = len(points)
    edge = np.zeros(m + 1, bool)  # a text starts, or all end, here
    edge[np.searchsorted(lead, offsets)] = True
    space = kind == SPACE
    change = np.ones(m, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = change | edge[:-1]
    after_blank = np.zeros(m, bool)
    after_blank[1:] = points[:-1] == 32
    start &= ~(after_blank & ~space & ~edge[:-1])
    last = space.copy()  # the last white space before a word
    last[:-1] &= ~space[1:]
    last &= ~edge[1:]
    start |= last
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        ends = np.concatenate([edge, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~ends[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        pair = inside & ~ends[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, size in ((quote[short], 2), (quote[pair], 3)):
            start[at + 1] = False
            after = at + size
            start[after[after < m]] = True
    places = lead[start]
    return places, np.searchsorted(places, offsets)


def gather(flat: np.ndarray, bounds: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given groups, one after the other, and the first value of each and the total."""
    begin = bounds[entry].astype(np.int64)
    count = bounds[entry + 1] - begin
    total = np.concatenate([[0], np.cumsum(count)])
    return flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])], total


class Vocabulary:
    """Columns of values for pre-tokens, kept by hash; `of` is asked for new pre-tokens only.

    of(bytes joined, lengths) gives (flat values, bounds) for each column, such as ids. The bytes are kept
    too and compared, so pre-tokens of equal hashes never share values. Beyond `most` pre-tokens, or 1 GB of
    their bytes, the cache starts anew, so its size is bounded.
    """

    def __init__(self, of: Callable, kinds: tuple = (np.uint32,), most: int = 1 << 20):
        self._of, self._kinds, self._most = of, kinds, most
        self._clear()

    def _clear(self):
        self._keys, self._entry, self._size = np.empty(0, np.uint64), np.empty(0, np.int32), 0
        self.columns = [(np.empty(0, k), np.zeros(1, np.uint32)) for k in self._kinds]
        self._bodies = (np.empty(0, np.uint8), np.zeros(1, np.uint32))

    def _add(self, body: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of new entries for pre-tokens given as joined bytes and lengths."""
        found = [*self._of(body, length), (body, np.concatenate([[0], np.cumsum(length)]))]
        held = [*self.columns, self._bodies]
        held = [(np.concatenate([flat, more.astype(flat.dtype)]), np.concatenate([bounds, (int(bounds[-1]) + ends[1:]).astype(np.uint32)])) for (flat, bounds), (more, ends) in zip(held, found, strict=True)]
        self.columns, self._bodies = held[:-1], held[-1]
        self._size += len(length)
        return np.arange(self._size - len(length), self._size)

    def entries(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each pre-token that starts at `places`, its group in every column; they follow each other without a gap."""
        if not len(places):
            return np.empty(0, np.int64)
        ends = np.concatenate([places[1:], [len(data)]])
        h = Spans(BYTE_VALUES[data]).hash(places, ends)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if self._size + len(keys) > self._most or len(self._bodies[0]) > 1 << 30:
            self._clear()
        at = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self._keys):
            known = self._keys[np.minimum(at, len(self._keys) - 1)] == keys
        if not known.all():
            new = np.flatnonzero(~known)
            added = self._add(*_bodies(data, places[first[new]], ends[first[new]]))
            self._entry = np.insert(self._entry, at[new], added)
            self._keys = np.insert(self._keys, at[new], keys[new])
            at = np.searchsorted(self._keys, keys)
        entry = self._entry[at][inverse]
        body, bounds = self._bodies
        size = (bounds[entry + 1] - bounds[entry]).astype(np.int64)
        unlike = size != ends - places
        if not unlike.any():
            unlike = np.logical_or.reduceat(gather(body, bounds, entry)[0] != data[places[0] :], places - places[0])
        else:
            unlike |= np.array([not u and body[a : a + n].tobytes() != data[p : p + n].tobytes() for u, a, n, p in zip(unlike, bounds[entry], size, places, strict=True)])
        if unlike.any():  # another pre-token has the same hash
            which = np.flatnonzero(unlike)
            own = [data[a:b].tobytes() for a, b in zip(places[which], ends[which], strict=True)]
            number = {x: i for i, x in enumerate(dict.fromkeys(own))}
            added = self._add(np.frombuffer(b"".join(number), np.uint8), np.array([len(x) for x in number]))
            entry[which] = added[[number[x] for x in own]]
        return entry

    def ids(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pre-tokens that start at `places`, and the first id of each and the total."""
        entry = self.entries(data, places)
        return gather(*self.columns[0], entry)


def _bodies(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans joined, and their lengths."""
    length = end - start
    return data[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())], length
