"""Removal of repeated byte passages by a common-prefix-aware distributed merge sort of suffixes.

Texts are UTF-8 bytes. Every byte covered by a string of `length` bytes that also starts in a document
with a smaller doc_id goes; strings are judged on the input, and none crosses documents.

1. Sparse suffixes: in each window of `length` bytes, the `GRAM`-byte string with the smallest hash is
   its anchor. Equal windows have equal anchors, so only suffixes at anchors (about one in 16) matter.
2. Distinguishing prefixes: the first GRAM bytes of a suffix, hashed, say whether it can share a window
   with another document; suffixes which cannot are never exchanged.
3. Each task sorts the remaining suffixes, cut at `length` bytes, into runs, one for each bucket of
   anchors. A run is front-coded: each suffix is its common prefix with the one before and the rest.
   Equal suffixes with equal bytes before them are one entry with the places where they stand.
4. A bucket merges its runs with a loser tree that carries common prefix lengths: suffixes with
   different known prefixes are ordered by these lengths alone, and equal ones are compared only
   beyond them. The lengths come out with the merged order as its LCP array.
5. Runs of the LCP array, with fingerprints of the bytes before the anchors, are classes of equal
   windows; a class's smallest document keeps them, the others are told what to remove.

Nulls are empty texts: n_bytes 0. A null doc_id sorts after every id, and none before another. doc_id names
a text: repeated rows of one doc_id are equal documents with equal ids, so neither removes from the other
(should one id hold unlike texts, both are cut at the places found for either). Other columns are ignored
unless they are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import partitions, roomy, small_batches
from .repeats import BLOCK, FLUSH, U, batch, beside, bucket_of, cut, ids_back, marks, meet, rank, reply, texts, together
from .textkit import BYTE_VALUES, Spans, mix

GRAM = 20


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (hash of the anchor, text, anchor, first and last window start)."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, U), none, none, none, none
    h = Spans(BYTE_VALUES[data]).windows(GRAM)
    low = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low & U(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
    anchor = anchor[start]
    head = np.ones(len(start), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(start)]]) - 1 if len(first) else first
    return h[anchor[first]], row[first], anchor[first], start[first], start[last]


def _marks(length: int):
    def of(data, offsets):
        h, row, _, _, _ = anchored(data, offsets, length)
        return h, row, np.ones(len(h), bool)

    return of


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _unpack(block: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    at = np.concatenate([[0], np.cumsum(sizes)]) + 8 * len(kinds)
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(at[:-1], at[1:], kinds, strict=True)]


def _rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, right: bool = False) -> np.ndarray:
    """Spans as rows of `width` bytes, padded with zeros behind (or before)."""
    column = np.arange(width)
    at = start[:, None] + (column - (width - size[:, None]) if right else column)
    inside = (column >= width - size[:, None]) if right else (column < size[:, None])
    return np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))], np.uint8(0))


def _suffix_order(suffix: np.ndarray, size: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(suffix), -(-suffix.shape[1] // 8) * 8), np.uint8)
    padded[:, : suffix.shape[1]] = suffix
    keys = padded.view(">u8").astype(U)
    return np.lexsort([size, *keys.T[::-1]])


def _run(suffix, size, before, bsize, doc, at) -> bytes:
    """One front-coded sorted run with the places of each entry."""
    powers = mix(np.arange(1, suffix.shape[1] + before.shape[1] + 3, dtype=U))
    with np.errstate(over="ignore"):
        label = mix((BYTE_VALUES[suffix] * powers[: suffix.shape[1]]).sum(1) + (BYTE_VALUES[before] * powers[suffix.shape[1] : -2]).sum(1) + size.astype(U) * powers[-2] + bsize.astype(U) * powers[-1])
    by = np.lexsort((at, doc, label))
    label = label[by]
    head = np.concatenate([[True], label[1:] != label[:-1]])
    entry, first = np.cumsum(head) - 1, by[head]
    order = _suffix_order(suffix[first], size[first])
    placed = np.empty(len(order), np.int64)
    placed[order] = np.arange(len(order))
    first = first[order]
    suffix, size, before, bsize = suffix[first], size[first].astype(np.uint8), before[first], bsize[first].astype(np.uint8)
    lcp = np.zeros(len(first), np.uint8)
    if len(first) > 1:
        differ = suffix[1:] != suffix[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), suffix.shape[1])
        lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
    column = np.arange(suffix.shape[1])
    rest = suffix[(column >= lcp[:, None]) & (column < size[:, None])]
    tail = before[np.arange(before.shape[1]) >= before.shape[1] - bsize[:, None]]
    place = np.lexsort((at[by], doc[by], placed[entry]))
    return _pack(lcp, size, rest, bsize, tail, placed[entry][place].astype(np.uint32), doc[by][place], at[by][place].astype(np.uint32))


def _unfold(flat: np.ndarray, from_: np.ndarray, to: np.ndarray, width: int) -> np.ndarray:
    column = np.arange(width)
    out = np.zeros((len(from_), width), np.uint8)
    out[(column >= from_[:, None]) & (column < to[:, None])] = flat
    return out


def _read_run(block: bytes, length: int) -> tuple:
    lcp, size, rest, bsize, tail, entry, doc, at = _unpack(block, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.uint32, np.int64, np.uint32)
    column = np.arange(length)
    suffix = _unfold(rest, lcp, size, length)
    source = np.where(column >= lcp[:, None], np.arange(len(lcp))[:, None], -1)
    source = np.maximum.accumulate(source, axis=0)
    suffix = np.where(column < size[:, None], suffix[source, column], np.uint8(0))
    width = length - GRAM
    before = _unfold(tail, width - bsize.astype(np.int64), np.full(len(bsize), width), width)
    return lcp, size, suffix, before, bsize, entry, doc, at


def merge_runs(keys: list[list[int]], shared: list[list[int]], width: int, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges sorted runs with a loser tree that knows common prefixes: (run, place in it, common prefix with the one before).

    keys: strings as integers of `width` bytes. shared: common prefix of each key with the key before it
    in its run. A run's head carries the prefix it shares with the last key that left the tree; heads of
    unlike prefix are ordered by it, and of heads of equal prefix only the bytes behind it are compared.
    `read` collects how many bytes each comparison had before it.
    """
    k = len(keys)
    leaves = 1
    while leaves < k:
        leaves *= 2
    bits, end = 8 * width, 1 << (8 * width + 1)
    rest = [(1 << 8 * (width - n)) - 1 for n in range(width + 1)]  # the bytes behind a prefix of n
    head = [keys[r][0] if r < k and keys[r] else end for r in range(leaves)]
    known = [0 if head[r] != end else -1 for r in range(leaves)]
    place = [0] * leaves
    size = [len(x) for x in keys] + [0] * (leaves - k)

    loser = [0] * leaves
    winners = list(range(leaves))
    level = leaves
    while level > 1:  # the first round: nothing is known yet
        up = []
        for i in range(0, level, 2):
            a, b = winners[i], winners[i + 1]
            if head[b] < head[a]:
                a, b = b, a
            up.append(a)
            loser[level // 2 + i // 2] = b
            known[b] = (bits - (head[a] ^ head[b]).bit_length()) // 8 if head[b] != end else -1
        winners, level = up, level // 2
    win = winners[0]
    runs, places, lcps = [], [], []
    for _ in range(sum(size)):
        runs.append(win)
        at = place[win]
        places.append(at)
        lcps.append(known[win])
        at += 1
        place[win] = at
        if at < size[win]:
            head[win] = keys[win][at]
            known[win] = shared[win][at]
        else:
            head[win] = end
            known[win] = -1
        node = (win + leaves) >> 1
        mine = known[win]
        while node:
            other = loser[node]
            theirs = known[other]
            if theirs > mine:
                loser[node], win, mine = win, other, theirs
            elif theirs == mine and mine >= 0:
                x, y = head[win] & rest[mine], head[other] & rest[mine]
                if read is not None:
                    read.append(width - mine)
                common = (bits - (x ^ y).bit_length()) // 8
                if y < x:
                    known[win] = common
                    loser[node], win = win, other
                else:
                    known[other] = common
            node >>= 1
    if lcps:
        lcps[0] = 0
    return np.array(runs, np.int64), np.array(places, np.int64), np.array(lcps, np.int64)


def _evidence(length: int, parts: int):
    """Front-coded sorted runs of the suffixes at anchors that stand in other documents too."""
    held: list[tuple] = []

    def flush():
        h, suffix, size, before, bsize, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        part = bucket_of(mix(h), parts)
        yield batch([(p, 0, _run(suffix[i], size[i], before[i], bsize[i], doc[i], at[i]), b"", b"") for p, i in cut(part, np.argsort(part, kind="stable"), parts)])

    def step(answers, doc, data, offsets):
        h, row, anchor, low, high = anchored(data, offsets, length)
        key = (h >> U(32)) | bucket_of(h, parts).astype(U) << U(32)
        sizes = np.searchsorted(row, np.arange(len(doc) + 1))
        a, b = answers.bounds(doc)
        hit = np.zeros(len(h), bool)
        for i in np.flatnonzero(a < b).tolist():
            own = slice(sizes[i], sizes[i + 1])
            hit[own] = np.isin(key[own], answers.value[a[i] : b[i]])
        h, row, anchor, low, high = (x[hit] for x in (h, row, anchor, low, high))
        if len(h):
            size, bsize = high + length - anchor, anchor - low
            held.append((h, _rows(data, anchor, size, length), size, _rows(data, low, bsize, length - GRAM, right=True), bsize, doc[row], anchor - offsets[row]))
            if sum(len(x[0]) for x in held) > FLUSH // 4:
                yield from flush()

    inner = beside(step, U)

    def run(batches):
        held.clear()
        yield from inner(batches)
        if held:
            yield from flush()

    return run


def _settle(length: int, parts: int):
    """Merged runs -> for each place, which of the windows at its anchor a smaller document has."""

    def bucket(blocks):
        runs = [_read_run(b, length) for b in blocks]
        keys, shared = [], []
        for lcp, size, suffix, *_ in runs:
            raw = np.concatenate([suffix, size[:, None]], axis=1).tobytes()
            step = length + 1
            keys.append([int.from_bytes(raw[i : i + step], "big") for i in range(0, len(raw), step)])
            shared.append(lcp.tolist())
        which, place, lcp = merge_runs(keys, shared, length + 1)
        del keys, shared
        first = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
        merged = first[which] + place
        placed = np.empty(len(merged), np.int64)
        placed[merged] = np.arange(len(merged))
        size, before, bsize = (np.concatenate([r[k] for r in runs])[merged].astype(np.int64 if k != 3 else np.uint8) for k in (1, 3, 4))
        entry = placed[np.concatenate([first[i] + r[5] for i, r in enumerate(runs)])]
        doc, at = np.concatenate([r[6] for r in runs]), np.concatenate([r[7] for r in runs])
        order_ = rank(doc)
        smallest = np.full(len(merged), np.iinfo(np.int64).max)
        np.minimum.at(smallest, entry, rank(doc))
        mask = np.zeros(len(doc), np.uint32)
        left = np.zeros(len(merged), U)
        for t in range(length - GRAM + 1):  # the window that starts t bytes before the anchor
            if t:
                left = left + BYTE_VALUES[before[:, -t]] * mix(np.array([t], U))
            valid = (bsize >= t) & (size >= length - t)
            if not valid.any():
                continue
            group = np.cumsum(lcp < length - t).astype(U)
            label = mix(left[valid] + mix(group[valid] + U(7)))
            _, inverse = np.unique(label, return_inverse=True)
            low = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, inverse, smallest[valid])
            least = np.full(len(merged), np.iinfo(np.int64).max)
            least[valid] = low[inverse]
            mask |= (least[entry] < order_).astype(np.uint32) << np.uint32(t)
        some = mask > 0
        yield from reply(doc[some], at[some].astype(U) << U(32) | mask[some], parts)

    def run(batches):
        blocks: dict[int, list[bytes]] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                blocks.setdefault(p, []).append(x)
        for p in sorted(blocks):
            yield from bucket(blocks.pop(p))

    return run


def _kept(length: int, whole_characters: bool):
    def step(answers, doc, data, offsets, rest=None):
        n = len(data)
        low, high = answers.bounds(doc)
        count = high - low
        places = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        value = answers.value[places] if len(places) else np.empty(0, U)
        anchor = (value >> U(32)).astype(np.int64) + np.repeat(offsets[:-1], count)
        first, last = np.repeat(offsets[:-1], count), np.repeat(offsets[1:], count) - length
        gone = np.zeros(n, bool)
        if len(anchor):
            starts = []
            for t in range(length - GRAM + 1):
                start = anchor - t  # within its text, unless another text has the same doc_id
                starts.append(start[((value >> U(t)) & U(1) == 1) & (start >= first) & (start <= last)])
            start = np.concatenate(starts)
            change = np.bincount(start, minlength=n + 1)
            change -= np.bincount(start + length, minlength=n + 1)
            gone = np.cumsum(change[:-1]) > 0
        if whole_characters and n:
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.concatenate([lead, [n]])))
        before = np.concatenate([[0], np.cumsum(gone)])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin = np.flatnonzero(gone & (np.concatenate([[True], ~gone[:-1]]) | edge[:-1])) if n else np.empty(0, np.int64)
        end = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]]) | edge[1:])) + 1 if n else begin
        spans = np.searchsorted(begin, offsets)
        shift = np.repeat(offsets[:-1], np.diff(spans))
        removed = before[offsets[1:]] - before[offsets[:-1]]
        kept = data[~gone].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
        pairs = pa.StructArray.from_arrays([pa.array(begin - shift), pa.array(end - shift)], ["begin", "end"])
        yield pa.RecordBatch.from_arrays([ids_back(doc), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pairs), pa.array([kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), *(c.combine_chunks() for c in (rest.columns if rest is not None else []))], ["doc_id", "n_bytes", "n_removed", "spans", "kept", *(rest.schema.names if rest is not None else [])])

    return step


def suffix_dedup(docs: DataFrame, length: int = 50, whole_characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array of (begin, end), kept binary, carried columns); see the module.

    whole_characters keeps a character of which only some bytes are covered, so that kept is UTF-8.
    """
    if not GRAM < length <= GRAM + 31:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 31}")
    spark = docs.sparkSession
    small_batches(spark)
    rest, p = docs.select(*carry).schema, partitions(spark)
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary")
    bodies = docs.select("doc_id", "text", *carry).mapInArrow(roomy(texts(p, bool(carry))), BLOCK)
    docs = docs.select("doc_id", "text")
    candidates = docs.mapInArrow(roomy(marks(_marks(length), p)), BLOCK).repartitionById(p, "part").mapInArrow(roomy(meet(p, True)), BLOCK)
    runs = together(candidates, docs.mapInArrow(roomy(texts(p)), BLOCK), p).mapInArrow(roomy(_evidence(length, p)), BLOCK)
    repeats = runs.repartitionById(p, "part").mapInArrow(roomy(_settle(length, p)), BLOCK)
    return together(repeats, bodies, p).mapInArrow(roomy(beside(_kept(length, whole_characters), U, more=bool(carry))), T.StructType([*schema, *rest]))
