"""Exchange of packed columns between documents and hash buckets, for exact repeat search.

A repeat search goes twice from the documents to buckets of fingerprints and back:

    marks -> `meet` finds fingerprints that can repeat -> back to the documents
    evidence -> an operator's own step settles the repeats -> back to the documents

Everything travels as compressed blocks of many records, one row per (task, bucket), so that the JVM
handles few rows; a bucket number is a partition number. Both the number of buckets and the number of
document blocks are the session's shuffle partitions, which are set with the size of the data. Blocks
of records are bounded by `FLUSH` records or bytes on the sending side, and by the bucket on the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import mix, slices

U = np.uint64
FLUSH = 1 << 20
#: In blocks a null doc_id is NO_ID or above, told apart by its text: such rows sort after every id, and none before another.
NO_ID = 1 << 62
BLOCK = "part int, kind int, x binary, y binary, z binary"


def squeeze(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(block, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def deltas(x: np.ndarray) -> bytes:
    """Ascending integers."""
    return squeeze(np.diff(x, prepend=np.int64(0)))


def undo(block) -> np.ndarray:
    return np.cumsum(expand(block, np.int64))


def ids(column: pa.Array, text: pa.Array) -> np.ndarray:
    """Ids as integers; rows without one get a number from their text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.array(column.fill_null(NO_ID))
    if column.null_count:
        for i in np.flatnonzero(np.asarray(column.is_null())).tolist():
            out[i] = NO_ID + int.from_bytes(hashlib.blake2b((text[i].as_py() or "").encode(), digest_size=7).digest(), "big")
    return out


def ids_back(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int64(), mask=x >= NO_ID)


def rank(doc: np.ndarray) -> np.ndarray:
    """Ids as documents are ordered by them."""
    return np.minimum(doc, NO_ID)


def home(doc: np.ndarray, parts: int) -> np.ndarray:
    """The block in which a document's text and everything about it meet."""
    return (mix(doc.view(U)) % U(parts)).astype(np.int64)


def bucket_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h & U(0xFFFFFFFF)) * U(parts) >> U(32)).astype(np.int64)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "kind", "x", "y", "z"])


def cut(part: np.ndarray, order: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that has records: their places, in the given order."""
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield p, order[bounds[p] : bounds[p + 1]]


def texts(parts: int, more: bool = False) -> Callable:
    """(doc_id, text) -> blocks of whole texts by home: x ids, y lengths, z the bytes. With more, y also has the further columns."""

    def flush(held):
        doc = np.concatenate([h[0] for h in held])
        bodies = [b for h in held for b in h[1]]
        length = np.array([len(b) for b in bodies])
        part = home(doc, parts)
        press = zstandard.ZstdCompressor(level=3)
        rest = pa.Table.from_batches([h[2] for h in held]).combine_chunks() if more else None
        rows = []
        for p, at in cut(part, np.argsort(part, kind="stable"), parts):
            y = squeeze(length[at])
            if more:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_table(rest.take(pa.array(at)))
                y = len(y).to_bytes(8, "little") + y + press.compress(sink.getvalue())
            rows.append((p, 1, squeeze(doc[at]), y, press.compress(b"".join([bodies[i] for i in at.tolist()]))))
        return batch(rows)

    def run(batches):
        held, size = [], 0
        for b in batches:
            doc = ids(b.column(0), b.column(1))
            for i, j, data, offsets in slices(b.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                held.append((doc[i:j], [raw[at[k] : at[k + 1]] for k in range(j - i)], b.slice(i, j - i).select(b.schema.names[2:]) if more else None))
                size += len(raw)
                if size > 8 * FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def marks(of: Callable, parts: int) -> Callable:
    """(doc_id, text) -> blocks of 32-bit marks by bucket: x ids, z marks, y those that index. of(data, offsets) gives (hash, row, indexes)."""

    def flush(held):
        h, doc, index = (np.concatenate(x) for x in zip(*held, strict=True))
        part = bucket_of(h, parts)
        mark = (h >> U(32)).astype(np.uint32)
        by = np.argsort(doc, kind="stable")
        order = by[np.argsort(part[by].astype(np.uint16 if parts < 65536 else np.int64), kind="stable")]
        return batch([(p, 0, deltas(doc[at]), squeeze(mark[at[index[at]]]), mark[at].tobytes()) for p, at in cut(part, order, parts)])

    def run(batches):
        held, size = [], 0
        for b in batches:
            doc = ids(b.column(0), b.column(1))
            for i, _, data, offsets in slices(b.column(1)):
                h, row, index = of(data, offsets)
                if len(h):
                    held.append((h, doc[i + row], index))
                    size += len(h)
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def reply(doc: np.ndarray, value: np.ndarray, parts: int, value2: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks for the documents' homes: x ids, y values, z second values."""
    if len(doc):
        part = home(doc, parts)
        order = np.lexsort((value, doc, part))
        yield batch([(p, 0, deltas(doc[at]), squeeze(value[at]), squeeze(value2[at]) if value2 is not None else b"") for p, at in cut(part, order, parts)])


def meet(parts: int, other_document: bool) -> Callable:
    """Marks that index somewhere and stand in two places (or two documents) go back as (bucket, mark) keys."""

    def run(batches):
        doc, mark, index, bucket = [], [], [], []
        for b in batches:
            for p, _, x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc.append(undo(x))
                index.append(expand(y, np.uint32))
                mark.append(np.frombuffer(z, np.uint32))
                bucket.append(p)
        if not doc:
            return
        for p in sorted(set(bucket)):
            own = [i for i, q in enumerate(bucket) if q == p]
            d, m = np.concatenate([doc[i] for i in own]), np.concatenate([mark[i] for i in own])
            indexed = np.unique(np.concatenate([index[i] for i in own]))
            order = np.argsort(m, kind="stable")
            d, m = d[order], m[order]
            head = np.concatenate([[True], m[1:] != m[:-1]])
            start = np.flatnonzero(head)
            size = np.diff(np.concatenate([start, [len(m)]]))
            if other_document:
                repeats = np.minimum.reduceat(rank(d), start) != np.maximum.reduceat(rank(d), start)
            else:
                repeats = size > 1
            value = m[start]
            at = np.searchsorted(indexed, value)
            at[at == len(indexed)] = 0
            repeats &= indexed[at] == value if len(indexed) else False
            keep = np.repeat(repeats, size)
            yield from reply(d[keep], (m[keep].astype(U) | U(p) << U(32)), parts)

    return run


class Answers:
    """What came back for the documents of one home: values sorted within each document."""

    def __init__(self):
        self._parts: list[tuple] = []

    def add(self, x, y, z, kind, kind2=None):
        self._parts.append((undo(x), expand(y, kind), expand(z, kind2) if kind2 is not None else None))

    def close(self, kind):
        if self._parts:
            self.doc = np.concatenate([p[0] for p in self._parts])
            self.value = np.concatenate([p[1] for p in self._parts])
            second = [p[2] for p in self._parts]
            self.second = np.concatenate(second) if second[0] is not None else None
            order = np.lexsort((self.value, self.doc))
            self.doc, self.value = self.doc[order], self.value[order]
            self.second = self.second[order] if self.second is not None else None
        else:
            self.doc, self.value, self.second = np.empty(0, np.int64), np.empty(0, kind), None
        self._parts = []

    def bounds(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.doc, doc), np.searchsorted(self.doc, doc, side="right")


def beside(step: Callable, kind, kind2=None, more: bool = False) -> Callable:
    """Blocks of answers (kind 0), then of texts (kind 1) -> step(answers, ids, data, offsets) for each slice of texts of about FLUSH bytes.

    With more, step also gets the texts' further columns.
    """

    def run(batches):
        answers, closed, held, size = Answers(), False, [], 0

        def hand():
            doc = np.concatenate([h[0] for h in held])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([h[1] for h in held]))])
            raw = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
            rest = pa.concat_tables([h[3] for h in held]).combine_chunks() if more else None
            held.clear()
            first = 0
            while first < len(doc):
                end = max(first + 1, int(np.searchsorted(ends, ends[first] + FLUSH, side="right")) - 1)
                extra = (rest.slice(first, end - first),) if more else ()
                yield from step(answers, doc[first:end], raw[ends[first] : ends[end]], ends[first : end + 1] - ends[first], *extra)
                first = end

        for b in batches:
            for _, which, x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if which == 0:
                    answers.add(x, y, z, kind, kind2)
                    continue
                if not closed:
                    answers.close(kind)
                    closed = True
                rest = None
                if more:
                    cut_at = 8 + int.from_bytes(y[:8], "little")
                    rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(y[cut_at:])).read_all()
                    y = y[8:cut_at]
                length = expand(y, np.int64)
                held.append((expand(x, np.int64), length, zstandard.ZstdDecompressor().decompress(z) if length.sum() else b"", rest))
                size += len(held[-1][2])
                if size >= FLUSH:
                    yield from hand()
                    size = 0
        if held:
            yield from hand()

    return run


def together(answers: DataFrame, bodies: DataFrame, parts: int) -> DataFrame:
    """Answers and texts in their homes, answers first."""
    return answers.union(bodies).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places the windows of `width` at `starts` cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0
