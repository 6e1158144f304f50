"""Packing of tokenised documents into sequences by length patterns.

1. Documents are tokenised (ids, then id 0); one longer than `capacity` is cut in whole sequences,
   after a first piece that may be shorter. Pieces carry a running number within (task, length).
2. Only the histogram of piece lengths, at most `capacity` counts, comes to the driver. Patterns of a
   few lengths which fill a sequence exactly are enumerated; non-negative least squares fits how often
   each repeats so that the patterns' lengths add up to the histogram; repeats are rounded down and
   limited by what is there. The rest is packed by repeated best-fit patterns: the longest length left,
   then each time the longest that still fits, as often as the counts allow. The work depends on the
   number of lengths, not on the number of documents.
3. Each length's pieces, numbered from 0 over all tasks, are dealt to (pattern, repeat) in the order of
   a table of some thousand rows, which is broadcast: a piece finds its sequence and offset by its number.

A null text is an empty one: a piece of length 1, the id 0. A null doc_id is packed too and stays null;
repeated rows are packed each. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import roomy, saved, small_batches
from .pretokens import Vocabulary, split
from .textkit import slices

_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A worker's cache over a tokenizers file; strings of special tokens are ordinary text."""
    if path not in _vocabularies:
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        tool.encode_special_tokens = True

        def of(body: np.ndarray, length: np.ndarray):
            raw, ends = body.tobytes(), np.concatenate([[0], np.cumsum(length)]).tolist()
            lists = [e.ids for e in tool.encode_batch([raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)], add_special_tokens=False)]
            return [(np.array([i for x in lists for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))]

        _vocabularies[path] = Vocabulary(of)
    return _vocabularies[path]


def _pieces(path: str, capacity: int):
    def run(batches):
        tool, task = vocabulary(path), TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                places, bounds = split(data, offsets)
                ids, at = tool.ids(data, places)
                ends = at[bounds] + np.arange(j - i + 1)  # with a 0 after each document
                full = np.zeros(ends[-1], "<u4")
                full[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(at[bounds]))] = ids
                raw = full.tobytes()
                total = np.diff(ends)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (total - capacity * (pieces - 1))[row]
                start = np.where(piece > 0, head + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.searchsorted(ranked, ranked)
                number = np.empty(len(row), np.int64)
                number[order] = np.arange(len(row)) - first + count[ranked]
                count += np.bincount(length, minlength=capacity + 1)
                at = (ends[:-1][row] + start) * 4
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(number)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
                )

    return run


def patterns(histogram: np.ndarray, capacity: int, spread: int = 6) -> np.ndarray:
    """Patterns of one to four present lengths that fill a sequence exactly: rows of lengths, 0 where unused."""
    have = histogram > 0
    lengths = np.flatnonzero(have)
    found = [np.array([[capacity, 0, 0, 0]])] if have[capacity] else []
    x = lengths[lengths < capacity]
    two = x[(2 * x >= capacity) & have[capacity - x]]
    found.append(np.stack([two, capacity - two, 0 * two, 0 * two], 1))
    for parts in (3, 4):
        for share in np.linspace(0.08, 0.92, spread):
            # The longest is any length; the next takes a share of the room, the rest is split evenly, up to the last.
            rest = capacity - x
            b = lengths[np.clip(np.searchsorted(lengths, (rest * share).astype(np.int64)), 0, len(lengths) - 1)]
            rest = rest - b
            c = 0 * b
            if parts == 4:
                c = lengths[np.clip(np.searchsorted(lengths, rest // 2), 0, len(lengths) - 1)]
                rest = rest - c
            ok = (rest > 0) & (rest < capacity)
            ok[ok] = have[rest[ok]]
            found.append(np.sort(np.stack([x, b, c, np.where(ok, rest, 0)], 1)[ok], axis=1)[:, ::-1])
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 4), np.int64)


def fit(rows: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 with the least squared distance between the patterns' lengths and the histogram (accelerated projected gradient)."""
    used = rows > 0
    at = np.where(used, rows, 0)
    target = histogram.astype(float)
    x = momentum = np.zeros(len(rows))
    degree = np.zeros(len(histogram))
    np.add.at(degree, at[used], 1)
    step = 1 / max(1.0, 4 * float(degree[1:].max(initial=1.0)))  # rows hold at most 4 lengths
    t = 1.0
    for _ in range(rounds):
        made = np.bincount(at[used], weights=np.repeat(momentum, used.sum(1)), minlength=len(histogram))
        gap = made - target
        gap[0] = 0
        new = np.maximum(0, momentum - step * gap[at].sum(1))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t_next * (new - x)
        x, t = new, t_next
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns with repeats that hold every piece of the histogram: (lengths, repeats)."""
    left = histogram.copy()
    out: list[tuple[list[int], int]] = []
    rows = patterns(histogram, capacity)
    repeats = fit(rows, histogram) if len(rows) else np.empty(0)
    for i in np.argsort(-repeats, kind="stable").tolist():
        lengths = [int(n) for n in rows[i] if n]
        times = min([int(repeats[i]), *(int(left[n]) // lengths.count(n) for n in set(lengths))])
        if times > 0:
            out.append((lengths, times))
            for n in lengths:
                left[n] -= times
    present = left > 0
    while present.any():
        room, lengths, taken = capacity, [], {}
        while room > 0:
            fits = np.flatnonzero(present[1 : room + 1])
            n = next((int(k) + 1 for k in fits[::-1] if left[k + 1] > taken.get(int(k) + 1, 0)), 0)
            if not n:
                break
            most = min(room // n, int(left[n]) - taken.get(n, 0))
            lengths += [n] * most
            taken[n] = taken.get(n, 0) + most
            room -= n * most
        times = min(int(left[n]) // k for n, k in taken.items())
        out.append((lengths, times))
        for n, k in taken.items():
            left[n] -= k * times
            present[n] = left[n] > 0
    return out


def places(patterns_: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length and run of its pieces: (length and first number as one key, first sequence, offset), by key."""
    used = np.zeros(capacity + 1, np.int64)
    keys, sequences, offsets = [], [], []
    sequence = 0
    for lengths, times in patterns_:
        offset = 0
        for n in lengths:
            keys.append(n << 48 | int(used[n]))
            sequences.append(sequence)
            offsets.append(offset)
            used[n] += times
            offset += n
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def _deal(table):
    def run(batches):
        keys, sequences, offsets = table.value
        for b in batches:
            length, number = np.asarray(b.column(3)), np.asarray(b.column(5))
            key = length << 48 | number
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = saved(docs.select("doc_id", "text").mapInArrow(roomy(_pieces(path, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"))
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(firsts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("number")).alias("number"))
    return numbered.mapInArrow(roomy(_deal(table)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
