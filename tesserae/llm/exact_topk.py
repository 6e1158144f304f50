"""Exact top-k inner products with multi-resolution segment statistics.

Vectors become integers, floor(scale * x). Every query meets every other row, in blocks: candidates are
dealt to as many groups as there are shuffle partitions, and blocks of queries go to each group. Within
a group, a vector is summarised by the mean and deviation of its segments, in levels from coarse to fine.
For segments of m components, |q - c|^2 >= sum m (mean difference^2 + deviation difference^2); with the
lengths known this lower bound of the distance is an upper bound of the inner product. The candidates
with the best coarse bounds are scored first and give a query's k-th score; level by level, those whose
bound falls below it go, and only survivors are scored exactly. Groups send k rows a query, and a
query's home merges them. Bounds carry a margin for rounding, so results are exact, ties to smaller ids.

Rows are dealt to a grid: query blocks by candidate blocks, near sqrt(p / every) by sqrt(p * every) for p
shuffle partitions, so that both sides are copied about equally often and the shuffle grows with sqrt(p).
Places come from a hash of id and vector; equal rows of a batch travel once, with their number.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part.
Shorter vectors count as padded with zeros. Repeated ids are rows of their own: each is a query of its own
with k results, and a candidate for the other ones; a query leaves out its own row alone. Fewer than k
candidates give fewer rows; an empty table none. Other columns are ignored. Scores must fit in 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, roomy, small_batches
from .repeats import BLOCK, U, batch, cut, expand, home, squeeze
from .textkit import mix

LEVELS = (2, 8, 16)
QUERY_ROWS = 512


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept rows, matrix) of a column of float lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = [(i, np.array(x, np.float64)) for i, x in enumerate(column.to_pylist()) if x is not None and None not in x]
    rows = [(i, x) for i, x in rows if np.isfinite(x).all()]
    width = max([len(x) for _, x in rows], default=0)
    matrix = np.zeros((len(rows), width), np.int64)
    for k, (_, x) in enumerate(rows):
        matrix[k, : len(x)] = np.floor(scale * x)
    return np.array([i for i, _ in rows], np.int64), matrix


def digests(vec: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's id and vector, without its zeros at the end."""
    place = mix(np.arange(1, matrix.shape[1] + 1, dtype=U))
    return mix(vec.view(U) ^ (mix(matrix.view(U) + place) * (matrix != 0)).sum(1, dtype=U))


def grid(parts: int, every: int) -> tuple[int, int]:
    """(query blocks, candidate blocks) for about `parts` tasks."""
    rows = max(1, round((parts / every) ** 0.5))
    return rows, max(1, parts // rows)


def _block(vec: np.ndarray, matrix: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes, bytes]:
    width = matrix.shape[1]
    return squeeze(vec), squeeze(matrix.reshape(-1)) if width else b"", np.concatenate([[width], times]).astype(np.int64).tobytes()


def _rows(rows: list[tuple]):
    for k in range(0, len(rows), 256):
        yield batch(rows[k : k + 256])


def _candidates(scale: int, rows: int, columns: int):
    """Rows as blocks for the cells of their column; equal rows of a batch once, with their number."""

    def run(batches):
        for b in batches:
            kept, matrix = integers(b.column(1), scale)
            if not len(kept):
                continue
            both = np.column_stack([np.asarray(b.column(0))[kept], matrix])
            _, first, times = np.unique(both.view(f"V{both.itemsize * both.shape[1]}").ravel(), return_index=True, return_counts=True)
            vec, matrix = both[first, 0], both[first, 1:]
            column = (digests(vec, matrix) % U(columns)).astype(np.int64)
            for c, at in cut(column, np.argsort(column, kind="stable"), columns):
                held = _block(vec[at], matrix[at], times[at])
                yield from _rows([(r * columns + c, 0, *held) for r in range(rows)])

    return run


def _asked(scale: int):
    """Rows as integers, without zeros at the end."""

    def run(batches):
        for b in batches:
            kept, matrix = integers(b.column(1), scale)
            last = ((matrix != 0) * np.arange(1, matrix.shape[1] + 1)).max(1, initial=0)
            inside = np.arange(matrix.shape[1]) < last[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(last)]).astype(np.int32)), pa.array(matrix[inside]))], ["vec_id", "vector"])

    return run


def _queries(rows: int, columns: int):
    """Distinct queries with their numbers as blocks for the cells of their row."""

    def run(batches):
        for b in batches:
            kept, matrix = integers(b.column(1), 1)
            vec, times = np.asarray(b.column(0)), np.asarray(b.column(2))
            row = (mix(digests(vec, matrix)) % U(rows)).astype(np.int64)
            for r, at in cut(row, np.argsort(row, kind="stable"), rows):
                for k in range(0, len(at), QUERY_ROWS):
                    some = at[k : k + QUERY_ROWS]
                    held = _block(vec[some], matrix[some], times[some])
                    yield from _rows([(r * columns + c, 1, *held) for c in range(columns)])

    return run


def _read(x, y, z) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vec, more = expand(x, np.int64), np.frombuffer(z, np.int64)
    width = int(more[0])
    return vec, (expand(y, np.int64) if width else np.empty(0, np.int64)).reshape(len(vec), width), more[1:]


def _pad(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def summary(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, each times the root of the segment's size: inner products of these bound those of the vectors."""
    if not matrix.shape[1]:
        return np.zeros((len(matrix), 1))
    edges = np.unique(np.linspace(0, matrix.shape[1], segments + 1).astype(int))
    parts = [matrix[:, a:b].astype(float) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.concatenate([np.stack([np.sqrt(x.shape[1]) * x.mean(1) for x in parts], 1), np.stack([np.sqrt(x.shape[1]) * x.std(1) for x in parts], 1)], 1)


class Candidates:
    """Rows to search, with their summaries by level; `survivors` counts the rows that each level leaves."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.exact = ids, matrix.astype(float)
        self.norms = np.sqrt((self.exact**2).sum(1))
        self.levels = [summary(matrix, s) for s in LEVELS]
        self.survivors = [0] * len(LEVELS)

    def top(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows for each query: (query row, row, score)."""
        if not len(self.ids) or not len(queries):
            return (np.empty(0, np.int64),) * 3
        out: list[tuple] = []
        own = [summary(queries, s) for s in LEVELS]
        coarse = own[0] @ self.levels[0].T
        length = np.sqrt((queries.astype(float) ** 2).sum(1))
        for r in range(len(queries)):
            q = queries[r].astype(float)
            margin = 1e-9 * (1 + length[r] * self.norms) + 1e-6
            bound = coarse[r] + margin
            lead = np.argpartition(-bound, 2 * k - 1)[: 2 * k] if 2 * k < len(bound) else np.arange(len(bound))
            scores = self.exact[lead] @ q
            floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            alive = np.flatnonzero(bound >= floor)
            self.survivors[0] += len(alive)
            for i in range(1, len(LEVELS)):
                alive = alive[self.levels[i][alive] @ own[i][r] + margin[alive] >= floor]
                self.survivors[i] += len(alive)
            scores = np.rint(self.exact[alive] @ q).astype(np.int64)
            best = np.lexsort((self.ids[alive], -scores))[:k]
            out.append((np.full(len(best), r), alive[best], scores[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(k: int, parts: int):
    """A cell of the grid: the k + 1 best of its candidates, the query's own row perhaps among them, for the query's home."""

    def run(batches):
        held, ready = [], None
        for b in batches:
            for _, kind, x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    held.append(_read(x, y, z))
                    continue
                if not held:
                    continue
                query, rows, times = _read(x, y, z)
                if ready is None or rows.shape[1] > ready.exact.shape[1]:
                    width = max(rows.shape[1], *(m.shape[1] for _, m, _ in held))
                    copies = np.minimum(np.concatenate([t for _, _, t in held]), k + 1)  # more cannot be among the best
                    ready = Candidates(np.repeat(np.concatenate([i for i, _, _ in held]), copies), np.repeat(np.concatenate([_pad(m, width) for _, m, _ in held]), copies, axis=0))
                row, at, score = ready.top(_pad(rows, ready.exact.shape[1]), k + 1)
                asked, part = query[row], home(query[row], parts)
                key, itself = digests(query, rows).view(np.int64)[row], (rows**2).sum(1)[row]
                values = np.stack([key, itself, times[row], ready.ids[at], score])
                yield batch([(p, 0, squeeze(asked[i]), squeeze(values[:, i].reshape(-1)), b"") for p, i in cut(part, np.argsort(part, kind="stable"), parts)])

    return run


def _merge(k: int, most: int = 1 << 16):
    """A query's home: the cells' bests in order, without one row equal to the query, once for each of the query's rows."""

    def run(batches):
        asked, held = [], []
        for b in batches:
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                asked.append(expand(x, np.int64))
                held.append(expand(y, np.int64).reshape(5, -1))
        if not asked:
            return
        query, (key, itself, times, vec, score) = np.concatenate(asked), np.concatenate(held, axis=1)
        order = np.lexsort((vec, -score, key, query))
        query, key, itself, times, vec, score = (x[order] for x in (query, key, itself, times, vec, score))

        head = np.concatenate([[True], (query[1:] != query[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(head) - 1
        own = np.flatnonzero((vec == query) & (score == itself))
        _, first = np.unique(group[own], return_index=True)
        alive = np.delete(np.arange(len(query)), own[first])
        place = np.arange(len(alive)) - np.searchsorted(group[alive], group[alive])
        alive, place = alive[place < k], place[place < k]
        if not len(alive):
            return
        total = np.cumsum(times[alive])
        for start in range(0, int(total[-1]), most):
            at = np.searchsorted(total, np.arange(start, min(start + most, int(total[-1]))), side="right")
            row = alive[at]
            yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array((place[at] + 1).astype(np.int32)), pa.array(vec[row]), pa.array(score[row])], ["query_id", "rank", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products for rows whose vec_id `every` divides; see the module."""
    spark = vectors.sparkSession
    small_batches(spark)
    p = partitions(spark)
    rows, columns = grid(p, every)
    vectors = vectors.select("vec_id", "embedding").where("vec_id is not null")
    asked = vectors.where(F.col("vec_id") % every == 0).mapInArrow(roomy(_asked(scale)), "vec_id long, vector array<long>").groupBy("vec_id", "vector").agg(F.count("*").alias("times"))
    blocks = vectors.mapInArrow(roomy(_candidates(scale, rows, columns)), BLOCK).union(asked.mapInArrow(roomy(_queries(rows, columns)), BLOCK))
    found = blocks.repartitionById(rows * columns, F.col("part")).sortWithinPartitions("kind").mapInArrow(roomy(_search(k, p)), BLOCK)
    return found.repartitionById(p, F.col("part")).mapInArrow(roomy(_merge(k)), "query_id long, rank int, vec_id long, score long")
