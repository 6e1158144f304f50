"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairs of features
interact through vectors of `RANK` numbers, in time linear in a text's distinct words. Features are the
share of each hashed word (lower-cased, 2**15 slots), statistics of the text's structure (shares of
kinds of bytes, lengths, repetition) and metadata that the text gives (its sizes). Labels, language,
source and doc_id are never features; doc_id only says which rows may be learned from.

Learning: at most `most_rows` labelled rows, those of the smallest hashes of doc_id, so the sample is the
same on every run; their ids (bounded) are broadcast to the scan, and AdaGrad runs on the driver over the
sample's sparse features. Everything else covers all documents.

Nulls and empty texts have the features of an empty text and get a score. A null doc_id is never learned
from and not held out. Null labels are ignored; of several labels for one document the lowest counts.
Of several texts of one id the smallest is learned from. Without labels, or with one class only, the score is the share of label 1 (0.5 without any). Repeated
rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .textkit import slices, word_hashes

BITS, RANK = 15, 8
U = np.uint64
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13), "bang": (33, 63),
    "stop": (46, 44, 59, 58), "bar": (124,), "mark": (35, 36, 37, 38, 42, 43, 61, 64, 94, 126), "bracket": (40, 41, 60, 62, 91, 93, 123, 125), "quote": (34, 39, 96), "slash": (47, 92, 95, 45), "wide": range(128, 256),
}
STATS = len(_KINDS) + 9
SIZE = (1 << BITS) + STATS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a slice: (indices, values, bounds); statistics are present in each row."""
    count = len(offsets) - 1
    h, starts, ends, bounds = word_hashes(data, offsets, lower=True)
    size, words = np.diff(offsets).astype(float), np.diff(bounds).astype(float)
    row = np.repeat(np.arange(count), np.diff(bounds))
    key, times = np.unique(row.astype(U) << U(BITS) | h >> U(64 - BITS), return_counts=True)
    row, slot = (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64)
    distinct = np.bincount(row, minlength=count).astype(float)
    most = np.zeros(count)
    np.maximum.at(most, row, times)
    table = np.full(256, 255, np.uint8)
    for i, members in enumerate(_KINDS.values()):
        table[list(members)] = i
    kinds = table[data]
    shares = []
    for i in range(len(_KINDS)):
        total = np.concatenate([[0], np.cumsum(kinds == i)])
        shares.append((total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1))
    length = (ends - starts).astype(float)
    total, squares, capital = (np.concatenate([[0.0], np.cumsum(x)]) for x in (length, length**2, kinds[starts] == 0 if len(starts) else length))
    each = lambda x: (x[bounds[1:]] - x[bounds[:-1]]) / np.maximum(words, 1)
    mean = each(total)
    entropy = -np.bincount(row, weights=times / words[row] * np.log(times / words[row]), minlength=count)
    lines = np.round(shares[4] * size) + 1
    stats = [*shares, mean / 8, np.sqrt(np.maximum(each(squares) - mean**2, 0)) / 8, each(capital), distinct / np.maximum(words, 1), most / np.maximum(words, 1), entropy / 8, np.log1p(size) / 10, np.log1p(words) / 8, np.log1p(words / lines) / 5]
    dense = np.stack(stats, 1)
    value = times / np.sqrt(np.maximum(np.bincount(row, weights=times.astype(float) ** 2, minlength=count), 1))[row]
    out_row = np.concatenate([row, np.repeat(np.arange(count), STATS)])
    index = np.concatenate([slot, np.tile(np.arange(STATS) + (1 << BITS), count)])
    order = np.argsort(out_row, kind="stable")
    return index[order], np.concatenate([value, dense.reshape(-1)])[order].astype(np.float32), np.searchsorted(out_row[order], np.arange(count + 1))


class Machine:
    """Parameters of a factorisation machine with standardised statistics."""

    def __init__(self, rate: float = 0.5, seed: int = 7):
        self.bias = np.float32(rate)
        self.weight = np.zeros(SIZE, np.float32)
        self.vectors = (np.random.default_rng(seed).normal(0, 0.02, (SIZE, RANK))).astype(np.float32)
        self.shift, self.scale = np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32)

    def scaled(self, index, value):
        return np.clip((value - self.shift[index]) * self.scale[index], -6, 6)

    def terms(self, index, value, bounds):
        """(logits, sum of v x by row): the sum-of-squares identity over each row's features."""
        v = self.vectors[index] * value[:, None]
        sums = np.add.reduceat(v, bounds[:-1], axis=0)
        squares = np.add.reduceat((v * v).sum(1), bounds[:-1])
        linear = np.add.reduceat(self.weight[index] * value, bounds[:-1])
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        index, value, bounds = features(data, offsets)
        logits, _ = self.terms(index, self.scaled(index, value), bounds)
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))

    def learn(self, index, value, bounds, label, epochs: int = 10, batch: int = 256, step: float = 0.08, decay: float = 1e-5, seed: int = 11):
        count = len(label)
        if count == 0:
            self.bias = np.float32(0)
            self.vectors[:] = 0
            return self
        rate = float(label.mean())
        if rate in (0.0, 1.0):
            self.bias = np.float32(30 if rate else -30)
            self.vectors[:] = 0
            return self
        self.bias = np.float32(np.log(rate / (1 - rate)))
        stat = index >= 1 << BITS
        number, seen = index[stat], value[stat].astype(np.float64)
        times = np.maximum(np.bincount(number, minlength=SIZE), 1)
        mean = np.bincount(number, weights=seen, minlength=SIZE) / times
        spread = np.sqrt(np.maximum(np.bincount(number, weights=seen**2, minlength=SIZE) / times - mean**2, 0))
        self.shift[1 << BITS :] = mean[1 << BITS :]
        self.scale[1 << BITS :] = 1 / np.maximum(spread[1 << BITS :], 1e-3)
        value = self.scaled(index, value)
        order, rng = np.arange(count), np.random.default_rng(seed)
        g_bias, g_weight, g_vectors = 1e-8, np.full(SIZE, 1e-8, np.float32), np.full((SIZE, RANK), 1e-8, np.float32)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in range(0, count, batch):
                rows = order[k : k + batch]
                length = bounds[rows + 1] - bounds[rows]
                edge = np.concatenate([[0], np.cumsum(length)])
                at = np.repeat(bounds[rows] - edge[:-1], length) + np.arange(edge[-1])
                i, x, who = index[at], value[at], np.repeat(np.arange(len(rows)), length)
                logits, sums = self.terms(i, x, edge)
                error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - label[rows]) / len(rows)).astype(np.float32)
                unique, place = np.unique(i, return_inverse=True)
                gradient = np.bincount(place, weights=error[who] * x).astype(np.float32) + decay * self.weight[unique]
                by_row = (error[who] * x)[:, None] * (sums[who] - self.vectors[i] * x[:, None])
                deep = np.stack([np.bincount(place, weights=by_row[:, f]) for f in range(RANK)], 1).astype(np.float32) + decay * self.vectors[unique]
                g_weight[unique] += gradient**2
                g_vectors[unique] += deep**2
                self.weight[unique] -= step * gradient / np.sqrt(g_weight[unique])
                self.vectors[unique] -= step * 0.3 * deep / np.sqrt(g_vectors[unique])
                g_bias += float(error.sum()) ** 2
                self.bias = np.float32(self.bias - step * error.sum() / np.sqrt(g_bias))
        return self


def _score(model):
    def run(batches):
        machine = model.value
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(machine.score(data, offsets))], ["doc_id", "score"])

    return run


def _examples(batches):
    for b in batches:
        for i, j, data, offsets in slices(b.column(0)):
            index, value, bounds = features(data, offsets)
            parts = [(index[a:z].astype(np.int32).tobytes(), value[a:z].tobytes()) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1)[i:j], b.column(2)[i:j], pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary())], ["doc_id", "label", "index", "value"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> Machine:
    """Learns from at most `most_rows` labelled documents that are not held out."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # One text for each sampled id, so that what is collected is bounded whatever repeats.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("text", "doc_id", "label").mapInArrow(lean(_examples), "doc_id long, label double, index binary, value binary").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    lists = [np.frombuffer(r["index"], np.int32) for r in rows]
    index = np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int64)
    value = np.concatenate([*(np.frombuffer(r["value"], np.float32) for r in rows), np.empty(0, np.float32)])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return Machine().learn(index, value, bounds, np.array([float(r["label"] > 0) for r in rows], np.float32))


def quality_fm(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, most_rows))  # 1.2 MB at any size
    scored = docs.select("doc_id", "text").mapInArrow(lean(_score(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = 6000) -> DataFrame:
    """The rows of docs, all their columns, whose text scores at least `threshold`; no row is moved between tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, most_rows))
    at = docs.columns.index("text")

    def run(batches):
        machine = model.value
        for b in batches:
            keep = [machine.score(data, offsets) >= threshold for _, _, data, offsets in slices(b.column(at))]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(lean(run), docs.schema)
