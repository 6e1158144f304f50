"""Removal of repeated word passages by fixed-block anchors.

A window is `window` consecutive words of one document. Every word covered by a window whose word
sequence also starts anywhere else goes, in the same document too; windows are judged on the input.

1. Index: the words at every multiple of b = (window + 1) // 2 start a reference block of b words;
   these blocks do not overlap, and every window contains one whole.
2. Probe: the fingerprint of every rolling window of b words is sent to the bucket of its hash. A
   reference block that two probes meet (its own is one) is an anchor; both documents are told.
3. Extend: a document fingerprints each window of `window` words that spans an anchor. Windows that
   meet a second time, anywhere, are parts of exact repeats of `window` words or more, and runs of
   them are the maximal repeats. Fingerprints of this step have 64 bits.

Only marks of 32 bits a word (with the document, about 6 bytes) and whole texts in compressed blocks
are shuffled; a passage that a third of all documents share costs one mark for each of its words there.

Nulls and texts without words: n_words 0, nothing removed, the hash of the empty string. A null doc_id
stays null. Repeated rows repeat each other's windows, so both lose them. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions, roomy, small_batches
from .repeats import BLOCK, U, batch, beside, bucket_of, covered, cut, deltas, expand, ids_back, marks, meet, reply, squeeze, texts, together, undo
from .textkit import Spans, owners, word_hashes


def _rolling(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `width` words within texts: (hashes, text, first word)."""
    all_hashes = Spans(hashes).windows(width)
    own = owners(bounds)
    start = np.flatnonzero(own[: len(all_hashes)] == own[width - 1 :]) if len(all_hashes) else np.empty(0, np.int64)
    return all_hashes[start], own[start], start


def _marks(block: int):
    def of(data, offsets):
        hashes, _, _, bounds = word_hashes(data, offsets)
        h, row, start = _rolling(hashes, bounds, block)
        return h, row, (start - bounds[row]) % block == 0

    return of


def _windows(window: int, block: int, parts: int):
    """Fingerprints of the windows that span an anchor, by bucket: x ids, y fingerprints."""

    def step(answers, doc, data, offsets):
        hashes, _, _, bounds = word_hashes(data, offsets)
        h, row, start = _rolling(hashes, bounds, block)
        key = (h >> U(32)) | bucket_of(h, parts).astype(U) << U(32)
        low, high = answers.bounds(doc)
        hit = np.zeros(len(hashes) + 1, np.int64)
        sizes = np.searchsorted(row, np.arange(len(doc) + 1))
        for i in np.flatnonzero(low < high).tolist():
            own = slice(sizes[i], sizes[i + 1])
            hit[start[own][np.isin(key[own], answers.value[low[i] : high[i]])]] = 1
        total = np.concatenate([[0], np.cumsum(hit)])
        h, row, start = _rolling(hashes, bounds, window)
        keep = total[start + window - block + 1] > total[start]
        h, who = h[keep], doc[row[keep]]
        if len(h):
            part = bucket_of(h, parts)
            order = np.lexsort((who, part))
            yield batch([(p, 0, deltas(who[at]), squeeze(h[at]), b"") for p, at in cut(part, order, parts)])

    return step


def _repeated(parts: int):
    """Fingerprints that stand in two places go back to their documents."""

    def run(batches):
        doc, h = [], []
        for b in batches:
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                doc.append(undo(x))
                h.append(expand(y, U))
        if doc:
            d, v = np.concatenate(doc), np.concatenate(h)
            order = np.argsort(v, kind="stable")
            d, v = d[order], v[order]
            twice = np.zeros(len(v), bool)
            twice[1:] = v[1:] == v[:-1]
            twice[:-1] |= twice[1:]
            yield from reply(d[twice], v[twice], parts)

    return run


def _kept(window: int):
    def step(answers, doc, data, offsets):
        hashes, starts, ends, bounds = word_hashes(data, offsets)
        h, row, start = _rolling(hashes, bounds, window)
        low, high = answers.bounds(doc)
        sizes = np.searchsorted(row, np.arange(len(doc) + 1))
        gone = np.zeros(len(hashes), bool)
        for i in np.flatnonzero(low < high).tolist():
            own = slice(sizes[i], sizes[i + 1])
            hit = start[own][np.isin(h[own], answers.value[low[i] : high[i]])] - bounds[i]
            gone[bounds[i] : bounds[i + 1]] = covered(hit, window, bounds[i + 1] - bounds[i])
        raw = data.tobytes()
        kept, removed = [], []
        for i in range(len(doc)):
            a, b = bounds[i], bounds[i + 1]
            stay = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
            removed.append(int(b - a - len(stay)))
        yield pa.RecordBatch.from_arrays([ids_back(doc), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return step


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words that stay, joined by one space; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    docs, p, block = docs.select("doc_id", "text"), partitions(spark), (window + 1) // 2
    bodies = docs.mapInArrow(roomy(texts(p)), BLOCK)
    anchors = docs.mapInArrow(roomy(marks(_marks(block), p)), BLOCK).repartitionById(p, "part").mapInArrow(roomy(meet(p, False)), BLOCK)
    windows = together(anchors, bodies, p).mapInArrow(roomy(beside(_windows(window, block, p), U)), BLOCK)
    repeats = windows.repartitionById(p, "part").mapInArrow(roomy(_repeated(p)), BLOCK)
    return together(repeats, bodies, p).mapInArrow(roomy(beside(_kept(window), U)), "doc_id long, n_words long, n_removed long, kept string")
