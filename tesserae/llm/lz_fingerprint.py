"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed into the phrases of the LZ78 dictionary: each phrase is the longest known one and the
next byte. Texts that compress each other share phrases, so the likeness of two phrase sets tells how
much of one text the other's dictionary holds. The set is hashed once (64 bits a phrase) and kept as
minima of `SLOTS` slots by one permutation, 16 bits each; likeness is the share of slots, among those
that either text fills, with equal minima. Equal texts have equal fingerprints; two empty texts are
alike (1), an empty and another are not (0).

Beside each document stands its edited text: the last half of its code points replaced by as many from
the start of the next document in descending doc_id (the first comes after the last). Documents are
dealt to ranges of doc_id; the first of each range also goes, as a guest, to the range before it, so
every document meets the next one without a global order in one task. Only range bounds and range
maxima, one number for each partition, come to the driver.

Nulls are empty texts. Null ids come after all others; rows of one id follow each other by text. Other
columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import place
from .common import lean, partitions, small_batches
from .textkit import BYTE_VALUES, Spans, mix

SLOTS = 128
U = np.uint64


def phrase_ends(text: bytes, known: dict[int, int], node: int = 0, at: int = 0) -> tuple[list[int], int]:
    """Where new phrases end, from a dictionary and a place in it that are carried on; known grows."""
    ends = []
    add, get = ends.append, known.get
    for at, byte in enumerate(text, at + 1):  # noqa: B020  counts from the place where text starts
        key = node << 8 | byte
        node = get(key, 0)
        if not node:
            known[key] = len(known) + 1
            add(at)
    return ends, node


def signatures(bodies: list[bytes], ends: list[list[int]]) -> np.ndarray:
    """Rows of SLOTS 16-bit minima for the phrases that end at `ends`; 0 marks an empty slot.

    A phrase starts where the one before it ends, so both bounds are known from the ends.
    """
    rows = np.full((len(bodies), SLOTS), np.iinfo(np.uint64).max)
    sizes = np.array([len(e) for e in ends], np.int64)
    if sizes.sum():
        shift = np.cumsum([0, *(len(b) for b in bodies)])[:-1]
        stop = np.concatenate([np.array(e, np.int64) for e in ends]) + np.repeat(shift, sizes)
        start = np.concatenate([[0], stop[:-1]])
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        start[first] = shift[sizes > 0]
        h = Spans(BYTE_VALUES[np.frombuffer(b"".join(bodies), np.uint8)]).hash(start, stop)
        slot = np.repeat(np.arange(len(bodies)) * SLOTS, sizes) + (h % U(SLOTS)).astype(np.int64)
        np.minimum.at(rows.reshape(-1), slot, h)
    short = np.maximum(mix(rows) >> U(48), U(1))
    return np.where(rows == np.iinfo(np.uint64).max, U(0), short).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = ((a > 0) | (b > 0)).sum(1)
    return np.where(either > 0, ((a == b) & (a > 0)).sum(1) / np.maximum(either, 1), 1.0)


def fingerprints(texts: list[str], following: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Signatures of texts and of their edited texts, and these."""
    bodies, ends, new_bodies, new_ends, edited = [], [], [], [], []
    for text, after in zip(texts, following, strict=True):
        half = len(text) // 2
        head, tail, swap = text[: len(text) - half].encode(), text[len(text) - half :].encode(), after[:half].encode()
        known: dict[int, int] = {}
        start, node = phrase_ends(head, known)
        rest, _ = phrase_ends(tail, dict(known), node, len(head))
        new, _ = phrase_ends(swap, known, node, len(head))
        bodies.append(head + tail)
        ends.append(start + rest)
        new_bodies.append(head + swap)
        new_ends.append(start + new)
        edited.append(new_bodies[-1])
    return signatures(bodies, ends), signatures(new_bodies, new_ends), [hashlib.sha256(x).hexdigest() for x in edited]


def _chain(batches):
    """Rows in order (the guest last) -> a result for each row that has one after it."""
    held: list[tuple] = []  # (doc_id, text), of which the first has a signature already

    def emit(last_has_next: bool):
        rows = held if last_has_next else held[:-1]
        count = len(rows) - 1 if last_has_next else len(rows)
        texts = [t for _, t in held]
        first, second, digest = fingerprints(texts[:count], texts[1 : count + 1])
        tail, _, _ = fingerprints([texts[count]], [""])
        chain = np.concatenate([first, tail])
        text_of = lambda rows: pa.array([r.astype(">u2").tobytes().hex() for r in rows], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in held[:count]], pa.int64()), pa.array([len(t) for t in texts[:count]], pa.int64()), pa.array(digest, pa.string()), text_of(first), text_of(second), pa.array(likeness(first, second)), pa.array(likeness(first, chain[1:]))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    size = 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.append((doc, text))
            size += len(text)
            if size > 1 << 20 and len(held) > 1:
                yield emit(True)
                del held[:-1]
                size = len(text)
    if len(held) > 1:
        yield emit(True)


def lz_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    p = partitions(spark)
    rank = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rank.alias("rank"))
    cuts = {int(x) for x in docs.approxQuantile("rank", [i / p for i in range(1, p)], 0.2 / p)} if p > 1 else set()
    ranged = docs.withColumn("part", F.lit(len(cuts)) - place(F.col("rank"), cuts))  # range 0 holds the highest ids
    tops = [tuple(r) for r in ranged.groupBy("part").agg(F.max("rank")).orderBy("part").collect()]
    if not tops:
        return ranged.select("doc_id", "text").mapInArrow(lean(_chain), _SCHEMA)
    # The first row of a range, the highest id and of several the smallest text, is a guest of the range before it, that of the first range of the last.
    host = [tops[0][0]] * (len(cuts) + 1)
    for (before, _), (part, _) in zip([tops[-1], *tops], tops):  # noqa: B905  one more on the left
        host[part] = before
    own = ranged.withColumn("guest", F.lit(0))
    lead = own.where(F.col("rank").isin([top for _, top in tops])).groupBy("rank").agg(F.min(F.struct("text", "doc_id")).alias("row"), F.min("part").alias("part"))
    to = F.get(F.from_json(F.lit(json.dumps(host)), "array<int>"), F.col("part"))
    visiting = lead.select("row.doc_id", "row.text", "rank", to.alias("part"), F.lit(1).alias("guest"))
    dealt = own.union(visiting).repartitionById(p, F.col("part")).sortWithinPartitions("guest", F.desc("rank"), "text")
    return dealt.select("doc_id", "text").mapInArrow(lean(_chain), _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
