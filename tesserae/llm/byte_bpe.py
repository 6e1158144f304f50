"""Byte-level BPE by recursive queries in DuckDB, one database in each Python worker.

encode: pre-tokens of a partition's texts are found at once; the distinct new ones become rows
(word, position, id), one for each byte. A recursive query joins neighbours with the merge table and
contracts each word's leftmost pair of the lowest rank, until no word has a pair. Words that a worker
has met keep their ids in a bounded cache; a text's ids are those of its words.

decode: every text's ids become rows (piece of a text, position, id); an ordered aggregation joins them
with the vocabulary's bytes. Long texts are decoded in pieces of ids, which are joined.

The merge table holds every pair of tokens whose bytes joined are a token, with that token's rank, so
results are those of rank-based BPE on each match of the pattern. Special tokens are ordinary text.

Words of more than `SHORT` bytes go through a second form of the query, whose rounds contract all pairs of
a word's lowest rank from left to right. That is the same sequence of contractions as long as none of
them makes room for a lower rank; the query reports where one does, and such words are contracted pair
by pair. Words of more than `PIECE` bytes are encoded in overlapping pieces and joined at a token that
both neighbours have: as ranks only rise in both, no contraction crosses its ends in the whole word either.
Where neighbours share no token, or ranks do not rise, the pieces grow, up to the whole word.

Nulls are empty texts: n_tokens 0 and the hash of no bytes. Other columns are ignored. The path of the
rank file is a parameter and must exist on every machine; it is never copied. Nothing is spilled to disk.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import roomy, small_batches
from .pretokens import Vocabulary, split
from .textkit import slices

SHORT, PIECE = 32, 192
ENCODE = """
WITH RECURSIVE rows(word, position, id, round) AS (
    SELECT word, position, id, 0 FROM bytes
    UNION ALL
    (WITH pairs AS (
        SELECT r.word, r.position, r.id, r.round, r.next_position, m.merged
        FROM (
            SELECT word, position, id, round, lead(id) OVER seq AS next_id, lead(position) OVER seq AS next_position
            FROM rows WINDOW seq AS (PARTITION BY word ORDER BY position)
        ) r
        LEFT JOIN merges m ON m.one = r.id AND m.two = r.next_id
    ),
    chosen AS (
        SELECT word, min(merged * 4294967296 + position) AS best, arg_min(next_position, merged * 4294967296 + position) AS gone
        FROM pairs WHERE merged IS NOT NULL GROUP BY word
    )
    SELECT p.word, p.position, CASE WHEN p.position = c.best % 4294967296 THEN (c.best // 4294967296)::INT ELSE p.id END, p.round + 1
    FROM pairs p JOIN chosen c USING (word)
    WHERE p.position <> c.gone)
)
SELECT word, position, id
FROM rows JOIN (SELECT word, max(round) AS round FROM rows GROUP BY word) USING (word, round)
ORDER BY word, position
"""
#: id -1 marks a contracted place; round tells rows of two rounds apart. fair: no round of several contractions was followed by a lower rank. rising: ranks only rose.
ENCODE_LONG = """
WITH RECURSIVE rows(word, position, id, rank, many, fair, rising, round) USING KEY (word, position) AS (
    SELECT word, position, id, -1, false, true, true, 0 FROM bytes
    UNION
    (WITH line AS (
        SELECT *, lead(id) OVER seq AS next_id, row_number() OVER seq AS place
        FROM rows WHERE id >= 0 WINDOW seq AS (PARTITION BY word ORDER BY position)
    ),
    pairs AS (
        SELECT l.*, m.merged, m.alone, min(m.merged) OVER (PARTITION BY word) AS best
        FROM line l LEFT JOIN merges m ON m.one = l.id AND m.two = l.next_id
    ),
    hits AS (
        SELECT word, place, alone, row_number() OVER (PARTITION BY word ORDER BY place) AS nth FROM pairs WHERE merged = best
    ),
    taken AS (
        SELECT word, place, count(*) OVER (PARTITION BY word) > 1 AS many
        FROM (SELECT *, row_number() OVER (PARTITION BY word, place - nth ORDER BY place) AS step FROM hits)
        WHERE {taken}
    )
    SELECT p.word, p.position, CASE WHEN a.word IS NOT NULL THEN p.best WHEN b.word IS NOT NULL THEN -1 ELSE p.id END, p.best,
           bool_or(coalesce(a.many, false)) OVER (PARTITION BY p.word), p.fair AND (p.best > p.rank OR NOT p.many), p.rising AND p.best > p.rank, p.round + 1
    FROM pairs p LEFT JOIN taken a ON a.word = p.word AND a.place = p.place LEFT JOIN taken b ON b.word = p.word AND b.place = p.place - 1
    WHERE p.best IS NOT NULL)
)
SELECT word, position, id, fair, rising FROM rows WHERE id >= 0 ORDER BY word, position
"""
#: Of neighbouring pairs of one rank every other one; the first alone where the token and its neighbour could join at a lower rank.
ALL_OF_A_RANK = "step % 2 = 1 AND (nth = 1 OR NOT alone)"
LEFTMOST = "nth = 1"
DECODE = "SELECT word, string_agg(token, '' ORDER BY position) AS body FROM ids JOIN vocabulary USING (id) GROUP BY word ORDER BY word"
_coders: dict[str, Coder] = {}


class Coder:
    """A worker's database with the merge table of one rank file."""

    def __init__(self, path: str, memory_mb: int = 220):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r, ranks.get(t + t[:i], r) < r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        alone = {r for _, _, r, lower in pairs if lower}
        self._memory = memory_mb
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": ""})
        one, two, merged = (np.array(x, np.int32) for x in list(zip(*pairs, strict=True))[:3])
        merges = pa.table({"one": one, "two": two, "merged": merged.astype(np.int64), "alone": np.isin(merged, list(alone))})  # noqa: F841  read by name
        # Bytes as the code points of equal number, so that tokens are joined as texts.
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array([t.decode("latin-1") for t in ranks])})  # noqa: F841
        self._db.execute("CREATE TABLE merges AS FROM merges")
        self._db.execute("CREATE TABLE vocabulary AS FROM vocabulary")
        self.vocabulary = Vocabulary(lambda body, length: (self.encode(body, length),))

    def encode(self, body: np.ndarray, length: np.ndarray, most_work: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as joined bytes and lengths (flat ids, bounds), in queries of about `most_work` rows over all rounds."""
        ends = np.concatenate([[0], np.cumsum(length)])
        words, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        small = np.flatnonzero(length <= SHORT)
        work = np.cumsum(length[small] ** 2)
        for which in np.split(small, np.flatnonzero(np.diff(work // most_work)) + 1):
            if len(which):
                found = self._ask(ENCODE, [body[ends[i] : ends[i + 1]] for i in which.tolist()])
                words.append(which[found.column("word").to_numpy()])
                ids.append(found.column("id").to_numpy())
        for i, own in self._long([(i, body[ends[i] : ends[i + 1]]) for i in np.flatnonzero(length > SHORT).tolist()]):
            words.append(np.full(len(own), i))
            ids.append(own)
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(ids)[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(length)))])

    def _ask(self, sql: str, words: list[np.ndarray]) -> pa.Table:
        length = np.array([len(w) for w in words])
        rows = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), length), "position": _within(length), "id": self._byte[np.concatenate(words)]})
        self._db.register("bytes", rows)
        room = self._memory * max(1, -(-len(rows) // (1 << 18)))  # one word beyond all others may need more
        self._db.execute(f"SET memory_limit = '{room}MB'")
        return self._db.sql(sql).to_arrow_table()

    def _tokens(self, words: list[np.ndarray], taken: str = ALL_OF_A_RANK, most_rows: int = 1 << 17) -> list[tuple]:
        """(start of each token, ids, fair, rising) of every word."""
        out, first = [], 0
        while first < len(words):
            end, rows = first + 1, len(words[first])
            while end < len(words) and rows + len(words[end]) <= most_rows:
                rows += len(words[end])
                end += 1
            found = self._ask(ENCODE_LONG.format(taken=taken), words[first:end])
            word, start, ids, fair, rising = (found.column(k).to_numpy() for k in range(5))
            at = np.searchsorted(word, np.arange(end - first + 1))
            out += [(start[a:b].astype(np.int64), ids[a:b], bool(fair[a:b].all()), bool(rising[a:b].all())) for a, b in zip(at[:-1], at[1:], strict=True)]
            first = end
        return out

    def _long(self, words: list[tuple[int, np.ndarray]]):
        size = PIECE
        while words:
            whole = [(i, w) for i, w in words if len(w) <= size]
            for (i, w), (_, ids, fair, _) in zip(whole, self._tokens([w for _, w in whole]), strict=True):
                yield i, ids if fair else self._tokens([w], LEFTMOST)[0][1]
            words, grow = [(i, w) for i, w in words if len(w) > size], []
            step = size - size // 3
            for i, w in words:
                firsts = list(range(0, len(w) - size + step, step))
                ids = joined(self._tokens([w[a : a + size] for a in firsts]), firsts, [min(a + size, len(w)) for a in firsts])
                if ids is None:
                    grow.append((i, w))
                else:
                    yield i, ids
            words, size = grow, 4 * size

    def decode(self, flat: np.ndarray, bounds: np.ndarray, at_once: int = 1 << 18) -> list[bytes]:
        """Bytes of sequences of ids, in queries of about `at_once` ids; sequences may be empty."""
        total = int(bounds[-1])
        edges = np.unique(np.concatenate([bounds, np.arange(0, total, at_once)]))  # a piece is a run of ids of one sequence
        starts, length = edges[:-1], np.diff(edges)
        pieces: list[bytes] = []
        for which in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // at_once)) + 1):
            if len(which):
                own = length[which]
                a, z = int(starts[which[0]]), int(edges[which[-1] + 1])
                self._db.register("ids", pa.table({"word": np.repeat(np.arange(len(which), dtype=np.int32), own), "position": _within(own), "id": flat[a:z].astype(np.int32)}))
                pieces += [x.encode("latin-1") for x in self._db.sql(DECODE).to_arrow_table().column("body").to_pylist()]
        at = np.searchsorted(starts, bounds).tolist()
        return [b"".join(pieces[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]


def joined(pieces: list[tuple], firsts: list[int], ends: list[int]) -> np.ndarray | None:
    """Ids of a word from its overlapping pieces, or none where two neighbours have no token in common."""
    if not all(rising for *_, rising in pieces):
        return None
    out, held, since = [], None, 0
    for (start, ids, _, _), first, end in zip(pieces, firsts, ends, strict=True):
        start, past = start + first, np.concatenate([start[1:] + first, [end]])
        if held is not None:
            before, gone, old = held
            _, mine, theirs = np.intersect1d(start << 32 | (past - start), before << 32 | (gone - before), return_indices=True)
            theirs, mine = theirs[theirs >= since], mine[theirs >= since]
            if not len(mine):
                return None
            out.append(old[since : theirs[0] + 1])
            since = int(mine[0]) + 1
        held = (start, past, ids)
    return np.concatenate([*out, held[2][since:]])


def _within(length: np.ndarray) -> np.ndarray:
    return (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _encode(path: str, ids_out: bool):
    def run(batches):
        tool = coder(path)
        for b in batches:
            doc = b.column(0)
            for i, j, data, offsets in slices(b.column(1)):
                places, bounds = split(data, offsets)
                ids, at = tool.vocabulary.ids(data, places)
                doc_at = at[bounds]
                raw, again = ids.astype("<u4").tobytes(), tool.decode(ids, doc_at)
                n = np.diff(doc_at)
                hashes = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(doc_at[:-1].tolist(), doc_at[1:].tolist(), strict=True)]
                columns, names = [doc[i:j], pa.array(n), pa.array(hashes), pa.array([hashlib.sha256(x).hexdigest() for x in again])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids_out:
                    columns += [pa.ListArray.from_arrays(pa.array(doc_at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(again, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def byte_bpe(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ids also (ids array, decoded binary); see the module."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * ids
    return docs.select("doc_id", "text").mapInArrow(roomy(_encode(path, ids)), schema)
