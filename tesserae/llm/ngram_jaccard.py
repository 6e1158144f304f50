"""Exact n-gram Jaccard join by T-occurrence search.

Every document is the set of its distinct word n-grams. Two documents are linked when the Jaccard
similarity of their sets reaches a threshold; the result has one row per document with the smallest
document that links lead to.

1. Documents of equal sets are one class (64-bit digest of the set), so copies cost nothing later.
2. A sketch of fixed size (2**18 counters) counts all n-grams of all documents. It only orders the
   n-grams, rare ones first; any order gives the same result.
3. Two sets that reach the threshold share l n-grams among the first n - ceil(t * n) + l of each in
   that order, for any l. With l a tenth of the set these prefixes, packed in binary blocks per hash
   bucket, are the postings; classes that meet others of compatible sizes in at least l posting lists
   are the members, the only ones whose sets are kept.
4. The members' n-grams are counted exactly. A member whose n-grams are shared for less than the
   threshold is linked with nothing. The others' prefixes, now in the order of exact counts, give
   posting lists again, in which passages that many unlike documents share no longer appear; classes
   that these lists connect are candidate clusters.
5. Within a cluster, each set is a query against inverted lists of the smaller sets. First the last
   linked sets of a few components are probed in all its lists: a family of near copies links there. Then
   DivideSkip for the candidates that no link joins to the query yet: the L longest lists are set
   aside, L = T / (mu log2(longest) + 1); the short ones are merged, with a heap up to `HEAP_MOST`
   entries, and what occurs T - L times there is probed by binary search in the long lists.
6. Clusters of more n-grams than a task's share (all members' over the number of tasks, at most
   `block_grams`) are cut in hash blocks, in three passes: within blocks; among the sets that no link in
   their block joined to a smaller one; then every set outside the cluster's largest component against
   the whole cluster, block by block. Only where these are more than a task's share themselves is each
   pair of blocks a task. No pass compares sets that are joined, so no link between components is lost,
   and a family of near copies is sent three times however large it is.

Nulls, empty texts and texts without a word have the empty set: n_shingles 0, linked with nothing. A
text without doc_id links others as any does, but names no component: a component without any doc_id is
null. Repeated rows give repeated result rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, lean, local_roots, partitions, saved, small_batches
from .repeats import BLOCK, FLUSH, batch, beside, bucket_of, cut, deltas, expand, home, ids, reply, squeeze, texts, together, undo
from .textkit import Spans, mix, slices, word_hashes

SKETCH_BITS = 18
HEAP_MOST = 2048
LEAST_BLOCK = 4096
U = np.uint64
TASK = ["cluster", "one", "two", "block", "class", "root", "wide", "grams"]


def gram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a slice: (hashes, bounds)."""
    hashes, _, _, bounds = word_hashes(data, offsets, lower=True)
    spans, sizes = Spans(hashes), np.diff(bounds)
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(out[-1])
    grams = spans.hash(start, start + np.repeat(np.minimum(sizes, width), counts))
    for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True):
        grams[a:b].sort()
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    first[out[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(first)])[out]
    return grams[first], kept


def digests(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit digest for each set; 0 for the empty set."""
    total = np.concatenate([[U(0)], np.cumsum(mix(grams + U(0x5851F42D4C957F2D)), dtype=np.uint64)])
    sizes = np.diff(bounds)
    return np.where(sizes > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(U)) | U(1), U(0)).view(np.int64)


def _texts(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in slices(column):
        yield a, b, *gram_sets(data, offsets, width)


def _sketch(width: int):
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, grams, _ in _texts(batch.column(0), width):
                counts += np.bincount((grams >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        parts = counts.astype(np.uint32).reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"])

    return run


def _add(rows):
    total = sum(np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in rows.column("counts"))
    return pa.table({"part": rows.column("part")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """A level from 0 to 63 for each counter of the sketch: half powers of two of its count against the median."""
    parts = docs.select("text").mapInArrow(lean(_sketch(width)), "part int, counts binary")
    rows = sorted(parts.groupBy("part").applyInArrow(_add, "part int, counts binary").collect())
    counts = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows]) if rows else np.ones(1 << SKETCH_BITS)
    middle = max(1.0, float(np.median(counts)))
    return np.clip(np.floor(2 * np.log2(np.maximum(1, counts / middle))), 0, 63).astype(np.uint8)


def _summary(width: int):
    def run(batches):
        for batch in batches:
            at = ids(batch.column(0), batch.column(1))
            for a, b, grams, bounds in _texts(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(at[a:b]), pa.array(np.diff(bounds)), pa.array(digests(grams, bounds))], ["doc_id", "at", "n", "class"])

    return run


def common(sizes: np.ndarray) -> np.ndarray:
    """How many n-grams of the first postings a set must share to be a member."""
    return np.maximum(1, -(-sizes // 10))


def pack_postings(held: list[tuple], buckets: int) -> pa.RecordBatch:
    """(n-gram, class, size of the set) as binary blocks by bucket."""
    key, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
    bucket = (mix(key) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    key, cls, n = key[order], cls[order], n[order]
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = [i for i in range(buckets) if bounds[i] < bounds[i + 1]]
    blocks = [pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary()) for x in (key, cls, n)]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *blocks], ["bucket", "keys", "classes", "sizes"])


def _postings(width: int, num: int, den: int, levels, buckets: int):
    def run(batches):
        level, held, size, seen = levels.value, [], 0, set()
        for batch in batches:
            for _, _, grams, bounds in _texts(batch.column(0), width):
                classes, sizes = digests(grams, bounds), np.diff(bounds)
                new = np.zeros(len(sizes), bool)  # copies have one posting in each of their lists
                new[np.unique(classes, return_index=True)[1]] = True
                new &= np.fromiter((c not in seen for c in classes.tolist()), bool, len(sizes))
                seen.update(classes[new].tolist())
                key = (level[(grams >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(U) << U(58)) | (mix(grams) >> U(6))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    key[a:b].sort()
                prefix = np.where(new & (sizes > 0), sizes - (-(-sizes * num // den)) + common(sizes), 0)
                place = np.arange(len(key)) - np.repeat(bounds[:-1], sizes)
                keep = place < np.repeat(prefix, sizes)
                held.append((key[keep], np.repeat(classes, sizes)[keep], np.repeat(sizes, sizes)[keep].astype(np.uint32)))
                size += len(held[-1][0])
                if size > 1 << 20:
                    yield pack_postings(held, buckets)
                    held, size, seen = [], 0, set()
        if size:
            yield pack_postings(held, buckets)

    return run


def _lists(num: int, den: int, parts: int = 0):
    """Runs of compatible sizes in the posting lists: for the classes' homes (if parts) how many runs each is in, or links to the smallest of their local component."""

    def run(batches):
        held = [(np.frombuffer(k.as_buffer(), U), np.frombuffer(c.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.uint32)) for b in batches for k, c, n in zip(b.column(1), b.column(2), b.column(3), strict=True)]
        if not held:
            return
        key, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        key, cls, n = key[order], cls[order], n[order]
        twice = np.zeros(len(key), bool)
        twice[1:] = key[1:] == key[:-1]
        twice[:-1] |= twice[1:]
        key, cls, n = key[twice], cls[twice], n[twice].astype(np.int64)
        order = np.lexsort((cls, n, key))
        key, cls, n = key[order], cls[order], n[order]
        joined = (key[1:] == key[:-1]) & (n[:-1] * den >= n[1:] * num)
        start = np.flatnonzero(np.concatenate([[True], ~joined]))
        head = np.repeat(cls[start], np.diff(np.concatenate([start, [len(cls)]])))
        other = head != cls
        if parts:
            size = np.diff(np.concatenate([start, [len(cls)]]))
            with_others = np.repeat(size > 1, size)
            found, first, count = np.unique(cls[with_others], return_index=True, return_counts=True)
            sizes, part = n[with_others][first], home(found, parts)
            if len(found):
                yield batch([(p, 0, deltas(found[at]), squeeze(count[at]), squeeze(sizes[at])) for p, at in cut(part, np.argsort(part, kind="stable"), parts)])
            return
        nodes, roots = local_roots(head[other], cls[other])
        apart = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], ["u", "v"])

    return run


def _often():
    """Classes that are in enough posting lists with others."""

    def run(batches):
        held = [(undo(x), expand(y, np.int64), expand(z, np.int64)) for b in batches for x, y, z in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
        if held:
            cls, count, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, first, place = np.unique(cls, return_index=True, return_inverse=True)
            total = np.bincount(place, weights=count).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[total >= common(n[first])])], ["class"])

    return run


def _member_blocks(parts: int):
    """(doc_id, class) -> answers for the documents' homes."""

    def run(batches):
        for b in batches:
            yield from reply(np.asarray(b.column(0)), np.asarray(b.column(1)).view(U), parts)

    return run


def _member_sets(width: int, parts: int):
    """Texts that answers name -> blocks of their sets by the class's home: x classes, y bytes, z n-grams."""

    def step(answers, doc, data, offsets):
        low, high = answers.bounds(doc)
        grams, bounds = gram_sets(data, offsets, width)
        cls = digests(grams, bounds)
        own = [i for i in np.flatnonzero(low < high).tolist() if cls[i] in answers.value[low[i] : high[i]].view(np.int64)]
        if own:
            part = home(cls[own], parts)
            rows = []
            for p, at in cut(part, np.argsort(part, kind="stable"), parts):
                pick = [own[k] for k in at.tolist()]
                bodies = [grams[bounds[i] : bounds[i + 1]].tobytes() for i in pick]
                rows.append((p, 1, squeeze(cls[pick]), squeeze(np.array([len(x) for x in bodies])), zstandard.ZstdCompressor(level=1).compress(b"".join(bodies))))
            yield batch(rows)

    return step


def _set_blocks(x, y, z):
    return expand(x, np.int64), expand(y, np.int64) // 8, np.frombuffer(zstandard.ZstdDecompressor().decompress(z), U)


def _gram_marks(parts: int):
    """Sets -> 32-bit marks of their n-grams by bucket, with the class."""

    def flush(held):
        cls, size, grams = (np.concatenate(x) for x in zip(*held, strict=True))
        who, part = np.repeat(cls, size), bucket_of(grams, parts)
        order = np.lexsort((who, part))
        mark = (grams >> U(32)).astype(np.uint32)
        return batch([(p, 0, deltas(who[at]), b"", mark[at].tobytes()) for p, at in cut(part, order, parts)])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for x, y, z in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                held.append(_set_blocks(x, y, z))
                size += len(held[-1][2])
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _counts(parts: int):
    """How many classes have each mark: sent back to the classes where there are two or more, 255 for that many or more."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for p, x, z in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                held.setdefault(p, []).append((undo(x), np.frombuffer(z, np.uint32)))
        for p in sorted(held):
            cls, mark = (np.concatenate(x) for x in zip(*held.pop(p), strict=True))
            order = np.lexsort((cls, mark))
            cls, mark = cls[order], mark[order]
            new = np.ones(len(mark), bool)
            new[1:] = (mark[1:] != mark[:-1]) | (cls[1:] != cls[:-1])
            cls, mark = cls[new], mark[new]
            start = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            size = np.diff(np.concatenate([start, [len(mark)]]))
            df = np.repeat(np.minimum(size, 255), size).astype(np.uint8)
            keep = df > 1
            yield from reply(cls[keep], mark[keep].astype(U) | U(p) << U(32), parts, df[keep])

    return run


def _shared_prefixes(num: int, den: int, parts: int, buckets: int):
    """Sets beside the counts of their n-grams -> postings of the prefixes, rarest n-grams first."""
    inner_held: list[tuple] = []

    def step(answers, cls, data, offsets):
        grams, bounds = np.frombuffer(data.tobytes(), U), offsets // 8
        sizes = np.diff(bounds)
        low, high = answers.bounds(cls)
        wanted = (grams >> U(32)) | bucket_of(grams, parts).astype(U) << U(32)
        for i in np.flatnonzero((high - low) * den >= sizes * num).tolist():
            own, want = grams[bounds[i] : bounds[i + 1]], wanted[bounds[i] : bounds[i + 1]]
            keys, df = answers.value[low[i] : high[i]], answers.second[low[i] : high[i]]
            at = np.searchsorted(keys, want)
            at[at == len(keys)] = 0
            count = np.where(keys[at] == want, df[at], 1)
            n, alone = len(own), int((count < 2).sum())
            prefix = n - -(-n * num // den) + 1
            if alone >= prefix:
                continue  # too few n-grams that any other set has
            order = np.lexsort((own, count))[alone:prefix]
            inner_held.append((own[order], np.full(len(order), cls[i]), np.full(len(order), n, np.uint32)))
        if sum(len(x[0]) for x in inner_held) > FLUSH:
            yield from drain()

    def drain():
        yield pack_postings(inner_held, buckets)
        inner_held.clear()

    inner = beside(step, U, np.uint8)

    def run(batches):
        inner_held.clear()
        yield from inner(batches)
        if inner_held:
            yield from drain()

    return run


def _placed(parts: int):
    """(class, cluster, blocks of the cluster) -> answers for the classes' homes."""

    def run(batches):
        for b in batches:
            yield from reply(np.asarray(b.column(0)), np.asarray(b.column(1)).view(U), parts, np.asarray(b.column(2)).astype(np.int32))

    return run


def _heap_merge(lists: list[list[int]]) -> Counter:
    """How often each entry stands in sorted lists, through a heap of the lists' heads."""
    return Counter(heapq.merge(*lists))


def long_lists(count: int, longest: int, least: int, mu: float) -> int:
    """L of DivideSkip: how many of `count` lists are only probed when `least` occurrences are wanted."""
    return max(0, min(count - 1, least - 1, int(least / (mu * np.log2(max(longest, 2)) + 1))))


class Work:
    """What a search read: merged entries of short lists, binary probes, all entries of the lists it had."""

    def __init__(self):
        self.merged = self.probes = self.entries = 0


def linked_sets(sets: list[np.ndarray], num: int, den: int, sides: np.ndarray | None = None, known: np.ndarray | None = None, mu: float = 0.0085, work: Work | None = None) -> np.ndarray:
    """For each set the smallest index that links lead to. With sides, only sets of different sides are compared; sets of one known component are joined already."""
    work, total = work or Work(), len(sets)
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    grams = np.concatenate([sets[i] for i in order]) if total else np.empty(0, U)
    by = np.argsort(grams, kind="stable")
    who = np.repeat(np.arange(total), size)[by]
    new = np.concatenate([[True], grams[by][1:] != grams[by][:-1]]) if len(grams) else np.empty(0, bool)
    heads, list_of = np.flatnonzero(new), np.cumsum(new) - 1
    entry = list_of * total + who  # sorted: one binary search finds a set in a list
    at = np.empty(len(grams), np.int64)
    at[by] = np.arange(len(grams))  # where each element of each set stands in its list
    bounds = np.concatenate([[0], np.cumsum(size)])
    side = sides[order] if sides is not None else None
    root = np.arange(total) if known is None else np.unique(known[order], return_index=True, return_inverse=True)[1][np.unique(known[order], return_inverse=True)[1]]
    members = {int(r): np.flatnonzero(root == r) for r in np.unique(root)} if known is not None else {}
    recent: list[int] = []

    def join(a: int, b: int):
        a, b = sorted((a, b))
        own = members.pop(b, np.array([b]))
        root[own] = a
        members[a] = np.concatenate([members.get(a, np.array([a])), own])

    def overlap(lists: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        wanted = (lists[:, None] * total + candidates).ravel()
        work.probes += len(wanted)
        place = np.searchsorted(entry, wanted)
        place[place == len(entry)] = 0
        return (entry[place] == wanted).reshape(len(lists), -1).sum(0)

    def complete(lists: np.ndarray, found: np.ndarray, occurs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that reach their wanted occurrences with the lists still to be probed, and all their occurrences."""
        for k in range(0, len(lists), 16):
            if not len(found):
                break
            occurs = occurs + overlap(lists[k : k + 16], found)
            keep = occurs + max(0, len(lists) - k - 16) >= wanted
            found, occurs, wanted = found[keep], occurs[keep], wanted[keep]
        return found, occurs

    for q in range(1, total):
        n = int(size[q])
        least = -(-num * n // den)
        low = int(np.searchsorted(size, least))
        if low >= q or n == 0:
            continue

        def open_(found, q=q):
            return (root[found] != root[q]) & (side[found] != side[q] if side is not None else True)

        def settle(found, occurs, lists, q=q, n=n):
            wanted = -(-num * (n + size[found]) // (num + den))  # of the pair: den * both >= num * (n + size - both)
            for r in np.unique(root[complete(lists, found, occurs, wanted)[0]]).tolist():
                join(int(root[r]), int(root[q]))

        if not open_(np.arange(low, q)).any():
            continue
        end = at[bounds[q] : bounds[q + 1]]
        lists = list_of[end]
        start = heads[lists]
        some = end > start  # lists that a smaller set is in
        work.entries += int((end - start).sum())
        if some.sum() < least:
            continue
        lists, start, end = lists[some], start[some], end[some]
        first = np.array([r for r in recent if r >= low], np.int64)
        first = first[open_(first)]
        if len(first):
            settle(first, np.zeros(len(first), np.int64), lists)
        if open_(np.arange(low, q)).any():
            rank = np.argsort(end - start, kind="stable")
            lists, start, end = lists[rank], start[rank], end[rank]
            long = long_lists(len(lists), int(end[-1] - start[-1]), least, mu)
            count = len(lists) - long
            span = end[:count] - start[:count]
            places = np.repeat(start[:count] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            entries, of = who[places], np.repeat(np.arange(count), span)
            keep = (entries >= low) & open_(entries)
            entries, of = entries[keep], of[keep]
            work.merged += len(entries)
            if len(entries) <= HEAP_MOST:
                cut_at = np.searchsorted(of, np.arange(count + 1)).tolist()
                merged = _heap_merge([entries[a:b].tolist() for a, b in zip(cut_at[:-1], cut_at[1:], strict=True) if a < b])
                found, occurs = np.fromiter(merged.keys(), np.int64, len(merged)), np.fromiter(merged.values(), np.int64, len(merged))
            else:
                found, occurs = np.unique(entries, return_counts=True)  # the same merge over long runs
            keep = occurs >= -(-num * (n + size[found]) // (num + den)) - long
            found, occurs = found[keep], occurs[keep]
            while len(found):
                # Of many, one of each component first: where it links, the others need no probes.
                some = np.unique(root[found], return_index=True)[1][: 1 << 16] if len(found) > 64 else np.arange(len(found))
                settle(found[some], occurs[some], lists[count:])
                rest = np.ones(len(found), bool)
                rest[some] = False
                rest &= open_(found)
                found, occurs = found[rest], occurs[rest]
        if root[q] in members:
            recent = [q, *(r for r in recent if root[r] != root[q])][:4]
    smallest = np.full(total, total)
    np.minimum.at(smallest, root, order)
    out = np.empty(total, np.int64)
    out[order] = smallest[root]
    return out


def _tasks():
    """Sets beside their clusters -> a row for the task of a set's block."""

    def step(answers, cls, data, offsets):
        low, high = answers.bounds(cls)
        own, raw = np.flatnonzero(low < high), data.tobytes()
        blocks = mix(cls.view(U))
        rows = [(int(answers.value[low[i]].view(np.int64)), int(blocks[i] % U(m)), int(cls[i]), m > 1, raw[offsets[i] : offsets[i + 1]]) for i in own.tolist() for m in [int(answers.second[low[i]])]]
        for k in range(0, len(rows), 2000):
            cluster, block, name, wide, body = (pa.array(x, t) for x, t in zip(zip(*rows[k : k + 2000], strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True))
            yield pa.RecordBatch.from_arrays([cluster, block, block, block, name, name, wide, body], TASK)

    return step


def _search(num: int, den: int):
    """Tasks -> links between components (u, v), and the sets of wide clusters (u, cluster, grams) for the passes to come."""

    def run(batches):
        tasks: dict[tuple, dict[int, tuple]] = {}
        for batch in batches:
            for c, i, j, k, cls, root, wide, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                tasks.setdefault((c, i, j), {})[cls] = (k, root, body, wide)
        links, kept = set(), []
        while tasks:
            (c, i, j), rows = tasks.popitem()
            classes = sorted(rows)
            sets = [np.frombuffer(rows[x][2], U) for x in classes]
            known = [rows[x][1] for x in classes]
            root = linked_sets(sets, num, den, None if i == j else np.array([rows[x][0] for x in classes]), np.array(known))
            links |= {(a, known[b]) for a, b in zip(known, root.tolist(), strict=True) if a != known[b]}
            kept += [(x, c, rows[x][2]) for x in classes if rows[x][3]]
        u, v = [a for a, _ in links], [b for _, b in links]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.binary())], ["u", "v", "cluster", "grams"])
        for k in range(0, len(kept), 2000):
            cls, cluster, body = zip(*kept[k : k + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.nulls(len(cls), pa.int64()), pa.array(cluster, pa.int64()), pa.array(body, pa.binary())], ["u", "v", "cluster", "grams"])

    return run


def _links(members: DataFrame, sets: DataFrame, num: int, den: int, p: int, block_grams: int) -> DataFrame:
    """(node, root) of the classes that links join: members has (class, n, cluster), sets their n-grams by home."""

    def search(tasks: DataFrame) -> DataFrame:
        return saved(tasks.select(*TASK).repartition(p, "cluster", "one", "two").mapInArrow(lean(_search(num, den)), "u long, v long, cluster long, grams binary"))

    def blocks(grams: str):
        return F.ceil(F.col(grams) / F.lit(share)).cast("int")

    def block(parts: str, salt: int):
        return F.pmod(F.xxhash64("class", F.lit(salt)), F.col(parts)).cast("int")

    share = min(block_grams, max((members.agg(F.sum("n")).first()[0] or 0) // p, LEAST_BLOCK))
    weights = members.groupBy("cluster").agg(F.sum("n").alias("weight")).where(F.col("weight") > share)
    # Clusters of more than a task's share: as many as tasks at most, unless block_grams is smaller than the share.
    wide = saved(weights.select("cluster", blocks("weight").alias("parts")))
    rows = wide.count()
    few = F.broadcast if rows <= 1 << 17 else lambda df: df  # a row of 24 bytes for each wide cluster
    placed = members.join(few(wide), "cluster", "left").select("class", "cluster", F.coalesce("parts", F.lit(1)))
    tasks = together(placed.mapInArrow(lean(_placed(p)), BLOCK), sets, p).mapInArrow(lean(beside(_tasks(), U, np.int32)), "cluster long, one int, two int, block int, class long, root long, wide boolean, grams binary")
    found = search(tasks)
    first, held = found.where("v is not null").select("u", "v"), found.where("grams is not null").select(F.col("u").alias("class"), "cluster", "grams")
    stars = first.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if not rows:
        return stars
    # What no link in its block has joined to another one, among themselves: a row for each component of a block.
    size = (F.octet_length("grams") / 8).alias("n")
    left = held.join(first, F.col("class") == F.col("u"), "left_anti")
    again = left.groupBy("cluster").agg(F.sum(size).alias("weight")).select("cluster", blocks("weight").alias("again"))
    name = F.col("class")
    second = search(left.join(few(again), "cluster").select("*", block("again", 1).alias("one"), name.alias("root"), F.lit(False).alias("wide")).select("*", F.col("one").alias("two"), F.col("one").alias("block"))).select("u", "v")
    up = second.select(F.col("u").alias("middle"), F.col("v").alias("top"))
    stars = saved(stars.join(up, F.col("root") == F.col("middle"), "left").select("node", F.coalesce("top", "root").alias("root")).union(second))
    # What is outside the largest component of its cluster, against all of it.
    now = held.join(stars, name == F.col("node"), "left").select("class", "cluster", "grams", size, F.coalesce("root", "class").alias("root"))
    components = now.groupBy("cluster", "root").agg(F.sum("n").alias("own"))
    major = components.groupBy("cluster").agg(F.max_by("root", F.struct("own", "root")).alias("major"), (F.sum("own") - F.max("own")).alias("outside")).where("outside > 0").join(wide, "cluster")
    every, own = F.sequence(F.lit(0), F.col("parts") - 1), block("parts", 2)
    meets = F.when((F.col("root") == F.col("major")) & (F.col("outside") <= share), F.array(own)).otherwise(every)
    pairs = F.col("outside") > share
    tasks = now.join(few(major), "cluster").select("*", own.alias("block"), F.explode(meets).alias("other"), F.lit(False).alias("wide"))
    tasks = tasks.withColumn("one", F.when(pairs, F.least("block", "other")).otherwise(F.col("other"))).withColumn("two", F.when(pairs, F.greatest("block", "other")).otherwise(F.col("other")))
    third = connected(search(tasks).select("u", "v"))
    last = third.select(F.col("node").alias("middle"), F.col("root").alias("top"))
    moved = stars.join(last, F.col("root") == F.col("middle"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(third.where("node <> root")).distinct()


def ngram_jaccard(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block_grams: int = 4_000_000) -> DataFrame:
    """(doc_id, n_shingles long, component_id long) for documents whose sets reach num/den are linked; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    p = partitions(spark)
    levels = spark.sparkContext.broadcast(rarity(docs, width))  # 256 KB at any size
    stats = saved(docs.mapInArrow(lean(_summary(width)), "doc_id long, at long, n long, class long"))
    lists = "bucket int, keys binary, classes binary, sizes binary"
    postings = docs.select("text").mapInArrow(lean(_postings(width, num, den, levels, p)), lists)
    met = postings.repartitionById(p, "bucket").mapInArrow(lean(_lists(num, den, p)), BLOCK).repartitionById(p, "part").mapInArrow(lean(_often()), "class long")
    full = stats.where("class <> 0")
    classes = full.groupBy("class").agg(F.min("at").alias("rep"), F.min("doc_id").alias("doc"), F.first("n").alias("n"))
    members = classes.join(met, "class").select("rep", "class").mapInArrow(lean(_member_blocks(p)), BLOCK)
    sets = together(members, docs.mapInArrow(lean(texts(p)), BLOCK), p).mapInArrow(lean(beside(_member_sets(width, p), U)), BLOCK)
    sets = saved(sets)
    counts = sets.mapInArrow(lean(_gram_marks(p)), BLOCK).repartitionById(p, "part").mapInArrow(lean(_counts(p)), BLOCK)
    shared = together(counts, sets, p).mapInArrow(lean(_shared_prefixes(num, den, p, p)), lists)
    clusters = connected(shared.repartitionById(p, "bucket").mapInArrow(lean(_lists(num, den)), "u long, v long"))
    members = saved(clusters.join(classes, F.col("node") == F.col("class")).select("class", "n", F.col("root").alias("cluster")))
    found = _links(members, sets, num, den, p, block_grams)
    roots = classes.join(found, classes["class"] == found["node"], "left").select("class", "doc", F.coalesce("root", "class").alias("root"))
    # A class no search has joined is its own root.
    smallest = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    labels = roots.join(smallest, "root").select("class", "component_id")
    # Empty sets, perhaps very many, meet nothing.
    empty = stats.where("class = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(labels, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)
