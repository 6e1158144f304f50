"""The corpus operators against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import byte_bpe, exact_topk, html_crf, license_scan, lz_fingerprint, ngram_jaccard, packing, quality_fm, substring_dedup, suffix_dedup
from tesserae.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, part int, n long, `class` long"


def make(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [make(rng, 120) for _ in range(4)]
    texts = [None, "", " \n\t ", "one", "One two", "a b c", "Grüße 😀 'tis x y  ", make(rng, 9000), "The The " * 2000]
    for b in base:
        w = b.split()
        texts += [b, b, b.upper(), " ".join(w[:60]), " ".join(w[40:]) + " end", " ".join([*w[:30], "NEW", *w[31:]]), make(rng, 20) + " " + " ".join(w[10:80]) + " " + make(rng, 30)]
    texts += [base[0] + " " + base[0], "x" * 400, "x" * 399, base[1] + "\nReleased under the MIT License.\n" + base[2]]
    return [(i * 3 % 101, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_equals_all_pairs(docs, rows, width, num):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard(docs, width, num, 100).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_blocks_lose_no_link(docs):
    whole = sorted(map(tuple, ngram_jaccard.ngram_jaccard(docs, 4, 85, 100).collect()))
    assert sorted(map(tuple, ngram_jaccard.ngram_jaccard(docs, 4, 85, 100, block_grams=50).collect())) == whole


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(150, 200)], rng.integers(0, 1 << 60, rng.integers(0, 20), dtype=np.uint64)])) for _ in range(60)]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert ngram_jaccard.linked_sets(sets, 80, 100).tolist() == root


def family(rng, count, size, edits):
    base = rng.integers(0, 1 << 60, size, dtype=np.uint64)
    return [np.unique(np.concatenate([rng.permutation(base)[: size - e], rng.integers(0, 1 << 60, e, dtype=np.uint64)])) for e in rng.integers(0, edits, count)]


def plain_components(sets, num, den, may=lambda i, j: True, joined=()):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (i, j) in joined or (may(i, j) and sets[i].size and den * both >= num * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("mu", [0.0, 0.0085, 0.5, 20.0])
def test_search_equals_all_pairs_for_any_split(mu):
    rng = np.random.default_rng(4)
    sets = family(rng, 40, 120, 30) + family(rng, 30, 60, 20) + [np.empty(0, np.uint64), np.array([5], np.uint64), np.array([5], np.uint64)]
    sides, known = rng.integers(0, 3, len(sets)), rng.integers(0, len(sets), len(sets))
    assert ngram_jaccard.linked_sets(sets, 80, 100, mu=mu).tolist() == plain_components(sets, 80, 100)
    assert ngram_jaccard.linked_sets(sets, 80, 100, sides, mu=mu).tolist() == plain_components(sets, 80, 100, lambda i, j: sides[i] != sides[j])
    same = {(i, j) for i in range(len(sets)) for j in range(i) if known[i] == known[j]}
    assert ngram_jaccard.linked_sets(sets, 80, 100, None, known, mu=mu).tolist() == plain_components(sets, 80, 100, joined=same)


def test_long_lists_are_probed_not_read():
    assert ngram_jaccard.long_lists(200, 1 << 20, 170, 0.0085) == 145  # T / (mu log2 M + 1)
    assert ngram_jaccard.long_lists(200, 2, 170, 0.0) == 169 and ngram_jaccard.long_lists(1, 9, 1, 0.1) == 0
    assert len({ngram_jaccard.long_lists(200, longest, 170, 0.05) for longest in (2, 64, 4096)}) == 3
    rng = np.random.default_rng(7)
    # Sets of one base that are linked with none: long lists for what they share.
    sets = [np.unique(np.concatenate([rng.permutation(base)[:175], rng.integers(0, 1 << 60, 25, dtype=np.uint64)])) for base in [rng.integers(0, 1 << 60, 200, dtype=np.uint64)] for _ in range(60)]
    read = {}
    for mu in (0.0085, 0.5, 100.0):
        work = read[mu] = ngram_jaccard.Work()
        assert ngram_jaccard.linked_sets(sets, 80, 100, mu=mu, work=work).tolist() == plain_components(sets, 80, 100)
    assert 0 < read[0.0085].merged < read[0.5].merged < read[100.0].merged <= read[100.0].entries
    assert read[0.0085].merged + read[0.0085].probes < read[100.0].entries
    # A family links through one probe of a set before: next to nothing is merged.
    near, work = family(rng, 300, 200, 8), ngram_jaccard.Work()
    assert set(ngram_jaccard.linked_sets(near, 80, 100, work=work).tolist()) == {0}
    assert work.merged < work.entries / 100 and work.probes < work.entries / 10


def test_components_of_any_graph(spark):
    rng = random.Random(2)
    graphs = [[(i, i + 1) for i in range(90)], [(0, i) for i in range(1, 60)] + [(59, 100), (101, 100)], [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)], [(3, 3), (None, 4)], []]
    for edges in graphs:
        root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
        for a, b in edges * len(edges):
            if a in root and b in root:
                low = min(root[a], root[b])
                root[a] = root[b] = low
        from tesserae.llm.common import connected

        assert dict(map(tuple, connected(spark.createDataFrame(edges, "u long, v long")).collect())) == root


def test_suffixes_equal_brute_force(docs, rows):
    seen, wanted = {}, {}
    for i, t in sorted(rows):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - 49):
            if seen.get(x[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        for k in range(len(x) - 49):
            seen.setdefault(x[k : k + 50], i)
        wanted[i] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(x, gone, strict=True) if not g))
    got = suffix_dedup.suffix_dedup(docs, 50).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got} == wanted
    carried = suffix_dedup.suffix_dedup(docs, 50, whole_characters=True, carry=("lang", "source")).collect()
    assert all(bytes(r["kept"]).decode() is not None and r["source"] == "s" and r["lang"] is None for r in carried) and len(carried) == len(rows)


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(1)
    runs = [sorted("".join(rng.choices("ab", k=8)).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]
    common = lambda a, b: next((i for i in range(8) if a[i] != b[i]), 8)
    keys = [[int.from_bytes(x, "big") for x in r] for r in runs]
    shared = [[0] + [common(a, b) for a, b in zip(r, r[1:])] for r in runs]
    which, place, lcp = suffix_dedup.merge_runs(keys, shared, 8)
    out = [runs[w][p] for w, p in zip(which, place, strict=True)]
    assert out == sorted(x for r in runs for x in r)
    assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(out, out[1:])]


def test_loser_tree_reads_no_known_prefix():
    rng = random.Random(5)
    width, common = 40, lambda a, b: next((i for i in range(40) if a[i] != b[i]), 40)
    runs = [sorted(b"the same thirty bytes in front." + "".join(rng.choices("abc", k=9)).encode() for _ in range(60)) for _ in range(8)]
    keys = [[int.from_bytes(x, "big") for x in r] for r in runs]
    shared = [[0] + [common(a, b) for a, b in zip(r, r[1:])] for r in runs]
    read = []
    which, place, lcp = suffix_dedup.merge_runs(keys, shared, width, read)
    out = [runs[w][p] for w, p in zip(which, place, strict=True)]
    assert out == sorted(x for r in runs for x in r) and lcp.tolist() == [0] + [common(a, b) for a, b in zip(out, out[1:])]
    # Once the tree is built every head shares the thirty-one bytes with the key that left before it.
    assert len(read) < 480 * 3 and max(read) <= width - 31


@pytest.mark.parametrize("window", [35, 8])
def test_substrings_equal_brute_force(docs, rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    count = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    for r in substring_dedup.substring_dedup(docs, window).collect():
        w = words[r["doc_id"]]
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))


def test_bpe_equals_library(docs, rows):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.byte_bpe(docs, path, ids=True).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def rank_file(folder, tokens):
    """A file of the 256 bytes, then the tokens in order, and the library's encoding of it."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + k for k, t in enumerate(tokens)}
    path = folder / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    return str(path), tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})


def as_words(words):
    raw = [w.encode() for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw])


def test_bpe_of_long_words_equals_library():
    import public_tokenizers
    import tiktoken

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlucmfwyp", k=50_000)), "x" * 200_000, "".join(rng.choices("ACGT", k=5000)), "".join(rng.choices("漢字かな", k=3000)), "the" * 700, "z" * 33, "-" * 9001, "=-" * 700]
    words += ["".join(rng.choices("abcdeé", k=n)) for n in range(28, 400, 7)]
    ids, bounds = byte_bpe.Coder(path).encode(*as_words(words))
    for w, a, z in zip(words, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:z].tolist() == library.encode_ordinary(w)


def test_bpe_of_any_ranks_equals_library(tmp_path):
    rng = random.Random(9)
    for _ in range(5):
        tokens = list({"".join(rng.choices("ab" if rng.random() < 0.6 else "abc", k=rng.randint(2, 6))).encode() for _ in range(40)})
        rng.shuffle(tokens)  # ranks that fall while a word is contracted
        path, library = rank_file(tmp_path, tokens)
        words = ["".join(rng.choices("ab", k=rng.randint(20, 500))) for _ in range(8)] + ["ab" * 40, "aab" * 100, "a" * 65, "b" * 900]
        tool = byte_bpe.Coder(path)
        ids, bounds = tool.encode(*as_words(words))
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode_ordinary(w) for w in words]
        assert tool.decode(ids, bounds, at_once=50) == [w.encode() for w in words]


def test_bpe_decodes_the_ids_of_each_text(spark, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    tool = byte_bpe.Coder(path)
    ids, bounds = tool.encode(*as_words(["one", "two", "", "\x00\x01é"]))
    assert tool.decode(ids, bounds) == [b"one", b"two", b"", "\x00\x01é".encode()]
    swapped = np.concatenate([ids[bounds[1] : bounds[2]], ids[: bounds[1]]])
    assert tool.decode(swapped, np.array([0, 0, len(swapped)])) == [b"", b"twoone"]
    import pyarrow as pa

    monkeypatch.setitem(byte_bpe._coders, path, tool)
    real = tool.vocabulary.ids
    tool.vocabulary.ids = lambda *a: (lambda ids, at: (ids[::-1], at))(*real(*a))  # what is decoded is what was encoded, not the text
    (out,) = byte_bpe._encode(path, True)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["ab, cd"]})])
    assert out.column("decoded").to_pylist() != [b"ab, cd"] and sorted(out.column("decoded")[0].as_py()) == sorted(b"ab, cd")


def test_pretokens_of_equal_hashes_stay_apart(monkeypatch):
    from tesserae.llm import pretokens

    class Few(pretokens.Spans):
        def hash(self, start, end):
            return super().hash(start, end) % np.uint64(3)

    monkeypatch.setattr(pretokens, "Spans", Few)
    held = pretokens.Vocabulary(lambda body, length: ((body, np.concatenate([[0], np.cumsum(length)])),), (np.uint8,))
    for text in ("one two three four one", "five one two six", "a bb ccc"):
        data = np.frombuffer(text.encode(), np.uint8)
        places, _ = pretokens.split(data, np.array([0, len(data)]))
        assert held.ids(data, places)[0].tobytes() == text.encode()


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_gapless_and_tight(docs, rows, capacity):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, found = Tokenizer.from_file(path), packing.best_fit_packing(docs, path, capacity).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    for r in found:
        body = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(body) == r["length"] and zlib.crc32(np.array(body, "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == capacity
    assert sum(r["length"] for r in found) == sum(map(len, ids.values()))
    ends = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends[r["sequence_id"]] == r["offset"]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= capacity
    assert len(ends) <= -(-sum(ends.values()) // capacity) * 1.05 + 1


def test_packing_plan_holds_every_piece():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 2049, 5000), minlength=2049)
    used = np.zeros(2049, np.int64)
    for lengths, times in packing.plan(histogram, 2048):
        assert sum(lengths) <= 2048 and times > 0
        for n in lengths:
            used[n] += times
    assert (used == histogram).all()


def plain_phrases(text):
    """The LZ78 phrases of bytes by the book; an unfinished phrase at the end is none."""
    known, phrase = set(), b""
    for k in range(len(text)):
        phrase += text[k : k + 1]
        if phrase not in known:
            known.add(phrase)
            phrase = b""
    return known


def test_phrases_and_minima_equal_plain_sets(rows):
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        ends, _ = lz_fingerprint.phrase_ends(t, {})
        assert {t[a:b] for a, b in zip([0, *ends], ends)} == plain_phrases(t)
        assert len(ends) == len(plain_phrases(t))
    small = [t for t in texts if len(t) < 2000]
    signs = lz_fingerprint.signatures(small, [lz_fingerprint.phrase_ends(t, {})[0] for t in small])
    gaps = []
    for i in range(len(small)):
        for j in range(i):
            a, b = plain_phrases(small[i]), plain_phrases(small[j])
            if len(a | b) > 60:
                gaps.append(float(lz_fingerprint.likeness(signs[i : i + 1], signs[j : j + 1])[0]) - len(a & b) / len(a | b))
    assert len(gaps) > 100 and abs(np.mean(gaps)) < 0.03 and max(map(abs, gaps)) < 0.25


def test_fingerprints(docs, rows):
    order = sorted(rows, reverse=True)
    found = {r["doc_id"]: r for r in lz_fingerprint.lz_fingerprint(docs).collect()}
    by_text = {}
    for k, (i, t) in enumerate(order):
        text, after, r = t or "", order[(k + 1) % len(order)][1] or "", found[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if edited == text:
            assert r["near_edited"] == 1 and r["edited_fingerprint"] == r["fingerprint"]
        if after == text:
            assert r["near_next"] == 1
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def best_products(vectors, k=20, every=20):
    """(query_id, rank, vec_id, score) by comparing every query row with every other row."""
    width = max([len(v) for _, v in vectors if v is not None], default=0)
    clean = [(i, np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, width - len(v)))) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for n, (q, x) in enumerate(clean):
        if q % every == 0:
            best = sorted((-int(x @ c), i) for m, (i, c) in enumerate(clean) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def vectors_frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in vectors], "vec_id long, embedding array<float>, label int, score string").repartition(parts)


def test_top_k_equals_all_scores(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 9), 1)]) for i in range(130)]
    vectors += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan")] * 9), (203, [float("inf")] * 9), (None, [1.0] * 9), (204, [1.0, 2.0]), (205, [])]
    assert sorted(map(tuple, exact_topk.exact_topk(vectors_frame(spark, vectors)).collect())) == best_products(vectors)


def test_top_k_takes_repeated_ids_as_rows(spark):
    rng = np.random.default_rng(5)
    make_vector = lambda: [float(x) for x in np.round(rng.normal(0, 0.3, 6), 1)]
    same = make_vector()
    vectors = [(i, make_vector()) for i in range(60)] + [(20, make_vector()), (40, same), (40, same), (40, same), (40, [*same, 0.0]), (7, same), (7, same)] + [(80, [3.0] * 6)] * 30
    vectors += [(100, []), (100, []), (100, [0.0])]
    wanted = best_products(vectors)
    assert sum(r[0] == 40 for r in wanted) == 100
    for parts in (1, 5):
        assert sorted(map(tuple, exact_topk.exact_topk(vectors_frame(spark, vectors, parts)).collect())) == wanted
    few = vectors[:3] + [(0, vectors[0][1])]
    assert sorted(map(tuple, exact_topk.exact_topk(vectors_frame(spark, few)).collect())) == best_products(few)


def test_top_k_grid_covers_all_pairs(spark):
    vectors = [(i % 70, [float((i * j) % 7) / 8 for j in range(1, 5)]) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "45"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(map(tuple, exact_topk.exact_topk(vectors_frame(spark, vectors), k=5, every=5).collect())) == best_products(vectors, 5, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert exact_topk.grid(2000, 20) == (10, 200) and exact_topk.grid(8, 20) == (1, 8)


def test_quality_learns_and_scores_everything(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_fm.quality_fm(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) > 500 and (held.predicted == held.quality).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(found.doc_id, found.held_out, strict=True))


def test_machine_equals_explicit_pairs():
    rng = np.random.default_rng(1)
    machine = quality_fm.Machine(0.3)
    machine.weight = rng.normal(0, 1, quality_fm.SIZE).astype(np.float32)
    machine.vectors = rng.normal(0, 0.5, machine.vectors.shape).astype(np.float32)
    data = "One two two three. Ünd 4 FIVE! one".encode() + b"\nlone"
    index, value, bounds = quality_fm.features(np.frombuffer(data, np.uint8), np.array([0, len(data) - 4, len(data)]))
    logits, _ = machine.terms(index, value, bounds)
    for row, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        i, x = index[a:z], value[a:z].astype(float)
        pairs = sum(float(machine.vectors[i[p]].astype(float) @ machine.vectors[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert logits[row] == pytest.approx(0.3 + machine.weight[i] @ x + pairs, rel=1e-3, abs=1e-3)


def test_quality_sample_is_bounded_by_repeated_ids(spark):
    docs = frame(spark, [(4, "good words here"), (4, "good words here"), (4, "bad !!!"), *[(8, "bad !!! ###")] * 50])
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_fm.quality_fm(docs, labels)
    assert found.count() == 53 and len({r["score"] for r in found.where("doc_id = 8").collect()}) == 1


def test_quality_edges(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_fm.quality_fm(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 0), (3, None, 0), (None, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in quality_fm.quality_fm(docs, one).collect()} == {1}
    assert quality_fm.quality_fm(empty, one).count() == 0
    assert quality_fm.quality_filter(docs, one).count() == len(rows)


def test_field_on_unseen_designs():
    field = html_crf.trained()
    sets = html_crf.training_set(200, seed=77)
    right = sum(a == b for rows, labels in sets for a, b in zip(field.viterbi(rows), labels, strict=True))
    assert right / sum(len(labels) for _, labels in sets) > 0.98


def test_pages(spark):
    pages = [
        (1, "u", '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First  line<br>goes\n on, and is long enough.<p>Second &lt;one&gt;.</article><section class="comments"><p>Nice text, I think.</p></section><footer>&copy; X</footer>'),
        (2, "u", None), (3, None, ""), (None, "u", "<p>cut in a ta"), (5, "u", "<!-- only --><style>p{}</style>"), (6, "u", "<article><p>" + "long words here. " * 20000 + "</p></article"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r for r in html_crf.html_crf(df).collect()}
    assert found[1]["text"] == "A & B\nFirst line goes on, and is long enough.\nSecond <one>."
    assert found[2]["text"] == found[3]["text"] == found[5]["text"] == "" and found[2]["n_chars"] == 0
    assert found[6]["n_chars"] == len("long words here. " * 20000) - 1


@pytest.mark.parametrize("markup", [
    ("<p title=it's>Hello there, friends.</p><p>World's end is here, they say.</p>", "Hello there, friends.\nWorld's end is here, they say."),
    ("<p data-x='a>b' id=one>First words of it.</p><p title=\"a > b\">Second words of it.</p>", "First words of it.\nSecond words of it."),
    ("<p title=\"never closed>One long sentence here.</p><p>Another long sentence here.</p>", "One long sentence here.\nAnother long sentence here."),
    ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math>, as they say.</p>", "Energy is E=m, as they say."),
    ("<p>Text before it all.</p><noscript><p>Pictures of the long trip.</p></noscript><p>Text after it all.</p>", "Text before it all.\nPictures of the long trip.\nText after it all."),
    ("<!--><p>After an empty comment.</p><!-- x --!><p>And after another one.</p>", "After an empty comment.\nAnd after another one."),
    ("<p>Some words<svg><title>icon</title></svg> go on here.</p><svg/><p>More words go on.</p>", "Some words go on here.\nMore words go on."),
    ("<p>Words before a script.</p><SCRIPT src=a>var x = '<p>no</p>';</SCRIPT ><p>Words after a script.</p>", "Words before a script.\nWords after a script."),
])
def test_markup_is_read(markup):
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1>{markup[0]}</article><footer>&copy; X</footer></body></html>"
    assert html_crf.extract(page, html_crf.trained())[0] == "A title\n" + markup[1]


def test_deep_pages_cost_no_more():
    import time

    deep = "<article>" + "<div>" * 30000 + "<p>The words in the middle, at last.</p>" + "<p>And some other words.</p>" * 2000 + "</div>" * 30000 + "</article>"
    start = time.time()
    found = html_crf.blocks(deep)
    assert len(found) == 2001 and time.time() - start < 5
    assert len({id(state) for _, state, _ in found}) == 1
    assert len(html_crf.blocks("<p x=\"" * 20000 + "</b" * 20000)) <= 1 and time.time() - start < 20


def test_viterbi_and_gradient_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    field = html_crf.Field()
    field.emission = rng.normal(0, 1, field.emission.shape)
    field.transition, field.start = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    pages = [([tuple(rng.choice(len(field.emission), 3, replace=False).tolist()) for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (1, 2, 5, 8)]

    def score(f, rows, labels):
        s = f.start[labels[0]] + sum(f.emission[i, y] for r, y in zip(rows, labels, strict=True) for i in r)
        return s + sum(f.transition[a, b] for a, b in zip(labels, labels[1:]))

    def loss(f):
        return -np.mean([score(f, r, y) - np.logaddexp.reduce([score(f, r, z) for z in product((0, 1), repeat=len(r))]) for r, y in pages])

    for rows, _ in pages:
        assert field.viterbi(rows) == list(max(product((0, 1), repeat=len(rows)), key=lambda z: score(field, rows, z)))
    # One step without decay moves each weight against the sign of its slope; slopes by finite differences.
    for name, at in [("transition", (0, 1)), ("transition", (1, 1)), ("start", (0,)), *(("emission", (i, k)) for i in pages[2][0][1] for k in (0, 1))]:
        slopes = []
        for d in (1e-5, -1e-5):
            other = html_crf.Field()
            for n in ("emission", "transition", "start"):
                setattr(other, n, getattr(field, n).copy())
            getattr(other, name)[at] += d
            slopes.append(loss(other))
        slope = (slopes[0] - slopes[1]) / 2e-5
        moved = html_crf.Field()
        for n in ("emission", "transition", "start"):
            setattr(moved, n, getattr(field, n).copy())
        moved.learn(pages, rounds=1, step=1e-3, decay=0.0)
        change = getattr(moved, name)[at] - getattr(field, name)[at]
        assert change == pytest.approx(-1e-3 * slope / np.sqrt(1e-6 + slope**2), rel=1e-3, abs=1e-9)


def test_licenses(docs, rows, spark):
    found = license_scan.license_scan(docs).collect()
    text = dict(rows)
    assert [(r["license"], text[r["doc_id"]][r["begin"] : r["end"]], r["coverage"]) for r in found] == [("MIT-line", "Released under the MIT License", 1.0)]
    near = "é words. Licensed under the new Apache License, Version 2.0, and more. " + "This work is licenced under the GNU General Public License, version 3."
    got = license_scan.license_scan(frame(spark, [(1, near), (1, near), (2, "the Apache license is nice"), (None, "Licensed under CC BY-NC 4.0.")])).collect()
    assert sorted((str(r["doc_id"]), r["license"]) for r in got) == [("1", "Apache-2.0-line")] * 2 + [("1", "GPL-3.0-line")] * 2 + [("None", "CC-BY-NC-4.0-line")]


def scan_one(text, templates=license_scan.TEMPLATES, coverage=0.8):
    import pyarrow as pa

    run = license_scan._scan(license_scan.index_of(templates), coverage)
    return [r for b in run([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})]) for r in b.to_pylist()]


def plain_scan(text, templates, coverage=0.8):
    """(license, begin, end, matched) by whole alignments through every pair of equal words, without fingerprints or band."""
    spans = [m.span() for m in re.finditer("[a-z0-9]+", text.lower())]
    tokens = [text.lower()[a:b] for a, b in spans]

    def one_way(left, right):
        best, rows = (0, 0, 0), [[(-j, 0, 0) for j in range(len(right) + 1)]]
        for i, w in enumerate(left):
            row = [(-i - 1, 0, 0)]
            for j, v in enumerate(right):
                s, m, e = rows[i][j]
                row.append(max((s + 2, m + 1, -j - 1) if w == v else (s - 1, m, e), *((x[0] - 1, *x[1:]) for x in (rows[i][j + 1], row[j]))))
            rows.append(row)
            best = max(best, max(row))
        return best

    found = set()
    for t, words in enumerate(re.findall("[a-z0-9]+", x.lower()) for x in templates.values()):
        for i in range(len(words)):
            for j in range(len(tokens)):
                if words[i] == tokens[j]:
                    after, before = one_way(words[i:], tokens[j:]), one_way(words[:i][::-1], tokens[:j][::-1])
                    if (after[1] + before[1]) / len(words) >= coverage:
                        found.add((after[0] + before[0], after[1] + before[1], t, j + before[2], j - after[2]))
    out = []
    for _, m, t, a, z in sorted(found, key=lambda r: (-r[0], -r[1], *r[2:])):
        if all(z <= b or a >= e for _, b, e, _ in out):
            out.append((list(templates)[t], a, z, m))
    return [(n, spans[a][0], spans[z - 1][1], m) for n, a, z, m in sorted(out, key=lambda r: r[1])]


def test_winnowing_finds_every_template():
    rng = random.Random(8)
    for name, line in license_scan.TEMPLATES.items():
        for _ in range(5):
            assert [r["license"] for r in scan_one(f"{make(rng, 30)}\n{line}\n{make(rng, 30)}")] == [name]
    with pytest.raises(ValueError):
        license_scan.index_of({"short": "sixteen bytes in"})
    assert len(scan_one("seventeen bytes x, Seventeen bytes x!", {"short": "seventeen bytes x"})) == 2


@pytest.mark.parametrize("copies", [1, 2, 3, 4, 7, 40])
def test_neighbouring_copies_are_matches_of_their_own(copies):
    line = license_scan.TEMPLATES["MIT-line"]
    found = scan_one("é " + " ".join([line] * copies))
    assert [(r["begin"], r["end"]) for r in found] == [(2 + 32 * k, 32 + 32 * k) for k in range(copies)]


def test_matches_equal_whole_alignments():
    rng = random.Random(12)
    some = {n: license_scan.TEMPLATES[n] for n in ("MIT-line", "Apache-2.0-line", "GPL-3.0-line", "CC-BY-SA-line", "BSD-grant")}
    seen = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = some[rng.choice(list(some))].split()
            if rng.random() < 0.5 and len(words) > 8:  # an edit near the end leaves a long run in place
                at = len(words) - rng.randint(1, 2)
                words = rng.choice((words[:at] + ["brand", "new"] + words[at:], words[:at] + words[at + 1 :], words[:at] + ["other"] + words[at + 1 :]))
            parts += [*words, *(["und", "außer"][: rng.randint(0, 2)])]
        text = " ".join(parts)
        got = [(r["license"], r["begin"], r["end"], r["matched"]) for r in scan_one(text, some)]
        assert got == plain_scan(text, some)
        seen += len(got)
    assert seen > 100


def test_empty_tables(spark, empty):
    for found in (
        ngram_jaccard.ngram_jaccard(empty), suffix_dedup.suffix_dedup(empty), substring_dedup.substring_dedup(empty), lz_fingerprint.lz_fingerprint(empty), license_scan.license_scan(empty),
        byte_bpe.byte_bpe(empty, tokenizer_path("byte_bpe_50k.tiktoken")), packing.best_fit_packing(empty, tokenizer_path("byte_bpe_50k.json")),
        html_crf.html_crf(spark.createDataFrame([], "page_id long, url string, html string")), exact_topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert found.count() == 0


def test_null_ids_and_repeated_rows(spark, rows):
    text = rows[10][1]
    df = frame(spark, [(None, text), (4, text), (4, text), (None, None), (9, None)])
    assert sorted(str(r["component_id"]) for r in ngram_jaccard.ngram_jaccard(df).collect()) == ["4", "4", "4", "9", "None"]
    removed = suffix_dedup.suffix_dedup(df).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in removed) == [("4", False), ("4", False), ("9", False), ("None", False), ("None", True)]
    assert sum(r["n_removed"] > 0 for r in substring_dedup.substring_dedup(df).collect()) == 3
    assert lz_fingerprint.lz_fingerprint(df).count() == 5
    assert packing.best_fit_packing(df, tokenizer_path("byte_bpe_50k.json")).count() == 5
    assert byte_bpe.byte_bpe(df, tokenizer_path("byte_bpe_50k.tiktoken")).count() == 5


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "packing"]
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            sets = {r["doc_id"]: shingles(r["text"], 5) for r in docs.collect()}
            kept = {r["doc_id"] for r in out.collect()}
            link = {i: {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * max(1, len(sets[i] | sets[j]))} for i in sets}
            reach = {}
            for i in sorted(sets):
                if i not in reach:
                    todo = [i]
                    while todo:
                        j = todo.pop()
                        if j not in reach:
                            reach[j] = i
                            todo += link[j]
            assert kept == set(reach.values())
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(3)
    one, two, three = (make(rng, 80) for _ in range(3))
    rows = [(5, one), (5, one), (9, one + " more"), (None, one), (None, two), (None, two), (None, two + " end"), (7, three), (8, None), (8, None), (None, ""), (None, None)]
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect()))
    assert got[:3] == [(False, 5, one), (False, 7, three), (False, 8, "")]
    assert [t for n, _, t in got if n and t] in ([two], [two + " end"])  # and texts without words, linked with nothing
    assert corpus_pipeline.near_duplicates(spark, frame(spark, [(1, "a")]).limit(0), "").count() == 0


def test_pipeline_leaves_one_table(spark, tmp_path):
    from tesserae.llm.common import dropped, shared_folder, stored

    table = stored(spark.range(5))
    folder = table.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    import os

    assert os.path.isdir(folder) and os.path.basename(os.path.dirname(folder)) == os.path.basename(shared_folder(spark))
    dropped(table)
    assert not os.path.exists(folder)


def test_pipeline_moves_texts_once(spark, docs):
    import corpus_pipeline

    plan = corpus_pipeline.near_duplicates(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key#") == 1


def test_saved_leaves_no_shuffle_files(spark):
    from tesserae.llm.common import SHUFFLES_GO, saved

    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return set(re.findall(r"shuffle_\d+_\d+_\d+", blocks.mkString(" ")))

    spark.conf.set(SHUFFLES_GO, "false")
    before = files()
    kept = saved(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(SHUFFLES_GO) == "false"
    assert sorted(map(tuple, kept.collect())) == [(k, 143 - (k > 5)) for k in range(7)]


def test_ngram_jaccard_links_through_texts_without_ids(spark):
    words = [f"w{i}" for i in range(100)]
    # Neighbours share 56 of 68 pairs or more; the outer two only 48 of 75.
    first, bridge, last = (" ".join(words[k : k + 61]) for k in (0, 7, 14))
    lone = " ".join(f"z{i}" for i in range(60))
    df = spark.createDataFrame([(7, first), (None, bridge), (3, last), (None, lone), (None, None)], "doc_id long, text string")
    got = ngram_jaccard.ngram_jaccard(df, 2, 75, 100).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("7", "3"), ("None", "3"), ("None", "None"), ("None", "None")]
    apart = ngram_jaccard.ngram_jaccard(df.where("doc_id is not null"), 2, 75, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in apart) == [(3, 3), (7, 7)]
