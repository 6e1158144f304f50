"""The operators' queries over whole tables, with production parameters, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Word class of the contracts: anything but x20 and x09-x0D.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_crf import html_crf

    return html_crf(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import ngram_jaccard

    return ngram_jaccard(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


OP2_SQL = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {WORDS.format(ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
rare AS (
    SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS place
    FROM shingles JOIN (SELECT s, count(*) AS df FROM shingles GROUP BY s) USING (s) JOIN sizes USING (doc_id)
),
candidates AS (
    SELECT DISTINCT a.doc_id AS one, b.doc_id AS two
    FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id < b.doc_id
    WHERE a.place <= a.n - ceil(a.n * 85 / 100.0) + 1 AND b.place <= b.n - ceil(b.n * 85 / 100.0) + 1
),
links AS (
    SELECT c.one, c.two
    FROM candidates c JOIN shingles a ON a.doc_id = c.one JOIN shingles b ON b.doc_id = c.two AND b.s = a.s
         JOIN sizes x ON x.doc_id = c.one JOIN sizes y ON y.doc_id = c.two
    GROUP BY c.one, c.two, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
edges AS (SELECT one, two FROM links UNION ALL SELECT two, one FROM links),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.two FROM reach r JOIN edges e ON e.one = r.other
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    found = suffix_dedup(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM bytes),
grams AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM starts),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM grams) WHERE first < doc_id),
steps AS (
    SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM repeated
),
runs AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
    SELECT doc_id, b AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS y, run FROM spans
    UNION ALL SELECT doc_id, 0, min(a), 0 FROM spans GROUP BY doc_id
),
kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, len(h) // 2) - x)), '' ORDER BY run) AS k
    FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM bytes LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS s FROM spans GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH words AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM words),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(w[p:p + 34], ' ')) AS n FROM starts) WHERE n > 1),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
marked AS (
    SELECT p.doc_id, p.i, p.w[p.i] AS word, r.p IS NOT NULL AS hit FROM places p LEFT JOIN repeated r ON r.doc_id = p.doc_id AND r.p = p.i
),
covered AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS k FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import byte_bpe

    return byte_bpe(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048)


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import quality_fm

    return quality_fm(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"), coverage=0.8)


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz_fingerprint import lz_fingerprint

    return lz_fingerprint(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


OP9_SQL = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT q.vec_id AS query_id, q.place, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs) WHERE rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_crf": op1_html_crf,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_fm": op4_quality_fm,
    "op5_license_scan": op5_license_scan,
    "op6_lz_fingerprint": op6_lz_fingerprint,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_topk": op9_exact_topk,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op9_exact_topk": OP9_SQL}
