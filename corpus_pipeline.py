"""A training corpus from `documents`: quality classifier, near-duplicates, repeated passages, packing.

Every stage but the last takes and returns the columns of documents, and works on all that the stage
before it kept. Nulls in a text are empty texts; the operators' modules say how other cases count.

Rows of one doc_id are one document, of which near_duplicates keeps one row, that of the smallest text;
ids lie below 2**62. Documents without doc_id are told apart by their texts: one that is linked with a
document that has an id goes, and of those linked only among themselves one stays, its id still null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import dropped, stored, table
from tesserae.llm.ngram_jaccard import ngram_jaccard
from tesserae.llm.packing import best_fit_packing
from tesserae.llm.quality_fm import quality_filter
from tesserae.llm.queries import tokenizer_path
from tesserae.llm.repeats import NO_ID
from tesserae.llm.suffix_dedup import suffix_dedup

#: The stages need a learned model and a tokenizer, which SQL cannot express; tests/llm holds them against brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.7 or more)."""
    return quality_filter(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    nameless = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID - 1))
    named = docs.select(*COLUMNS, F.coalesce("doc_id", nameless).alias("key"))
    found = ngram_jaccard(named.select(F.col("key").alias("doc_id"), "text"), width=5, num=80, den=100)
    rows = found.groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("times"), F.bool_and(F.col("component_id") != F.col("doc_id")).alias("linked"))
    marks = rows.where("linked or times > 1").select("key", "linked").hint("shuffle_hash")
    # Keys without a mark stand once, so one window over the joined rows decides all, and texts move once.
    left = named.join(marks, "key", "left").where("linked is null or not linked")
    first = F.row_number().over(Window.partitionBy("key").orderBy("text", *(c for c in COLUMNS if c != "text")))
    return left.withColumn("place", first).where("place = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that a document of smaller doc_id has too; characters stay whole."""
    found = suffix_dedup(docs.select(*COLUMNS), length=50, whole_characters=True, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder, which goes once the next one is written."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir)), held
        held = docs
        if before is not None:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
