"""Ordered operators that do not bring a whole order into one task.

A long key is cut in ranges by approximate quantiles (a constant number of values on the driver). Running
values are windows within ranges plus one carried value for each range, taken from a table with a row
a range. Within a range rows are ordered by the key and the given tie columns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(value: Column, cuts: Iterable[float]) -> Column:
    """How many of the distinct whole parts of cuts are at most value; 0 for null.

    The cuts are one constant in blocks of about the square root of their number: a row is compared with
    the blocks' first cuts and then within one block, so 20,000 cuts cost some 280 comparisons a row.
    """
    known = sorted({min(int(c), (1 << 63) - 1) for c in cuts})
    if not known:
        return F.lit(0)
    width = math.isqrt(len(known) - 1) + 1
    blocks = [known[i : i + width] for i in range(0, len(known), width)]
    below = lambda array: F.size(F.filter(array, lambda c: c <= value))
    block = below(F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<bigint>")) - 1
    inside = F.get(F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>"), block)
    return F.when(block < 0, F.lit(0)).otherwise(block * width + below(inside))


def ranged(df: DataFrame, key: str, name: str = "_range") -> DataFrame:
    """df with the number of its range of `key`, from 0; nulls are in range 0."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return df.withColumn(name, place(F.col(key), cuts))


def _carry(parts: DataFrame, value: Column, how) -> DataFrame:
    """For each range, `how` over the values of the ranges before it."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return parts.withColumn("_carried", how(value).over(before)).select("_range", "_carried")


def running_sum(df: DataFrame, key: str, value: Column, name: str, *ties: str) -> DataFrame:
    """df with the sum of value up to each row in the order of key and ties."""
    cut = ranged(df, key).withColumn("_value", value)
    carried = _carry(cut.groupBy("_range").agg(F.sum("_value").alias("_total")), F.col("_total"), F.sum)
    upto = Window.partitionBy("_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(F.broadcast(carried), "_range").withColumn(name, F.coalesce("_carried", F.lit(0)) + F.sum("_value").over(upto)).drop("_range", "_value", "_carried")


def numbered(df: DataFrame, key: str, name: str, *ties: str) -> DataFrame:
    """df with dense numbers from 0 in the order of key and ties."""
    return running_sum(df, key, F.lit(1), name, *ties).withColumn(name, (F.col(name) - 1).cast("long"))


def last_flag(df: DataFrame, key: str, flag: Column, name: str) -> DataFrame:
    """df with the greatest key up to each row at which flag holds."""
    cut = ranged(df, key).withColumn("_value", F.when(flag, F.col(key)))
    carried = _carry(cut.groupBy("_range").agg(F.max("_value").alias("_total")), F.col("_total"), F.max)
    upto = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(F.broadcast(carried), "_range").withColumn(name, F.greatest("_carried", F.max("_value").over(upto))).drop("_range", "_value", "_carried")


def asof(points: DataFrame, key: str, starts: DataFrame, start: str, name: str, before_first: bool = True) -> DataFrame:
    """points with the greatest start <= key; keys before the first start get the first one, or null."""
    marks = starts.select(F.col(start).cast("long").alias(key)).distinct().withColumn("_mark", F.lit(True))
    union = points.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # A mark of the same key stands before the point, as the running maximum takes equal keys: order marks first.
    cut = ranged(union, key).withColumn("_value", F.when(F.col("_mark"), F.col(key)))
    carried = _carry(cut.groupBy("_range").agg(F.max("_value").alias("_total")), F.col("_total"), F.max)
    upto = Window.partitionBy("_range").orderBy(F.col(key), F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.join(F.broadcast(carried), "_range").withColumn(name, F.greatest("_carried", F.max("_value").over(upto))).where(~F.col("_mark")).drop("_range", "_value", "_carried", "_mark")
    if not before_first:
        return found
    first = starts.agg(F.min(start).cast("long").alias("_first"))
    return found.join(F.broadcast(first)).withColumn(name, F.coalesce(name, "_first")).drop("_first")


def interval(points: DataFrame, key: str, spans: DataFrame, start: str, end: str) -> DataFrame:
    """points with the span [start, end) that holds key, from non-overlapping spans; null without one."""
    found = asof(points, key, spans, start, "_start", before_first=False)
    named = spans.select(F.col(start).cast("long").alias("_start"), F.col(end).alias("_end"))
    return found.join(named, "_start", "left").withColumn(start, F.when(F.col(key) < F.col("_end"), F.col("_start"))).drop("_start", "_end")
