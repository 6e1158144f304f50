"""Sources that are text logs: filter logs, metadata prints and disassembly listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_analysis(logs: DataFrame, ident: str, line: str, order: str) -> DataFrame:
    """Interlace verdict (more interlaced than progressive frames) and the last crop of each source's log."""
    count = lambda name: F.sum(F.coalesce(F.regexp_extract(line, rf"{name}:\s*(\d+)", 1).try_cast("long"), F.lit(0)))
    crop = F.nullif(F.regexp_extract(line, r"crop=(\d+:\d+:\d+:\d+)", 1), F.lit(""))
    return logs.groupBy(ident).agg(((count("TFF") + count("BFF")) > count("Progressive")).alias("interlaced"), F.max_by(crop, F.when(crop.isNotNull(), F.col(order))).alias("crop"))


def disassembly(lines: DataFrame, ident: str, order: str, line: str) -> DataFrame:
    """Instructions of a listing with the section and symbol they stand under: (ident, order, section, symbol, address, mnemonic, operands)."""
    w = Window.partitionBy(ident).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda pattern: F.last(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), ignorenulls=True).over(w)
    rows = lines.select(ident, order, line, last(r"^Disassembly of section (\S+):").alias("section"), last(r"^[0-9a-f]+ <([^>]+)>:").alias("symbol"))
    code = r"^\s*([0-9a-f]+):\t[0-9a-f ]+\t(\S+)\s*(.*)$"
    return rows.where(F.col(line).rlike(code)).select(ident, order, "section", "symbol", *(F.regexp_extract(line, code, k).alias(n) for k, n in ((1, "address"), (2, "mnemonic"), (3, "operands"))))


def sticky(rows: DataFrame, ident: str, order: str, value: str, cleared: str) -> DataFrame:
    """The last value set and not cleared since, at each row."""
    w = Window.partitionBy(ident).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col(cleared), F.struct(F.lit(None).cast("string").alias("v"))).when(F.col(value).isNotNull(), F.struct(F.col(value).cast("string").alias("v")))
    return rows.withColumn("held", F.last(mark, ignorenulls=True).over(w)["v"])
