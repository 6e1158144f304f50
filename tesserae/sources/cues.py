"""Cues as fixed records: clipped to a window, cut where the next one starts, in frames and glyphs."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FPS_DEN, FPS_NUM
from ..operators.change import trim_spans
from ..operators.encode import wrap

# Columns and rows of a record; places of the glyphs, 0 for those that the font lacks.
COLUMNS, ROWS = 40, 2
GLYPHS = {c: first + i for chars, first in ((string.digits, 2), (":/", 12), (string.ascii_uppercase, 24), (string.ascii_lowercase, 50), ("%.-,'?!", 76)) for i, c in enumerate(chars)}


def glyph(c: str) -> int:
    """The character's own glyph, or that of its capital, or the blank."""
    return GLYPHS.get(c, GLYPHS.get(c.upper(), 0))


def glyph_row(line: str) -> bytes:
    line = line[:COLUMNS]
    return (bytes((COLUMNS - len(line)) // 2) + bytes(map(glyph, line))).ljust(COLUMNS, b"\0")


def cue_records(cues: DataFrame, ident: str, first: float, seconds: float, fps: float = FPS_NUM / FPS_DEN) -> DataFrame:
    """(ident, start, end, lines) -> (ident, n, record): 88 bytes for each cue of the window, n in the order of a text's cues.

    A record has start and end in frames from the window's start (32 bits, the highest byte first) and two centred rows of glyphs.
    """
    inside = cues.where((F.col("end") > first) & (F.col("start") < first + seconds))
    inside = inside.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - first), "end": F.least(F.col("end"), F.lit(first + seconds)) - first})
    trimmed = trim_spans(inside, "start", "end", ident)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = next(wrap(iter([part["lines"].map(" ".join)])))
            record = [round(a * fps).to_bytes(4, "big") + round(b * fps).to_bytes(4, "big") + b"".join(map(glyph_row, r)).ljust(COLUMNS * ROWS, b"\0") for a, b, r in zip(part["start"], part["end"], rows, strict=True)]
            yield pd.DataFrame({ident: part[ident], "n": part["n"], "record": record})

    numbered = trimmed.withColumn("n", F.row_number().over(Window.partitionBy(ident).orderBy("start", "end")) - 1)
    kind = cues.schema[ident].dataType.simpleString()
    return numbered.select(ident, "n", "start", "end", "lines").mapInPandas(encoded, f"{ident} {kind}, n int, record binary")
