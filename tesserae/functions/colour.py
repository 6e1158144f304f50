"""A 15-bit colour domain (5 bits a channel) as column expressions: level tables, packing, perceptual metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ladder resistors in ohms from the low bit, smoothing weight and divisor.
LADDER_OHMS = (3900.0, 2200.0, 1000.0, 470.0, 220.0)
SMOOTHING, DIVISOR = 1.6, 4.2
# The published Oklab matrices (linear RGB to cone response, cone response to L, a, b).
TO_CONE = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def level_table() -> list[int]:
    """8-bit value of each 5-bit level: a resistor divider, smoothed over three levels, scaled to 0..255."""
    volts = []
    for level in range(32):
        up = sum(1 / r for i, r in enumerate(LADDER_OHMS) if level >> i & 1)
        down = sum(1 / r for i, r in enumerate(LADDER_OHMS) if not level >> i & 1)
        volts.append(up / (up + down))
    soft = [volts[0], *((volts[i - 1] * SMOOTHING + volts[i] + volts[i + 1] * SMOOTHING) / DIVISOR for i in range(1, 31)), volts[31]]
    return [int((v - soft[0]) / (soft[-1] - soft[0]) * 255.0 + 0.5) for v in soft]


def nearest_levels() -> list[int]:
    """The level nearest to each 8-bit value, the lower one on ties."""
    table = level_table()
    return [min(range(32), key=lambda k: (abs(v - table[k]), k)) for v in range(256)]


def _lookup(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), at.cast("int") + 1)


def channel(index: Column, which: str) -> Column:
    """5-bit r, g or b of a colour index."""
    return F.shiftright(index, {"r": 10, "g": 5, "b": 0}[which]).bitwiseAND(31)


def pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 10).bitwiseOR(F.shiftleft(g, 5)).bitwiseOR(b)


def index_of_rgb(r: Column, g: Column, b: Column) -> Column:
    """Colour index of 8-bit channels: the nearest level of each."""
    table = nearest_levels()
    return pack(*(_lookup(table, c) for c in (r, g, b)))


def to_8bit(level: Column) -> Column:
    return _lookup(level_table(), level)


def palette_word(index: Column, dark: Column | None = None) -> Column:
    """Hardware word: dark bit 15, low bits of r, g, b in 14..12, their high four bits in 11..0."""
    r, g, b = (channel(index, c) for c in "rgb")
    low = F.shiftleft(r.bitwiseAND(1), 14).bitwiseOR(F.shiftleft(g.bitwiseAND(1), 13)).bitwiseOR(F.shiftleft(b.bitwiseAND(1), 12))
    high = F.shiftleft(F.shiftright(r, 1), 8).bitwiseOR(F.shiftleft(F.shiftright(g, 1), 4)).bitwiseOR(F.shiftright(b, 1))
    word = low.bitwiseOR(high)
    return word if dark is None else word.bitwiseOR(F.shiftleft(dark, 15))


def oklab(r: Column, g: Column, b: Column, weight: float = 1.0) -> tuple[Column, Column, Column]:
    """Oklab of 8-bit sRGB, chroma axes times the root of weight."""
    if weight <= 0:
        raise ValueError("the chroma weight must be above 0")
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, 2.4)) for c in (r, g, b)]
    cone = [F.cbrt(sum((F.lit(m) * x for m, x in zip(row, linear, strict=True)), F.lit(0.0))) for row in TO_CONE]
    light, a, bb = (sum((F.lit(m) * x for m, x in zip(row, cone, strict=True)), F.lit(0.0)) for row in TO_LAB)
    return light, a * weight**0.5, bb * weight**0.5


def colour_grid(spark: SparkSession, weight: float = 1.0) -> DataFrame:
    """All 32,768 colours (fixed size): color, r, g, b (8 bits), L, a, bb."""
    c = F.col("color")
    base = spark.range(32768).select(F.col("id").cast("int").alias("color"))
    base = base.select("color", *(to_8bit(channel(c, x)).alias(x) for x in "rgb"))
    light, a, bb = oklab(F.col("r"), F.col("g"), F.col("b"), weight)
    return base.select("color", "r", "g", "b", light.alias("L"), a.alias("a"), bb.alias("bb"))
