"""Sources and sinks: subtitle text, metadata prints, keyed JSON readings, big-endian blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip_markup, timecode

TIMING = r"\d{2}:\d{2}:\d{2}[,.]\d{1,3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{1,3}"


def cues(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """SubRip texts -> (ident, cue, start, end, lines); blocks without timing or words are left out."""
    block = texts.select(ident, F.posexplode(F.split(F.trim(text), r"\n\s*\n")).alias("cue", "block"))
    timing = block.withColumn("timing", F.regexp_extract("block", TIMING, 0)).where("timing <> ''")
    body = F.expr("substring(block, instr(block, timing) + length(timing))")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), strip_markup), lambda x: x != "")
    ends = F.split("timing", r"\s*-->\s*")
    # A filter on times may run before that on timing.
    at = lambda k: F.when(F.col("timing") != "", timecode(F.get(ends, F.lit(k))))
    return timing.select(ident, "cue", at(0).alias("start"), at(1).alias("end"), lines.alias("lines")).where(F.size("lines") > 0)


def printed_values(text: Column, suffix: str) -> Column:
    """Numbers of `key=value` prints whose key ends with suffix."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\S*{suffix}=(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def readings(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Stored readings (key, tier, rate) of one version; broken lines and other versions are empty."""
    rows = spark.read.schema("version int, key string, tier string, rate double").option("mode", "DROPMALFORMED").json(path)
    return rows.where((F.col("version") == version) & F.col("key").isNotNull()).select("key", "tier", "rate")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new put in place of those of equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def big_endian(value: Column, size: int) -> Column:
    """An unsigned integer as `size` bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def from_big_endian(blob: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(blob, at + 1, size)), 16, 10).cast("long")


def even_blob(blob: Column) -> Column:
    """blob with a zero byte after an odd length."""
    return F.when(F.octet_length(blob) % 2 == 1, F.concat(blob, F.unhex(F.lit("00")))).otherwise(blob)


def write_blobs(parts: DataFrame, name: str, blob: str, path: str) -> None:
    """Named blobs, padded to even lengths, as a table under path; each task writes its own."""
    parts.select(F.col(name).alias("name"), even_blob(F.col(blob)).alias("blob")).write.mode("overwrite").parquet(path)


# Where each pair of pixel columns starts in a packed 8 x 8 tile.
COLUMN_PAIRS = (16, 24, 0, 8)


def glyph_tile(nibbles: Column) -> Column:
    """64 values of 4 bits, row by row, as a tile of 32 bytes: column pairs one after another, the left pixel in the low half."""
    pair = lambda at: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.concat(*(F.hex(F.element_at(nibbles, y * 8 + k).cast("long").bitwiseAND(15)) for k in (at + 2, at + 1))))
    ordered = sorted(range(4), key=COLUMN_PAIRS.__getitem__)
    return F.when(F.size(nibbles) == 64, F.unhex(F.concat_ws("", *(pair(2 * p) for p in ordered))))


def _bytes(values: Column) -> Column:
    """An array of values from 0 to 255 as binary."""
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def palette_blob(colours: Column) -> Column:
    """Up to 15 colours as 16 big-endian words; the first word, and those without a colour, are 0."""
    return F.unhex(F.rpad(F.concat(F.lit("0000"), F.array_join(F.transform(colours, lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")), "")), 64, "0"))


def filled_rom(blob: Column, page: int, most: int = 16 << 20, fill: str = "08") -> Column:
    """blob filled to whole pages; an error beyond `most` bytes."""
    size = F.octet_length(blob)
    short = F.pmod(-size, F.lit(page))
    filled = F.concat(blob, F.unhex(F.repeat(F.lit(fill), short)))
    return F.when(size <= most, filled).otherwise(F.raise_error(F.concat(F.lit("a sample of "), size.cast("string"), F.lit(f" bytes is beyond {most}"))).cast("binary"))


def packed_tile(px: Column) -> Column:
    """256 values of 4 bits, row by row, in two halves of 64 bytes: struct(c1, c2).

    A half holds two planes, interleaved by row; its first 32 bytes are the right eight columns. The leftmost pixel is the lowest bit.
    """
    k = F.sequence(F.lit(0), F.lit(7))

    def half(plane: int) -> Column:
        def one(j: Column) -> Column:
            first = F.floor(j % 32 / 2).cast("int") * 16 + F.when(j < 32, 8).otherwise(0)
            bit = lambda a, i: a + F.call_function("shiftleft", F.call_function("shiftright", F.get(px, first + i).cast("int"), (j % 2 + plane).cast("int")).bitwiseAND(1), i)
            return F.aggregate(k, F.lit(0), bit)

        return _bytes(F.transform(F.sequence(F.lit(0), F.lit(63)), one))

    return F.struct(half(0).alias("c1"), half(2).alias("c2"))


def unpacked_tile(c1: Column, c2: Column) -> Column:
    """The 256 values of a packed tile."""

    def pixel(n: Column) -> Column:
        row, col = F.floor(n / 16).cast("int"), n % 16
        first = row * 2 + F.when(col >= 8, 0).otherwise(32)
        bits = [F.shiftleft(F.call_function("shiftright", from_big_endian(c, first + odd, 1).cast("int"), (col % 8).cast("int")).bitwiseAND(1), plane + odd) for c, plane in ((c1, 0), (c2, 2)) for odd in (0, 1)]
        return (bits[0] + bits[1] + bits[2] + bits[3]).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(255)), pixel)


def flipped_tile(px: Column, across: bool, down: bool, side: int = 16) -> Column:
    """The values of a square tile as they are fetched with flips."""
    turn = (side - 1 if across else 0) + (side * (side - 1) if down else 0)
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda n: F.get(px, n.bitwiseXOR(F.lit(turn))))
