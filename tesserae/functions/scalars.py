"""Column expressions for clocks, geometry, addresses, rates, capacity and text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frame clock as a fraction of Hz, the audio chip's base rate, page and capacity sizes.
FPS_NUM, FPS_DEN = 15625, 264
CHIP_NUM, CHIP_DEN, UNITY, MAX_DELTA = 8_000_000, 144, 65536, 65535
PAGE_BYTES, MAX_PAGES, CAPACITY, MARGIN = 256, 65536, 1 << 20, 0.92


def whole(c: Column) -> Column:
    return c.cast("long")


def frame_count(seconds: Column) -> Column:
    """Whole frames in a time, cut off."""
    return whole(F.floor(seconds * FPS_NUM / FPS_DEN))


def hold_for(fps: Column) -> Column:
    """Frames to hold each picture for a wanted rate, half to even, at least 1; 1 for a rate of 0."""
    return F.greatest(F.lit(1), whole(F.bround(F.try_divide(F.lit(FPS_NUM / FPS_DEN), fps))))


def kept_share(hold: Column, fps: Column) -> Column:
    return F.least(F.lit(1.0), F.try_divide(F.try_divide(F.lit(FPS_NUM / FPS_DEN), hold), fps))


def even(c: Column) -> Column:
    return c - F.pmod(c, F.lit(2))


def geometry(width: Column, height: Column, target: tuple[int, int] = (320, 224), pixel_aspect: float = 14 / 15, tile: int = 16, fit: str = "fill") -> Column:
    """Crop, image and pad that bring a source onto a raster of non-square pixels: struct(crop_w, crop_h, image_h, pad_top)."""
    wide, high = target
    aspect = width / height
    if fit == "fill":
        want = F.lit(wide / high * pixel_aspect)
        crop_w = F.when(aspect > want, even(whole(F.bround(height * want)))).otherwise(even(width))
        crop_h = F.when(aspect > want, even(height)).otherwise(even(whole(F.bround(width / want))))
        return F.struct(crop_w.alias("crop_w"), crop_h.alias("crop_h"), F.lit(high).alias("image_h"), F.lit(0).alias("pad_top"))
    if fit != "letterbox":
        raise ValueError(f"unknown fit {fit!r}")
    rows = high // tile
    ideal = F.lit(wide * pixel_aspect) / aspect / tile
    fitting = F.filter(F.array(*(F.lit(k) for k in range(1, rows + 1) if (rows - k) % 2 == 0)), lambda k: k <= ideal + 1e-6)
    image = F.coalesce(F.array_max(fitting), F.lit(rows)) * tile
    return F.struct(even(width).alias("crop_w"), even(height).alias("crop_h"), image.alias("image_h"), ((F.lit(high) - image) / 2).cast("int").alias("pad_top"))


def filter_chain(*steps: Column) -> Column:
    """The given steps in order, nulls left out, joined by commas."""
    return F.concat_ws(",", *steps)


def slot_address(col: Column, row: Column) -> Column:
    return (col + 1) * 64 + row * 2


def attribute_word(palette: Column, tile: Column, hflip: Column, vflip: Column) -> Column:
    """Palette in the high byte, tile bits 19..16 in bits 7..4, flips in bits 1 and 0."""
    return F.shiftleft(palette, 8).bitwiseOR(F.shiftleft(F.shiftright(tile, 16).bitwiseAND(15), 4)).bitwiseOR(F.shiftleft(vflip.cast("long"), 1)).bitwiseOR(hflip.cast("long"))


def attribute_fields(word: Column, low: Column) -> Column:
    """The inverse: struct(palette, tile, hflip, vflip) of an attribute word and a tile's low 16 bits."""
    return F.struct(
        F.shiftright(word, 8).alias("palette"),
        F.shiftleft(F.shiftright(word, 4).bitwiseAND(15), 16).bitwiseOR(low).alias("tile"),
        (word.bitwiseAND(1) == 1).alias("hflip"),
        (F.shiftright(word, 1).bitwiseAND(1) == 1).alias("vflip"),
    )


def bayer(row: Column, col: Column) -> Column:
    """Threshold of an ordered 8 x 8 dither matrix, the middle of its step in [0, 1): bits of row xor col and row, interleaved from the low end."""
    x, y = col.bitwiseAND(7).bitwiseXOR(row.bitwiseAND(7)), row.bitwiseAND(7)
    bits = [F.shiftleft(F.shiftright(v, k).bitwiseAND(1), 2 * (2 - k) + odd) for k in range(3) for v, odd in ((x, 1), (y, 0))]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return (total + 0.5) / 64.0


def timecode(text: Column) -> Column:
    """Seconds of hh:mm:ss,mmm; milliseconds padded on the right."""
    part = lambda k: F.regexp_extract(text, r"(\d{2}):(\d{2}):(\d{2})[,.](\d{1,3})", k)
    return part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int") + F.rpad(part(4), 3, "0").cast("int") / 1000.0


def clock(minutes: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    total = whole(F.bround(minutes * 60))
    rest = total % 3600
    return F.when(total >= 3600, F.format_string("%d:%02d:%02d", whole(total / 3600), whole(rest / 60), rest % 60)).when(total.isNotNull(), F.format_string("%d:%02d", whole(rest / 60), rest % 60))


def seconds_to_frames(seconds: Column, num: int = FPS_NUM, den: int = FPS_DEN) -> Column:
    return F.lit(0).cast("long") if den == 0 else F.expr("0") if num == 0 else whole(F.floor(seconds * num / den))


def audio_page(frame: Column, num: int, den: int) -> Column:
    """Page of a frame at num/den pages a frame, rounded, in 16 bits."""
    return F.lit(0).cast("long") if den == 0 else whole(F.floor((frame * num + den // 2) / den)).bitwiseAND(65535)


def bar_fill(frame: Column, total: Column, span: int) -> Column:
    return F.when(total <= 0, 0).when(frame >= total, span).otherwise(whole(F.floor(frame * span / total)))


def clamp_frame(frame: Column, count: Column) -> Column:
    return F.when(count <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(frame, count - 1)))


def delta_n(rate: Column) -> Column:
    """Rate register for a sample rate, half to even."""
    return F.least(F.lit(MAX_DELTA).cast("long"), whole(F.bround(rate * UNITY * CHIP_DEN / CHIP_NUM)))


def rate_below(rate: Column) -> Column:
    step = F.least(F.lit(MAX_DELTA).cast("long"), F.greatest(F.lit(1).cast("long"), whole(F.floor(rate * UNITY * CHIP_DEN / CHIP_NUM))))
    return step * (CHIP_NUM / CHIP_DEN / UNITY)


def audio_rate_for(minutes: Column, most: float = CHIP_NUM / CHIP_DEN * MAX_DELTA / UNITY) -> Column:
    """Highest sample rate whose pages a 16-bit counter can name."""
    affordable = F.lit((MAX_PAGES - 1) * PAGE_BYTES) / (minutes * 60 * 0.5)
    return F.when(minutes <= 0, most).when(affordable >= most, most).otherwise(rate_below(affordable))


def epoch_seconds(cuts: Column, least: float = 2.5, most: float = 8.0) -> Column:
    return F.when(cuts <= 0, most).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), 60.0 / cuts)))


def power_of_two(size: Column) -> Column:
    """The least power of two that holds size, 2**20 at least."""
    return F.greatest(F.lit(CAPACITY).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(size - 1, F.lit(0))))))


def most_minutes(rate: Column) -> Column:
    return F.when(rate > 0, CAPACITY / rate)


def fits(minutes: Column, capacity: Column) -> Column:
    return minutes <= capacity * MARGIN


def trim_minutes(minutes: Column, capacity: Column) -> Column:
    """Runtime over the margin, rounded up to a second."""
    over = minutes - capacity * MARGIN
    return F.when(over <= 0, 0.0).otherwise(F.ceil(over * 60) / 60)


def strip_markup(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"<[^>]+>|\{[^}]*\}", ""))


def centred(line: Column, columns: int = 40) -> Column:
    cut = F.substring(line, 1, columns)
    return F.rpad(F.concat(F.repeat(F.lit(" "), whole(F.floor((F.lit(columns) - F.length(cut)) / 2)).cast("int")), cut), columns, " ")


def content_key(head: Column, size: Column, params: Column, version: int = 1) -> Column:
    """Key of a content and its parameters: sha256 over version, content digest and parameters."""
    return F.sha2(F.concat_ws(":", F.lit(version), F.sha2(F.concat(size.cast("string"), head), 256), params), 256)


def planes(nibbles: Column, plane: int) -> Column:
    """One bit plane of an array of 4-bit values, the first value in the lowest bit."""
    return F.aggregate(F.transform(nibbles, lambda v, i: F.call_function("shiftleft", F.shiftright(v, plane).bitwiseAND(1).cast("long"), i.cast("int"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def rendered(nibbles: Column, colours: Column) -> Column:
    """Colours of 4-bit values that count a palette's colours from 1; null for others."""
    return F.transform(nibbles, lambda n: F.when(n.between(1, F.size(colours)), F.get(colours, n.cast("int") - 1)))


def reachable(hold: Column, fps: Column) -> Column:
    """Whether a hold drops frames of a source: none does at 1, others only below the source's rate."""
    return (hold <= 1) | (F.lit(FPS_NUM / FPS_DEN) / hold < fps)


def rung_label(hold: Column, chroma: Column) -> Column:
    """What a rung shows, in words."""
    shown = F.when(hold == 1, F.lit("every frame")).otherwise(F.format_string("%.0f fps", F.lit(FPS_NUM / FPS_DEN) / hold))
    return F.concat(shown, F.lit(", colour at "), F.bround(chroma * 100).cast("int").cast("string"), F.lit("%"))


def pages_per_frame(delta: Column) -> Column:
    """Pages that a rate register advances a frame, as a reduced fraction: struct(pages, frames); 0/1 for a register of 0 or less.

    Two samples share a byte. The constant part is reduced here, so a row's divisor is one of the few of its denominator.
    """
    up, down = CHIP_NUM * FPS_DEN, CHIP_DEN * UNITY * 2 * PAGE_BYTES * FPS_NUM
    up, down = up // math.gcd(up, down), down // math.gcd(up, down)
    divisors = F.array(*(F.lit(n).cast("long") for n in range(1, down + 1) if down % n == 0))
    common = F.array_max(F.filter(divisors, lambda n: (delta * up) % n == 0))
    known = delta > 0
    return F.struct(F.when(known, whole(delta * up / common)).otherwise(F.lit(0).cast("long")).alias("pages"), F.when(known, whole(F.lit(down) / common)).otherwise(F.lit(1).cast("long")).alias("frames"))


def audio_grade(hz: Column, steps: int = 35, most: float = 55555.0, least: float = 8000.0) -> Column:
    """Where a sample rate stands on a ladder of equal ratios, 1 for the most."""
    place = F.bround(F.log(F.lit(most) / F.greatest(hz, F.lit(least))) * (steps - 1) / math.log(most / least))
    return F.when(hz >= most, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(steps), (place + 1).cast("int"))))
