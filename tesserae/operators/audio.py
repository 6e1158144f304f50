"""ADPCM of mono 16-bit tracks: a closed loop for each track, one group a track."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# Step scale by magnitude, step and sample bounds, the silent nibble pair.
STEP_SCALE = (57, 57, 57, 57, 77, 102, 128, 153)
STEP_LEAST, STEP_MOST, LOW, HIGH, SILENT = 127, 24576, -32768, 32767, 0x08


def _land(value: int, step: int, nibble: int) -> int:
    move = (2 * (nibble & 7) + 1) * step // 8
    return max(LOW, min(HIGH, value - move if nibble & 8 else value + move))


def _next_step(step: int, nibble: int) -> int:
    return max(STEP_LEAST, min(STEP_MOST, step * STEP_SCALE[nibble & 7] // 64))


def encode_track(samples: list[int]) -> list[int]:
    """Nibbles whose decoded value comes closest at each sample, the smaller nibble on ties; padded to a pair."""
    value, step, out = 0, STEP_LEAST, []
    for target in samples:
        best = min(range(16), key=lambda n: abs(_land(value, step, n) - max(LOW, min(HIGH, target))))
        value, step = _land(value, step, best), _next_step(step, best)
        out.append(best)
    return out + [SILENT] * (len(out) % 2)


def decode_track(nibbles: list[int]) -> list[int]:
    value, step, out = 0, STEP_LEAST, []
    for n in nibbles:
        value, step = _land(value, step, n), _next_step(step, n)
        out.append(value)
    return out


def adpcm(samples: DataFrame) -> DataFrame:
    """(track, i, v) -> (track, n, payload): nibble pairs, high nibble first, padded to pages of 256 bytes."""

    def code(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        nibbles = encode_track([int(v) for v in rows["v"]])
        body = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
        return pd.DataFrame({"track": [rows["track"].iloc[0]], "n": [len(rows)], "payload": [body + bytes([SILENT]) * (-len(body) % 256)]})

    return samples.groupBy("track").applyInPandas(code, "track long, n long, payload binary")
