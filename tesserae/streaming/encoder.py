"""Change encoding on streams: the state of a slot is the content it last showed.

`encode_stream` works on a static or a streaming DataFrame of (slot, frame, content); on a stream, late
rows of a slot are ordered within a micro-batch, and the state holds one content and counter for a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def encode_stream(rows: DataFrame, interval: int) -> DataFrame:
    """(slot, frame, content, is_key): a snapshot every `interval` rows of a slot, and changes between."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown, count = state.get if state.exists else (None, 0)
        rows_ = pd.concat(list(batches)).sort_values("frame", kind="stable")
        out = []
        for frame, content in zip(rows_["frame"], rows_["content"], strict=True):
            key_row = count % interval == 0
            if key_row or content != shown:
                out.append((key[0], frame, content, key_row))
                shown = content
            count += 1
        state.update((shown, count))
        yield pd.DataFrame(out, columns=["slot", "frame", "content", "is_key"])

    return rows.groupBy("slot").applyInPandasWithState(step, "slot long, frame long, content string, is_key boolean", "shown string, count long", "append", GroupStateTimeout.NoTimeout)
