"""Decoded frames: files of raw pixels, frame after frame, as a batch or a streaming source.

A file is cut in partitions of `chunk_frames` frames, which readers seek to, so neither the driver nor a
task holds a clip. A last frame that is cut short is not read: a batch ends before it, a stream waits
until the rest of it is written. An empty file has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Fixed value: missing frames at a clip's end that are filled.
MOST_FILLED = 2


class Chunk(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class Clip:
    """A file of frames of one size, at a path or address that every executor can open."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options["width"]) * int(options["height"]) * int(options.get("channels", 3))
        self.chunk = int(options.get("chunk_frames", 64))
        if min(self.size, self.chunk) <= 0:
            raise ValueError("width, height, channels and chunk_frames must be positive")

    def count(self) -> int:
        """Frames that are there in full."""
        place, path = fs.FileSystem.from_uri(self.path)
        found = place.get_file_info(path)
        if not found.is_file:
            raise FileNotFoundError(self.path)
        return found.size // self.size

    def chunks(self, first: int, stop: int) -> list[Chunk]:
        return [Chunk(at, min(at + self.chunk, stop)) for at in range(first, stop, self.chunk)] or [Chunk(first, first)]

    def frames(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        place, path = fs.FileSystem.from_uri(self.path)
        with place.open_input_file(path) as file:
            file.seek(chunk.first * self.size)
            for frame in range(chunk.first, chunk.stop):
                pixels = file.read(self.size)
                if len(pixels) < self.size:
                    raise EOFError(f"{self.path} ends within frame {frame}")
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int64()), pa.array([pixels], pa.binary())], ["frame", "pixels"])


class BatchReader(DataSourceReader):
    def __init__(self, clip: Clip):
        self.clip = clip

    def partitions(self) -> list[Chunk]:
        return self.clip.chunks(0, self.clip.count())

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        return self.clip.frames(chunk)


class StreamReader(DataSourceStreamReader):
    """An offset is a number of frames; what is written to the file later comes with a later batch."""

    def __init__(self, clip: Clip):
        self.clip = clip

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        return {"frame": self.clip.count()}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        return self.clip.chunks(start["frame"], end["frame"])

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        return self.clip.frames(chunk)


class RawFrames(DataSource):
    """Options: path, width, height, channels (3), chunk_frames (64)."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return "frame long, pixels binary"

    def reader(self, schema) -> BatchReader:
        return BatchReader(Clip(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Clip(self.options))


def decoded(spark: SparkSession, path: str, width: int, height: int, wanted: int | None = None, stream: bool = False, chunk_frames: int = 64) -> DataFrame:
    """(frame, pixels) of a raw RGB file; a batch of `wanted` frames repeats the last one for at most two that lack, or raises."""
    spark.dataSource.register(RawFrames)
    options = {"path": path, "width": str(width), "height": str(height), "chunk_frames": str(chunk_frames)}
    found = (spark.readStream if stream else spark.read).format("raw_frames").options(**options).load()
    if wanted is None:
        return found
    if stream:
        raise ValueError("a stream has no wanted number of frames")
    have = Clip(options).count()
    if wanted - have > MOST_FILLED or wanted > have == 0:
        raise ValueError(f"{wanted - have} frames missing")
    # The number of frames is known, so the last one is multiplied in its place and nothing is moved.
    last = F.sequence(F.col("frame"), F.lit(max(wanted, have) - 1).cast("long"))
    kept = found.where(F.col("frame") < min(wanted, have))
    return kept.withColumn("frame", F.explode(F.when(F.col("frame") == have - 1, last).otherwise(F.array("frame"))))
