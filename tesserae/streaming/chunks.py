"""Files read as a stream in bounded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def chunked(spark: SparkSession, path: str, schema: StructType | str, files: int = 64, kind: str = "parquet") -> DataFrame:
    """A stream over the files under path, at most `files` of them in each micro-batch; memory does not grow with their number."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)
