"""Spark plumbing shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Arrays from this size on are mapped and go back when they are freed, in place of holes in the worker's heap.
MAPPED_BYTES = 4 << 20


def lean(run: Callable, mapped: bool = True) -> Callable:
    """run for mapInArrow in a worker that gives back what its allocators keep; mapped also keeps large arrays out of its heap.

    Mapping takes up to half more CPU and saves some hundred MB of an executor. It is for the pipeline, whose first
    stages set it: a worker stays mapped for the stages that follow.
    """

    def wrapped(batches):
        library = ctypes.CDLL(None)
        if mapped and hasattr(library, "mallopt"):
            library.mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(library, "malloc_trim"):
                library.malloc_trim(0)

    return wrapped


roomy = partial(lean, mapped=False)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, so that very long texts do not pile up in one."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")):
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001  a setting that this Spark does not know
            if "maxBytes" not in key:
                raise


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir; a temporary one only in a local session."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tesserae-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


#: While it is set, Spark (4.1 on) deletes an action's shuffle files when the action ends, not once the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the reliable checkpoint folder that all executors share; the shuffle files behind it go."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # select: planned while the setting holds
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a compressed table in the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that `stored` wrote."""
    spark = df.sparkSession
    (folder,) = {f.rpartition("/")[0] for f in df.inputFiles()} or {None}
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stars(edges: DataFrame) -> bool:
    """Whether every upper end has one edge and is no lower end: then each lower end is the root of its component."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (u long, v long): one row (node, root) per node, root the smallest node.

    Alternating large-star and small-star rounds, each of which replaces the neighbours of a node by
    its smallest one; minima are taken before the shuffle, so that a node with very many neighbours
    costs one row a task. Null ends and self loops are ignored; an empty table gives no rows.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _stars(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(moved.union(down.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the edges (a, b) in one task: (nodes, smallest node of each one's component)."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return nodes, nodes[root]
        root = new
