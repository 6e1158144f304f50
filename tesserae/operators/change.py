"""Change capture over keyed, ordered rows: predicates, holds, keyframes, deltas, replay, dictionaries, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def changed(df: DataFrame, slot: str, order: str, content: str, name: str = "changed") -> DataFrame:
    """Whether the content differs from the slot's row before; the first row has changed."""
    w = Window.partitionBy(slot).orderBy(order)
    return df.withColumn(name, (F.row_number().over(w) == 1) | ~F.col(content).eqNullSafe(F.lag(content).over(w)))


def hold(df: DataFrame, slot: str, frame: str, content: str, every: int, name: str = "held") -> DataFrame:
    """Content of the first frame of each run of `every` frames (0 counts as 1)."""
    every = max(1, every)
    w = Window.partitionBy(slot, F.floor(F.col(frame) / every)).orderBy(frame)
    return df.withColumn(name, F.first(content).over(w))


def deltas(df: DataFrame, slot: str, order: str, content: str, keyframe: Column) -> DataFrame:
    """Snapshot plus delta: rows at keyframes, and rows whose content changed."""
    return changed(df, slot, order, content).withColumn("is_key", keyframe).where(F.col("is_key") | F.col("changed")).drop("changed")


def replay(log: DataFrame, slot: str, order: str, upto: int, *values: str) -> DataFrame:
    """The latest values of each slot up to a frame."""
    return log.where(F.col(order) <= upto).groupBy(slot).agg(F.max(F.col(order)).alias("at"), *(F.max_by(v, order).alias(v) for v in values))


def backlog(df: DataFrame, slot: str, order: str, content: str, shown: Column) -> DataFrame:
    """Changes that were not shown and wait: rows after the slot's last shown row, whose content differs from it."""
    w = Window.partitionBy(slot).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_shown", F.last(F.when(shown, F.struct(content)), ignorenulls=True).over(w))
    return marked.withColumn("pending", ~F.col(content).eqNullSafe(F.col(f"_shown.{content}"))).drop("_shown")


def intern(df: DataFrame, content: str, order: str, *scope: str) -> DataFrame:
    """df with `tile_index`, a dense key of each distinct content by first appearance (of scope and content, with scopes).

    Contents are compared by 128 bits of two hashes; orders must be unique.
    """
    keyed = df.withColumn("_a", F.xxhash64(*scope, content)).withColumn("_b", F.md5(F.coalesce(F.col(content).cast("string"), F.lit("\0"))))
    first = keyed.groupBy("_a", "_b").agg(F.min(order).alias("_first"))
    return keyed.join(numbered(first, "_first", "tile_index"), ["_a", "_b"]).drop("_a", "_b", "_first")


def intern_capped(df: DataFrame, content: str, order: str, capacity: int) -> DataFrame:
    """As intern; contents that come after `capacity` distinct ones have a null key."""
    return intern(df, content, order).withColumn("tile_index", F.when(F.col("tile_index") < capacity, F.col("tile_index")))


def intern_mirrors(df: DataFrame, content: str, order: str) -> DataFrame:
    """As intern over arrays, where an array and its reverse are one entry: `tile_index`, `flipped` against the first seen."""
    key = F.least(F.concat_ws(",", content), F.concat_ws(",", F.reverse(content)))
    found = intern(df.withColumn("_key", key), "_key", order)
    first = found.groupBy("tile_index").agg(F.min_by(F.concat_ws(",", content), order).alias("_base"))
    return found.join(first, "tile_index").withColumn("flipped", F.concat_ws(",", content) != F.col("_base")).drop("_base", "_key")


def runs(df: DataFrame, group: list[str], position: str, *values: str) -> DataFrame:
    """Runs of consecutive positions: group, start, n, and the values in order."""
    w = Window.partitionBy(*group).orderBy(position)
    island = df.withColumn("_run", F.col(position) - F.row_number().over(w))
    cells = F.transform(F.array_sort(F.collect_list(F.struct(position, *values))), lambda x: F.struct(*(x[v].alias(v) for v in values)))
    return island.groupBy(*group, "_run").agg(F.min(position).alias("start"), F.count("*").alias("n"), cells.alias("cells")).drop("_run")


def trim_spans(df: DataFrame, start: str, end: str, scope: str | None = None) -> DataFrame:
    """Spans cut where the next one starts, empty ones left out."""
    w = Window.partitionBy(*([scope] if scope else [F.lit(0)])).orderBy(start, end)
    return df.withColumn(end, F.least(F.col(end), F.lead(start).over(w))).where(F.col(end) > F.col(start))


def keyframes(df: DataFrame, scope: str, frame: str, cut: Column, interval: int) -> DataFrame:
    """Keyframes at cuts and `interval` frames after the last keyframe, in each scope.

    Between cuts the interval restarts at the cut, so a frame's distance to its last cut says all.
    """
    w = Window.partitionBy(scope).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    ordered = df.withColumn("_n", F.row_number().over(Window.partitionBy(scope).orderBy(frame)))
    since = F.col("_n") - F.last(F.when(cut | (F.col("_n") == 1), F.col("_n")), ignorenulls=True).over(w)
    return ordered.withColumn("is_key", since % interval == 0).withColumn("group", F.sum(F.col("is_key").cast("long")).over(w)).drop("_n")


def tie_run(df: DataFrame, scope: str, position: str, error: str, eps: float = 1e-9) -> DataFrame:
    """The contiguous positions around the best whose error is within eps of it."""
    w = Window.partitionBy(scope)
    best = df.withColumn("_least", F.min(error).over(w)).withColumn("_best", F.min_by(position, F.struct(error, position)).over(w))
    tied = best.withColumn("_tied", F.col(error) - F.col("_least") <= eps)
    island = tied.withColumn("_run", F.sum((~F.col("_tied")).cast("long")).over(Window.partitionBy(scope).orderBy(position)))
    home = island.withColumn("_home", F.max(F.when(F.col(position) == F.col("_best"), F.col("_run"))).over(w))
    return home.where(F.col("_tied") & (F.col("_run") == F.col("_home"))).select(*df.columns)


def epoch_slots(counts: DataFrame, epoch: str, value: str, weight: str, base: int, capacity: int) -> DataFrame:
    """Slots of each epoch's heaviest values, ties to the smaller value: (epoch, value, weight, slot).

    One epoch takes the whole capacity from `base`; of several, each takes half, and neighbours
    alternate between the halves, so that a set can be loaded while the one before it shows.
    """
    several = counts.agg((F.countDistinct(epoch) > 1).alias("_several"))  # one row
    place = F.row_number().over(Window.partitionBy(epoch).orderBy(F.desc(weight), F.asc(value))).cast("long") - 1
    rows = counts.withColumn("_place", place).where(F.col("_place") < capacity).join(F.broadcast(several))
    half = capacity // 2
    slot = F.col("_place") + base + F.when(F.col("_several"), F.col(epoch) % 2 * half).otherwise(F.lit(0))
    return rows.where(~F.col("_several") | (F.col("_place") < half)).select(epoch, value, weight, slot.alias("slot"))


def scene_cuts(cells: DataFrame, frame: str, slot: str, moved: str, floor: float, ratio: float) -> DataFrame:
    """(frame, share, cut): the share of all slots that moved further than floor; a cut from ratio on, and at the first frame."""
    every = cells.agg(F.countDistinct(slot).alias("_slots"), F.min(frame).alias("_first"))  # one row
    share = cells.groupBy(frame).agg(F.count_if(F.col(moved) > floor).alias("_n")).join(F.broadcast(every))
    moved_share = F.col("_n") / F.col("_slots")
    return share.select(frame, moved_share.alias("share"), ((F.col(frame) == F.col("_first")) | (moved_share >= ratio)).alias("cut"))


def short_gaps(df: DataFrame, scope: str, order: str, marked: Column, floor: int) -> DataFrame:
    """Marked rows whose next row in the scope comes less than floor after them, with that gap."""
    nearby = F.lead(order).over(Window.partitionBy(scope).orderBy(order)) - F.col(order)
    return df.withColumn("gap", nearby).where(marked & (F.col("gap") < floor))
