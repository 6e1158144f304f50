"""Checks of rows and options, lookups by prefix, tails of short runs, guarded text edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broken_rule(rules: dict[str, Column]) -> Column:
    """Name of the first rule, in the given order, that a row breaks; null where all hold. A rule that is null counts as broken."""
    return F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()), F.lit(None).cast("string"))


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df; an action on it fails at the first row that breaks a rule, with the rule's name."""
    broken = broken_rule(rules)
    return df.where(F.when(broken.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("row breaks rule: "), broken)).cast("boolean")))


def by_prefix(key: Column, costs: dict[str, int], other: int | None = None) -> Column:
    """Cost of the longest entry of `costs` (a small table of the plan) that key starts with, else `other`; null keys give null."""
    if not costs:
        return F.when(key.isNotNull(), F.lit(other).cast("long"))
    found = None
    for prefix in sorted(costs, key=lambda p: (-len(p), p)):
        value = F.lit(costs[prefix]).cast("long")
        found = F.when(key.startswith(prefix), value) if found is None else found.when(key.startswith(prefix), value)
    return F.when(key.isNotNull(), found.otherwise(F.lit(other).cast("long")))


def padded_tail(runs: DataFrame, ident: str, order: str, wanted: str, most: int = 2) -> DataFrame:
    """Runs whose last rows are missing, filled by repeating the last row: adds `place` from 0.

    `wanted` is the number of rows a run should have, the same in all its rows. At most `most` rows are
    filled, a run shorter than that fails; longer runs keep all rows. Only the last row of a run is multiplied.
    """
    w = Window.partitionBy(ident)
    rows = runs.withColumn("place", F.row_number().over(w.orderBy(order)).cast("long") - 1).withColumn("_count", F.count("*").over(w))
    missing = F.col(wanted) - F.col("_count")
    guarded = F.when(missing > most, F.raise_error(F.format_string("%d rows missing", missing)).cast("long")).otherwise(F.greatest(missing, F.lit(0)))
    extra = F.when(F.col("place") == F.col("_count") - 1, guarded).otherwise(F.lit(0))
    return rows.withColumn("_more", F.explode(F.sequence(F.lit(0).cast("long"), extra.cast("long")))).withColumn("place", F.col("place") + F.col("_more")).drop("_count", "_more")


def replaced(text: Column, anchor: str, new: str, strict: bool = True) -> Column:
    """text with `new` in place of the anchor; text without the anchor is an error (null where not strict)."""
    missing = F.raise_error(F.lit(f"no anchor {anchor!r}")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(text.isNull(), None).when(F.contains(text, F.lit(anchor)), F.replace(text, F.lit(anchor), F.lit(new))).otherwise(missing)


def resolve_hold(hold: int, fps: float, clock: float = 15625 / 264) -> int:
    """A hold of frames, refused below 1 or where it drops no picture of the source."""
    if hold < 1:
        raise ValueError(f"a hold of {hold} frames is below 1")
    if hold > 1 and fps > 0 and clock / hold >= fps:
        raise ValueError(f"a hold of {hold} drops nothing of a source of {fps:g} pictures a second")
    return hold


def resolve_duration(start: float, duration: float | None, total: float) -> float:
    """Seconds to read from start: what is left, or the duration where it fits."""
    if start < 0 or start >= total:
        raise ValueError(f"start {start:g} is outside the source of {total:g} seconds")
    if duration is not None and duration <= 0:
        raise ValueError(f"duration {duration:g} is not positive")
    return total - start if duration is None else min(duration, total - start)
