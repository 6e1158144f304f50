"""Cost against error: frontiers, dominance, statistics, nearest matches, interpolation, selection."""

from __future__ import annotations

import json
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frontier(points: DataFrame, cost: str, error: str) -> DataFrame:
    """Points that no other beats on cost and error, one for each cost: a running minimum over distinct costs.

    Points are first reduced to the least error of each cost, so what is ordered is one row a cost.
    """
    least = points.groupBy(cost).agg(F.min(error).alias(error))
    before = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    return least.withColumn("_best", F.min(error).over(before)).where(F.col("_best").isNull() | (F.col(error) < F.col("_best"))).drop("_best")


def dominated(points: DataFrame, cost: str, error: str) -> DataFrame:
    """Points for which another is no worse in both and better in one: those off the frontier's stairs."""
    stairs = points.groupBy(cost).agg(F.min(error).alias("_least"))
    upto = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    stairs = stairs.withColumn("_before", F.min("_least").over(upto))
    found = points.join(stairs, cost)
    return found.where((F.col("_before") <= F.col(error)) | (F.col("_least") < F.col(error))).drop("_least", "_before")


def inversions(points: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose value is above that of the row before."""
    w = Window.orderBy(order)  # ladders have tens of rows
    return points.withColumn("_before", F.lag(value).over(w)).where(F.col(value) > F.col("_before")).drop("_before")


def choose(points: list[tuple[float, float]], count: int) -> list[tuple[float, float]]:
    """Up to count points, dearest first, spread evenly over the logarithm of cost; each target takes the nearest one left.

    points come dearest first. A target's place is found by bisection; from there the nearest free points on
    both sides are reached over links past those that are taken.
    """
    n = len(points)
    if n <= count:
        return list(points)
    depth = [-math.log(cost) for cost, _ in points]
    ahead, back = list(range(n + 1)), list(range(n + 1))  # the next free place from i on; one past the last free place before i

    def free(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = i = links[links[i]]
        return i

    picked = []
    for k in range(count):
        target = depth[0] + (depth[-1] - depth[0]) * k / (count - 1) if count > 1 else depth[0]
        middle = bisect_left(depth, target)
        sides = [i for i in (free(back, middle) - 1, free(ahead, middle)) if 0 <= i < n]
        best = min(sides, key=lambda i: (abs(depth[i] - target), i))
        picked.append(best)
        ahead[best], back[best + 1] = best + 1, best
    return [points[i] for i in sorted(picked)]


def codebook(centres: DataFrame, centre: str, vector: str, most_centres: int = 4096) -> Column:
    """A palette or codebook as a literal array of (centre, vector); its size is checked before it comes to the driver."""
    rows = centres.select(centre, vector).limit(most_centres + 1).collect()
    if len(rows) > most_centres:
        raise ValueError(f"more than {most_centres} centres; deal them in blocks")
    kind = f"array<struct<{centre}: {centres.schema[centre].dataType.simpleString()}, vector: array<double>>>"
    text = json.dumps([{centre: r[0], "vector": r[1]} for r in sorted(rows)])
    return F.from_json(F.lit(text), kind)


def shortlist(vector: Column, book: Column, count: int) -> Column:
    """The count nearest entries of a codebook as (distance, centre), ties to the smaller centre; no rows are joined."""
    distance = lambda c: F.aggregate(F.zip_with(vector, c["vector"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.slice(F.array_sort(F.transform(book, lambda c: F.struct(distance(c).alias("distance"), c["centre"].alias("centre")))), 1, count)


def nearest(points: DataFrame, ident: str, vector: str, centres: DataFrame, centre: str, centre_vector: str, most_centres: int = 4096) -> DataFrame:
    """points with the nearest centre and the squared distance, ties to the smaller centre."""
    book = codebook(centres.withColumnRenamed(centre, "centre"), "centre", centre_vector, most_centres)
    best = points.select(ident, F.get(shortlist(F.col(vector), book, 1), 0).alias("_best"))
    return best.select(ident, F.col("_best.centre").alias(centre), "_best.distance")


# Fixed value: steps of a blend's share.
MIX_SCALE = 255


def two_nearest(value: Column, palette: list[float]) -> Column:
    """The two nearest entries of a palette of numbers and the second one's share in steps of 1/255: struct(nearest, runner, share)."""
    pair = F.array_sort(F.array(*(F.struct(F.abs(value - p).alias("gap"), F.lit(i).alias("i")) for i, p in enumerate(palette))))
    near, far = pair[0], pair[1]
    total = near["gap"] + far["gap"]
    share = F.when(total > 0, F.bround(near["gap"] * MIX_SCALE / total)).otherwise(F.lit(0.0)).cast("int")
    return F.struct(near["i"].alias("nearest"), far["i"].alias("runner"), share.alias("share"))


def best_match(scored: DataFrame, scope: str, position: str, error: str, most_error: float, least_margin: float, eps: float = 1e-9) -> DataFrame:
    """(scope, best, error, rival, margin, accepted) for each scope's positions.

    The rival is the least error outside the run of tied positions around the best. Every step is an
    aggregate, so no scope is brought into one task. Without a rival the margin is null and does not count.
    """
    keys = scored.groupBy(scope).agg(F.min(F.struct(error, position)).alias("_b")).select(scope, F.col(f"_b.{position}").alias("best"), F.col(f"_b.{error}").alias("_least"))
    tied = scored.join(keys, scope)
    off = F.col(error) - F.col("_least") > eps
    edges = tied.groupBy(scope).agg(F.max(F.when(off & (F.col(position) < F.col("best")), F.col(position))).alias("_low"), F.min(F.when(off & (F.col(position) > F.col("best")), F.col(position))).alias("_high"))
    outside = tied.join(edges, scope).where((F.col(position) <= F.col("_low")) | (F.col(position) >= F.col("_high")))
    rivals = outside.groupBy(scope).agg(F.min(F.struct(error, position)).alias("_r"))
    margin = F.col(f"_r.{error}") - F.col("_least")
    accepted = (F.col("_least") <= most_error) & F.coalesce(margin >= least_margin, F.lit(True))
    return keys.join(rivals, scope, "left").select(scope, "best", F.col("_least").alias("error"), F.col(f"_r.{position}").alias("rival"), margin.alias("margin"), accepted.alias("accepted"))


def rescale(cost: Column, anchors: dict[float, float]) -> Column:
    """Log-log interpolation over anchors, carried on beyond both ends."""
    known = sorted(anchors.items())
    if len(known) < 2:
        raise ValueError("two anchors at least")
    out = None
    for (x0, y0), (x1, y1) in reversed(list(zip(known[:-1], known[1:], strict=True))):
        slope = (math.log(y1) - math.log(y0)) / (math.log(x1) - math.log(x0))
        line = F.exp(F.lit(math.log(y0)) + (F.log(cost) - math.log(x0)) * slope)
        out = line if out is None else F.when(cost < x1, line).otherwise(out)
    return out


def thin(df: DataFrame, ident: str, most: int, seed: int = 5) -> DataFrame:
    """Exactly `most` rows, those of the smallest seeded hashes."""
    return df.orderBy(F.xxhash64(F.lit(seed), ident), ident).limit(most)


def windows(duration: float, count: int, seconds: float) -> list[tuple[float, float]]:
    """Windows of equal distance over a duration, as many as fit side by side up to count, with the rest as margins around each."""
    if min(duration, count, seconds) <= 0:
        raise ValueError("duration, count and seconds must be positive")
    if duration <= seconds:
        return [(0.0, duration)]
    room = duration / min(count, math.floor(duration / seconds))
    margin = (room - seconds) / 2
    return [(room * i + margin, seconds) for i in range(round(duration / room))]
