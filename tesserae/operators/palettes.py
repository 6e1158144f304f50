"""Palettes for clusters of tiles: descriptors, their clusters, and 15 real colours for each cluster.

What is collected or grouped is bounded by the colour domain: a cluster has 32,768 distinct colours at most.
Tiles without pixels are left out; equal distances go to the first centre or the smaller colour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Colours of a palette, palettes of the hardware, rounds of either fit, size of the colour domain.
SLOTS, BANKS, ROUNDS, DOMAIN = 15, 256, 24, 32768


def colour_table(grid: DataFrame) -> np.ndarray:
    """The colour grid as an array, a row a colour (fixed size)."""
    return np.array([r[:] for r in grid.orderBy("color").select("L", "a", "bb").collect()], dtype=float)


def descriptor(lab: np.ndarray) -> np.ndarray:
    """Mean, darkest and brightest pixel of a tile, the first on ties."""
    return np.concatenate([lab.mean(axis=0), lab[lab[:, 0].argmin()], lab[lab[:, 0].argmax()]])


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2.0 * points @ centres.T + (centres**2).sum(axis=1)


def cluster(points: DataFrame, count: int, seed: int) -> np.ndarray:
    """(v array<double>) -> centres by Lloyd's algorithm from distinct random points; an empty cluster keeps its centre."""
    start = [r["v"] for r in points.select("v").distinct().orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(count).collect()]
    if not start:
        raise ValueError("no tiles to make palettes of")
    rng = np.random.default_rng(seed)
    centres = np.array(start + [start[i] for i in rng.integers(0, len(start), count - len(start))], dtype=float)
    width = centres.shape[1]

    for _ in range(ROUNDS):
        now = centres

        def sums(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total = np.zeros((count, width + 1))
            for part in batches:
                if len(part):
                    v = np.stack(part["v"].to_list())
                    np.add.at(total, squared(v, now).argmin(axis=1), np.column_stack([v, np.ones(len(v))]))
            yield pd.DataFrame(total, columns=[f"_{i}" for i in range(width + 1)]).assign(c=range(count))

        names = [f"_{i}" for i in range(width + 1)]
        rows = points.select("v").mapInPandas(sums, ", ".join(f"{n} double" for n in names) + ", c long").groupBy("c").agg(*(F.sum(n).alias(n) for n in names)).collect()
        centres = now.copy()
        for r in rows:
            if r[f"_{width}"]:
                centres[r["c"]] = [r[f"_{i}"] / r[f"_{width}"] for i in range(width)]
        if np.allclose(centres, now):
            break
    return centres


def fit(colours: np.ndarray, counts: np.ndarray, lab: np.ndarray, seed: int) -> list[int]:
    """15 of the colours: repeated in turn if there are no more, or else those nearest to weighted centres.

    The fit starts from the most frequent colours; a centre that loses all colours starts again from a random one.
    """
    if len(colours) <= SLOTS:
        return np.resize(colours, SLOTS).tolist()
    points, rng = lab[colours], np.random.default_rng(seed)
    centres = points[np.lexsort((colours, -counts))[:SLOTS]].copy()
    for _ in range(ROUNDS):
        label, old = squared(points, centres).argmin(axis=1), centres.copy()
        reseeded = False
        for k in range(SLOTS):
            mine = label == k
            if mine.any():
                centres[k] = np.average(points[mine], axis=0, weights=counts[mine])
            else:
                centres[k], reseeded = points[rng.integers(len(points))], True
        if not reseeded and np.allclose(centres, old):
            break
    return colours[squared(points, centres).argmin(axis=0)].tolist()


def palette_set(tiles: DataFrame, grid: DataFrame, count: int, base: int, seed: int) -> DataFrame:
    """(px array<int> of colours) -> (palette, bank, colors, descriptor): a palette for each cluster of tiles.

    A cluster without tiles gets a palette of all tiles' colours.
    """
    if base + count > BANKS:
        raise ValueError(f"{count} palettes from bank {base} are more than {BANKS} banks hold")
    lab = colour_table(grid)
    tiles = tiles.select(F.filter("px", lambda x: x.isNotNull()).alias("px")).where(F.size("px") > 0)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"v": [descriptor(lab[np.asarray(px)]) for px in part["px"]]})

    points = tiles.mapInPandas(described, "v array<double>").persist()
    centres = cluster(points, count, seed)
    points.unpersist()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                pixels = [np.asarray(px) for px in part["px"]]
                label = squared(np.stack([descriptor(lab[px]) for px in pixels]), centres).argmin(axis=1)
                key, n = np.unique(np.concatenate([c * DOMAIN + px for c, px in zip(label, pixels, strict=True)]), return_counts=True)
                yield pd.DataFrame({"palette": key // DOMAIN, "color": key % DOMAIN, "n": n})

    counts = tiles.mapInPandas(counted, "palette long, color long, n long").groupBy("palette", "color").agg(F.sum("n").alias("n"))
    empty = tiles.sparkSession.range(count).toDF("palette").join(counts.select("palette").distinct(), "palette", "left_anti")
    whole = counts.groupBy("color").agg(F.sum("n").alias("n")).join(F.broadcast(empty)).select("palette", "color", "n")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows, k = rows.sort_values("color"), int(rows["palette"].iloc[0])
        colours = fit(rows["color"].to_numpy(), rows["n"].to_numpy(), lab, seed + k)
        return pd.DataFrame({"palette": [k], "bank": [base + k], "colors": [colours], "descriptor": [centres[k].tolist()]})

    return counts.unionByName(whole).groupBy("palette").applyInPandas(fitted, "palette int, bank int, colors array<int>, descriptor array<double>")
