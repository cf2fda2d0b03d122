"""Slope units: classes of terrain, connected regions of a class, and exact merging of small regions.

A grid is a table of cells (r, c, ...), rows from north to south. Nothing holds more than a tile, or what
small regions touch, in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.checkpoints import cut, stored
from moraine.operators import graph

OCTANTS = 8
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
SIDE = 1 << 24  # rows and columns are below that
BINS = 4096


def order_statistic(rows: DataFrame, x: str, k: int) -> float:
    """The kth smallest value (from 0), exactly: each pass counts ``BINS`` bins and looks into the one that holds it."""
    low, high = rows.agg(F.min(x), F.max(x)).first()
    while low < high:
        width = (high - low) / BINS
        if not width or low + width == low:
            break
        place = F.least(F.floor((F.col(x) - low) / width), F.lit(BINS - 1))
        bins = sorted(tuple(r) for r in rows.where(F.col(x).between(low, high)).groupBy(place.alias("b")).agg(F.count("*"), F.min(x), F.max(x)).collect())
        for _, n, least, most in bins:
            if k < n:
                low, high = least, most
                break
            k -= n
    return low


def horn(z: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope in degrees and azimuth of descent from weighted differences over 3 x 3 cells; flat cells have azimuth 0. The rim of ``z`` is left out."""
    across, down = (z[:, 2:] - z[:, :-2]) / (8 * step), (z[:-2] - z[2:]) / (8 * step)
    east = across[:-2] + 2 * across[1:-1] + across[2:]
    north = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    size = np.hypot(east, north)
    return np.degrees(np.arctan(size)), np.where(size < 1e-12, 0.0, np.degrees(np.arctan2(-east, -north)) % 360)


def box_mean(x: np.ndarray, window: int) -> np.ndarray:
    """Means over squares of that side; the rim of half a side is left out."""
    return np.lib.stride_tricks.sliding_window_view(x, (window, window)).mean((2, 3))


def _in_tiles(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """cells with (tr, tc) of their tile, and again for each tile whose halo they are in."""
    at = [F.struct(F.floor((F.col("r") + i) / tile).cast("long").alias("tr"), F.floor((F.col("c") + j) / tile).cast("long").alias("tc")) for i in sorted({-halo, 0, halo}) for j in sorted({-halo, 0, halo})]
    return cells.select("*", F.explode(F.array_distinct(F.array(*at))).alias("t")).select(*cells.columns, "t.*")


def terrain(cells: DataFrame, step: float, smooth: int = 5, tile: int = 512) -> DataFrame:
    """(r, c, z, slope, aspect, known) of every cell of the grid's rectangle; aspect is a circular mean over ``smooth`` x ``smooth`` cells.

    Cells without a finite z count as the median of the others and are not known. Beyond the
    rectangle its border is repeated. cells: r, c, z.
    """
    fine = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("z").cast("double").alias("z")).where("z is not null and not isnan(z) and abs(z) < double('infinity')")
    whole = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if whole[0] is None:
        return fine.select("r", "c", "z", F.lit(0.0).alias("slope"), F.lit(0.0).alias("aspect"), F.lit(True).alias("known"))
    top, bottom, left, right = map(int, whole)
    n = fine.count()
    fill = 0.0
    if 0 < n < (bottom - top + 1) * (right - left + 1):
        fill = (order_statistic(fine, "z", (n - 1) // 2) + order_statistic(fine, "z", n // 2)) / 2
    half = smooth // 2
    halo = half + 1

    def shape(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        # The tile and its halo, as far as they are in the rectangle.
        r0, c0 = max(top, key[0] * tile), max(left, key[1] * tile)
        r1, c1 = min(bottom, key[0] * tile + tile - 1), min(right, key[1] * tile + tile - 1)
        a, b = max(top, r0 - halo), max(left, c0 - halo)
        z = np.full((min(bottom, r1 + halo) - a + 1, min(right, c1 + halo) - b + 1), np.nan)
        z[held["r"].to_numpy() - a, held["c"].to_numpy() - b] = held["z"].to_numpy()
        known = np.isfinite(z)
        z = np.where(known, z, fill)
        slope, aspect = horn(np.pad(z, 1, mode="edge"), step)
        angle = np.radians(aspect)
        around = [box_mean(np.pad(f(angle), half, mode="edge"), smooth) for f in (np.sin, np.cos)]
        aspect = np.degrees(np.arctan2(*around)) % 360
        own = np.s_[r0 - a : r1 - a + 1, c0 - b : c1 - b + 1]
        r, c = np.mgrid[r0 : r1 + 1, c0 : c1 + 1]
        return pd.DataFrame({"r": r.ravel(), "c": c.ravel(), **{k: v[own].ravel() for k, v in (("z", z), ("slope", slope), ("aspect", aspect), ("known", known))}})

    # A tile of the rectangle without any known cell has a row of its own, so that it is filled.
    down, across = bottom // tile - top // tile + 1, right // tile - left // tile + 1
    tiles = cells.sparkSession.range(down * across).select((F.floor(F.col("id") / across) + top // tile).alias("tr"), (F.col("id") % across + left // tile).alias("tc"))
    inside = _in_tiles(fine, tile, halo).where(F.col("tr").between(top // tile, bottom // tile) & F.col("tc").between(left // tile, right // tile))

    def fill_in(key: tuple, held: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        return shape(key, held)

    return inside.groupBy("tr", "tc").cogroup(tiles.groupBy("tr", "tc")).applyInPandas(fill_in, "r long, c long, z double, slope double, aspect double, known boolean")


def kinds(ground: DataFrame, steep: float = 15.0, band: float = 250.0) -> DataFrame:
    """ground with ``kind``: octant of the aspect and band of elevation, from 1 in the lowest band of steep cells; null for cells that are unknown or less steep."""
    wanted = F.col("known") & (F.col("slope") >= steep)
    level = F.floor(F.col("z") / band).cast("long")
    lowest = F.coalesce(F.lit(ground.where(wanted).agg(F.min(level)).first()[0]), F.lit(0))
    octant = F.floor(F.pmod(F.col("aspect") + 360.0 / (2 * OCTANTS), F.lit(360.0)) / (360.0 / OCTANTS)).cast("long")
    return ground.withColumn("kind", F.when(wanted, (level - lowest) * OCTANTS + octant + 1))


def regions(kind: np.ndarray) -> np.ndarray:
    """The first place (row by row) of each cell's region: cells of one kind that touch, corners too. Kinds below 0 are their own."""
    place = np.arange(kind.size).reshape(kind.shape)
    a, b = [], []
    for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)):
        here = np.s_[: kind.shape[0] - i, max(0, -j) : kind.shape[1] - max(0, j)]
        there = np.s_[i:, max(0, j) : kind.shape[1] + min(0, j)]
        same = (kind[here] == kind[there]) & (kind[here] >= 0)
        a.append(place[here][same])
        b.append(place[there][same])
    a, b, label = np.concatenate(a), np.concatenate(b), place.ravel().copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label.reshape(kind.shape)
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def labelled(cells: DataFrame, kind: str = "kind", tile: int = 512) -> DataFrame:
    """(r, c, kind, unit): neighbours of one kind, corners too, are one unit. A unit's number is in order of its kind, then of its first cell.

    Two levels: a tile is labelled in one task, then only labels that meet across borders of tiles are joined. Kinds are
    longs from 0 to 2^15; cells of no kind are left out.
    """
    own = cells.where(F.col(kind).isNotNull()).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(kind).cast("long").alias("kind"))

    def label(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        r, c = held["r"].to_numpy(), held["c"].to_numpy()
        top, left = r.min(), c.min()
        grid = np.full((r.max() - top + 1, c.max() - left + 1), -1, np.int64)
        grid[r - top, c - left] = held["kind"].to_numpy()
        first = regions(grid)[r - top, c - left]
        number = (first // grid.shape[1] + top) * SIDE + first % grid.shape[1] + left
        return held[["r", "c", "kind"]].assign(label=number)

    home = [F.floor(F.col(x) / tile).cast("long").alias(f"t{x}") for x in "rc"]
    tiled = cut(own.select("*", *home).groupBy("tr", "tc").applyInPandas(label, "r long, c long, kind long, label long"))
    edge = lambda x: F.pmod(F.col(x), F.lit(tile)).isin(0, tile - 1)
    rim = tiled.where(edge("r") | edge("c"))
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1))]))
    asked = rim.withColumn("d", ahead).select((F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c"), "kind", F.col("label").alias("src"), *home)
    met = asked.join(rim.withColumnRenamed("label", "dst"), ["r", "c", "kind"]).where((F.floor(F.col("r") / tile) != F.col("tr")) | (F.floor(F.col("c") / tile) != F.col("tc")) | (F.col("src") != F.col("dst")))
    found = graph.components(met.select("src", "dst").where("src <> dst").distinct())
    first = F.coalesce("component", "label")
    return tiled.join(found, tiled["label"] == found["node"], "left").select("r", "c", "kind", (F.col("kind") * SIDE * SIDE + first).alias("unit"))


def _merged(held: pd.DataFrame) -> pd.DataFrame:
    """New units of the cells of small units that change; held: r, c, unit, n (cells of the unit), small.

    Small units merge one after the other, the smallest first. A unit takes the cells it has at its turn within its
    first bounding box and one cell around, earlier merges included; of the units in that box that touch them
    it joins the one with most touching cells, of equals the smallest number. Without any it goes.
    """
    now = dict(zip(zip(held["r"].tolist(), held["c"].tolist()), held["unit"].tolist()))
    small = held[held["small"]]
    has: dict[int, set] = {}
    for r, c, unit in zip(small["r"].tolist(), small["c"].tolist(), small["unit"].tolist()):
        has.setdefault(unit, set()).add((r, c))
    boxes = small.groupby("unit").agg(n=("n", "first"), r0=("r", "min"), r1=("r", "max"), c0=("c", "min"), c1=("c", "max")).reset_index().sort_values(["n", "unit"])
    for unit, _, r0, r1, c0, c1 in boxes.itertuples(index=False):
        mine = {(r, c) for r, c in has[unit] if r0 - 1 <= r <= r1 + 1 and c0 - 1 <= c <= c1 + 1}
        border = {(r + i, c + j) for r, c in mine for i, j in AROUND if r0 - 1 <= r + i <= r1 + 1 and c0 - 1 <= c + j <= c1 + 1} - mine
        touched: dict[int, int] = {}
        for at in border:
            if (other := now.get(at)) is not None:
                touched[other] = touched.get(other, 0) + 1
        if not mine:
            continue
        into = min(touched, key=lambda u: (-touched[u], u)) if touched else None
        has[unit] -= mine
        if into in has:
            has[into] |= mine
        for at in mine:
            now[at] = into
    return pd.DataFrame([(r, c, now[r, c]) for r, c, was in zip(small["r"].tolist(), small["c"].tolist(), small["unit"].tolist()) if now[r, c] != was], columns=["r", "c", "into"]).astype({"into": "Int64"})


def dissolve(cells: DataFrame, least: int, most: int = 1000, bucket_cells: int = 200_000) -> DataFrame:
    """(r, c, unit): units of fewer than ``least`` cells merge into neighbours, in the order and by the rule of ``_merged``, until there is none.

    Which units are small is settled at the start of a pass. Small units that touch, and those that
    touch these, are a cluster; merges in one cluster don't see another, so clusters are
    replayed in buckets, each task with whole clusters and the cells around them. A grid of which nearly all is in small units
    that touch is one cluster, which is then one task.
    """
    now = stored(cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("unit").cast("long").alias("unit")))
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND]))
    for _ in range(most):
        sizes = now.groupBy("unit").agg(F.count("*").alias("n"))
        small = stored(sizes.where(F.col("n") < least))
        if small.isEmpty():
            break
        mine = now.join(small, "unit")
        asked = mine.withColumn("d", shift).select("unit", (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c")).distinct()
        near = stored(asked.join(now.withColumnRenamed("unit", "other"), ["r", "c"]).where("other <> unit"))
        others = small.select(F.col("unit").alias("other"), F.lit(True).alias("small"))
        edges = near.select("unit", "other").distinct().join(others, "other").select(F.col("unit").alias("src"), F.col("other").alias("dst"))
        clusters = graph.components(edges).select(F.col("node").alias("unit"), "component")
        mine = mine.join(clusters, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
        held = stored(mine.select("component", "r", "c", "unit", "n", F.lit(True).alias("small")))
        buckets = max(1, math.ceil(held.count() / bucket_cells))
        ring = near.join(others, "other", "left_anti").join(clusters, "unit", "left").select(F.coalesce("component", "unit").alias("component"), "r", "c", F.col("other").alias("unit"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("small"))
        key = F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket")
        moves = held.unionByName(ring).select(key, "r", "c", "unit", "n", "small").distinct().groupBy("bucket").applyInPandas(_merged, "r long, c long, into long")
        moves = moves.withColumn("moved", F.lit(True))
        now = stored(now.join(moves, ["r", "c"], "left").select("r", "c", F.when(F.col("moved"), F.col("into")).otherwise(F.col("unit")).alias("unit")).where("unit is not null"))
    return now


def renumbered(cells: DataFrame) -> DataFrame:
    """Units numbered from 1 in the order of their first cells, row by row."""
    first = cells.groupBy("unit").agg(F.min(F.struct("r", "c")).alias("first"))
    # One row a unit; numbers are counted by row of the grid first, so no task orders all units.
    own = Window.partitionBy("row").orderBy("first")
    rows = first.withColumn("row", F.col("first.r"))
    before = rows.groupBy("row").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)))
    numbers = rows.withColumn("i", F.row_number().over(own)).join(before, "row").select("unit", (F.coalesce("before", F.lit(0)) + F.col("i")).alias("number"))
    return cells.join(numbers, "unit").select("r", "c", F.col("number").alias("unit"))


def delineate(cells: DataFrame, step: float, steep: float = 15.0, band: float = 250.0, min_area: float = 40_000.0, smooth: int = 5, tile: int = 512) -> DataFrame:
    """(r, c, unit, z, slope, aspect) of the cells in a slope unit: regions of one octant and band over steep ground, small ones dissolved."""
    ground = cut(kinds(terrain(cells, step, smooth, tile), steep, band))
    units = renumbered(dissolve(labelled(ground, "kind", tile), max(round(min_area / step**2), 1)))
    return units.join(ground.select("r", "c", "z", "slope", "aspect"), ["r", "c"])
