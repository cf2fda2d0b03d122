"""Slope units against direct loops over arrays."""

import collections
import random

import numpy as np
import pytest

from moraine.operators import corridors, grids, units
from moraine.operators.grids import Grid as units_grid


def table(spark, grid, name="unit", nothing=0):
    return spark.createDataFrame([(r, c, int(v)) for (r, c), v in np.ndenumerate(grid) if v != nothing] or [(0, 0, None)], f"r long, c long, {name} long").where(f"{name} is not null")


def direct_regions(kind):
    """Flood fill from each cell in turn."""
    out = np.full(kind.shape, -1)
    for start in np.ndindex(kind.shape):
        if kind[start] < 0 or out[start] >= 0:
            continue
        out[start], todo = start[0] * kind.shape[1] + start[1], [start]
        while todo:
            r, c = todo.pop()
            for at in ((r + i, c + j) for i, j in units.AROUND):
                if 0 <= at[0] < kind.shape[0] and 0 <= at[1] < kind.shape[1] and kind[at] == kind[start] and out[at] < 0:
                    out[at] = out[start]
                    todo.append(at)
    return out


def direct_dissolve(grid, least):
    """Unit by unit over the whole array; a unit's turn sees its box of the pass's start and one cell around."""
    now = grid.copy()
    while True:
        size = collections.Counter(now[now > 0].tolist())
        small = sorted((n, u) for u, n in size.items() if n < least)
        if not small:
            return now
        boxes = {u: [(x.min() - 1, x.max() + 1) for x in np.nonzero(now == u)] for _, u in small}
        for _, u in small:
            (r0, r1), (c0, c1) = boxes[u]
            inside = [(r, c) for r in range(max(0, r0), min(now.shape[0], r1 + 1)) for c in range(max(0, c0), min(now.shape[1], c1 + 1))]
            mine = {x for x in inside if now[x] == u}
            border = [x for x in inside if x not in mine and any((x[0] + i, x[1] + j) in mine for i, j in units.AROUND)]
            count = collections.Counter(int(now[x]) for x in border if now[x] > 0)
            new = min(count, key=lambda k: (-count[k], k)) if count else 0
            for x in mine:
                now[x] = new


def as_grid(rows, shape):
    out = np.zeros(shape, np.int64)
    for r in rows:
        out[r.r, r.c] = r.unit
    return out


@pytest.mark.parametrize("tile", [3, 7, 512])
def test_regions_equal_flood_fill(spark, tile):
    rng = np.random.default_rng(tile)
    kind = rng.integers(-1, 3, (23, 31))
    kind[5, :] = 7  # a long region over many tiles
    kind[:, 9] = 7
    want = direct_regions(kind)
    assert (units.regions(kind)[kind >= 0] == want[kind >= 0]).all()
    got = units.labelled(table(spark, kind, "kind", -1), tile=tile).collect()
    named = {(r.r, r.c): r.unit for r in got}
    first = {}
    for at in sorted(named):
        first.setdefault(named[at], at[0] * kind.shape[1] + at[1])
    assert len(named) == (kind >= 0).sum() and all(first[u] == want[at] for at, u in named.items())
    order = sorted(set(named.values()))
    assert [(kind.ravel()[first[u]], first[u]) for u in order] == sorted((kind.ravel()[first[u]], first[u]) for u in order)


def test_grown_units_still_merge_in_their_pass(spark):
    grid = np.array([[1, 2, 2] + [3] * 10])
    assert (as_grid(units.dissolve(table(spark, grid), 3).collect(), grid.shape) == 3).all()
    alone = np.zeros((6, 6), int)
    alone[2, 2] = 7
    assert units.dissolve(table(spark, alone), 4).count() == 0 and units.dissolve(table(spark, alone * 0), 4).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_dissolve_equals_direct_loop(spark, seed):
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, [2, 4, 9, 3][seed], (26, 22))
    kind = np.repeat(np.repeat(kind, 2, 0), 1 + seed % 2, 1)
    kind[rng.random(kind.shape) < 0.1] = -1
    grid = np.where(kind >= 0, direct_regions(kind) + 1, 0)
    got = as_grid(units.dissolve(table(spark, grid), 6, bucket_cells=50).collect(), grid.shape)
    assert (got == direct_dissolve(grid, 6)).all() and got.any()


def direct_terrain(z, step, smooth):
    pad = np.pad(z, 1, mode="edge")
    slope, aspect = np.zeros(z.shape), np.zeros(z.shape)
    for r, c in np.ndindex(z.shape):
        w = pad[r : r + 3, c : c + 3]
        east = (w[0, 2] + 2 * w[1, 2] + w[2, 2] - w[0, 0] - 2 * w[1, 0] - w[2, 0]) / (8 * step)
        north = (w[0].sum() + w[0, 1] - w[2].sum() - w[2, 1]) / (8 * step)
        slope[r, c] = np.degrees(np.arctan(np.hypot(east, north)))
        aspect[r, c] = np.degrees(np.arctan2(-east, -north)) % 360 if np.hypot(east, north) >= 1e-12 else 0.0
    half = smooth // 2
    s, k = (np.pad(f(np.radians(aspect)), half, mode="edge") for f in (np.sin, np.cos))
    mean = [[np.arctan2(s[r : r + smooth, c : c + smooth].mean(), k[r : r + smooth, c : c + smooth].mean()) for c in range(z.shape[1])] for r in range(z.shape[0])]
    return slope, np.degrees(np.array(mean)) % 360


@pytest.mark.parametrize("tile", [8, 512])
def test_terrain_equals_direct_windows(spark, tile):
    rng = np.random.default_rng(2)
    z = 100 * np.cumsum(rng.normal(size=(19, 23)), 0)
    z[4, 5] = z[0, 0] = np.nan
    rows = [(r + 40, c - 11, None if (r, c) == (0, 0) else float(v)) for (r, c), v in np.ndenumerate(z) if (r, c) != (9, 9)]
    z[9, 9] = np.nan
    filled = np.where(np.isfinite(z), z, np.nanmedian(z))
    slope, aspect = direct_terrain(filled, 30.0, 5)
    got = units.terrain(spark.createDataFrame(rows, "r long, c long, z double"), 30.0, 5, tile).collect()
    assert len(got) == z.size
    for x in got:
        at = x.r - 40, x.c + 11
        assert x.known == np.isfinite(z[at]) and x.z == filled[at]
        assert x.slope == pytest.approx(slope[at]) and abs((x.aspect - aspect[at] + 180) % 360 - 180) < 1e-6


def test_delineation_covers_steep_ground_with_large_units(spark):
    r, c = np.mgrid[:60, :50]
    z = 900 - 22.0 * np.abs(c - 25) + 60 * np.sin(r / 6)
    rows = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(z)]
    got = units.delineate(spark.createDataFrame(rows, "r long, c long, z double"), 30.0, min_area=9000.0, tile=16).collect()
    size = collections.Counter(x.unit for x in got)
    assert sorted(size) == list(range(1, len(size) + 1)) and len(size) > 4 and min(size.values()) >= 10
    slope, aspect = direct_terrain(z, 30.0, 5)
    kind = np.where(slope >= 15, np.floor(z / 250) * 8 + np.floor((aspect + 22.5) % 360 / 45), -1)
    kind = np.where(kind >= 0, kind - kind[kind >= 0].min() // 8 * 8, -1).astype(int)
    first = direct_regions(kind)
    order = {u: k + 1 for k, (_, u) in enumerate(sorted({(kind.ravel()[u], u) for u in first[first >= 0]}))}
    want = direct_dissolve(np.array([[order.get(u, 0) for u in row] for row in first]), 10)
    number = {}
    for u in want.ravel().tolist():
        if u:
            number.setdefault(u, len(number) + 1)
    assert {(x.r, x.c): x.unit for x in got} == {at: number[int(u)] for at, u in np.ndenumerate(want) if u}


def test_order_statistics(spark):
    r = random.Random(1)
    values = [r.choice([r.gauss(0, 1), 1e9, -3.5, float(r.randrange(5))]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "z double")
    assert [units.order_statistic(df, "z", k) for k in (0, 100, 299)] == [sorted(values)[k] for k in (0, 100, 299)]


# Warping and projection


def direct_warp(values, source, target, kind, fill=-1.0):
    """Every source cell against every target cell."""
    out = {}
    for i, j in np.ndindex(target.rows, target.cols):
        top, left = target.y0 - i * target.step, target.x0 + j * target.step
        parts = collections.defaultdict(float)
        total = area = 0.0
        for (r, c), v in values.items():
            y, x = source.y0 - r * source.step, source.x0 + c * source.step
            h = min(top, y) - max(top - target.step, y - source.step)
            w = min(left + target.step, x + source.step) - max(left, x)
            middle = y >= top - target.step / 2 > y - source.step and x <= left + target.step / 2 < x + source.step
            if kind == "nearest" and middle:
                parts[v] = 1.0
            if h > 1e-6 and w > 1e-6 and kind != "nearest":
                parts[v] += h * w
                total, area = total + v * h * w, area + h * w
        best = min(parts, key=lambda v: (-round(parts[v], 6), v)) if parts else fill
        out[i, j] = (total / area if area else fill) if kind == "average" else best
    return out


@pytest.mark.parametrize("kind", ["average", "mode", "nearest"])
@pytest.mark.parametrize("step", [7.0, 10.0, 23.5])
def test_warping_equals_all_pairs(spark, kind, step):
    rng = np.random.default_rng(int(step))
    source, target = units_grid(0.0, 100.0, 10.0, 10, 8), units_grid(-13.0, 108.0, step, 9, 6)
    grid = rng.integers(0, 4, (10, 8)).astype(float)
    rows = [(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(grid)] + [(3, 20, None), (4, 20, float("nan"))]
    values = {(r, c): v for r, c, v in rows if v is not None and v == v and v != 2.0}
    got = {(x.r, x.c): x.value for x in grids.warp(spark.createDataFrame(rows, "r long, c long, value double"), source, target, kind, 2.0, -1.0).collect()}
    want = direct_warp(values, source, target, kind)
    assert got == pytest.approx(want) and len(set(want.values())) > 2


def test_warping_refuses_other_kinds(spark):
    cells = spark.createDataFrame([(0, 0, 1.0)], "r long, c long, value double")
    with pytest.raises(ValueError):
        grids.warp(cells, units_grid(0, 1, 1, 1, 1), units_grid(0, 1, 1, 1, 1), "cubic")


def test_nearest_segments_equal_all_segments_and_few_are_looked_at():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 3000):
        line = np.cumsum(rng.normal(size=(n + 1, 2)) + (1.0, 0.2), 0)
        line[-1] = line[-2] if n > 2 else line[-1]  # a segment of no length
        points = np.vstack((rng.normal(size=(150, 2)) * 3 + line[rng.integers(0, n + 1, 150)], line[:20], rng.normal(size=(20, 2)) * 5000, [[np.nan, 1.0]]))
        a, seg = line[:-1], np.diff(line, axis=0)
        size = (seg * seg).sum(1)
        start = np.concatenate(([0.0], np.cumsum(np.sqrt(size))))[:-1]
        a, seg, start, size = (x[size > 0] for x in (a, seg, start, size))
        index = corridors.Segments([tuple(p) for p in line])
        looked = []
        inner = index.within
        index.within = lambda *x: looked.append(inner(*x)) or looked[-1]
        s, off = index.nearest(points)
        for k, p in enumerate(points[:-1]):
            t = np.clip(((p - a) * seg).sum(1) / size, 0, 1)
            d = p - a - t[:, None] * seg
            best = (d * d).sum(1).argmin()
            assert abs(off[k]) == pytest.approx(np.hypot(*d[best])) and s[k] == pytest.approx(start[best] + t[best] * np.sqrt(size[best]))
        assert np.isnan(s[-1])
        if n == 3000:
            near = index.nearest(points[:150]) and looked[-1]
            assert len(near) < 300
