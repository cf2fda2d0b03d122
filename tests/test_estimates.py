"""Constants of alerts, dams and masses, and operators without SQL against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import hazard
from moraine.operators import balance, contracts, corridors, ensemble, force, inversion, windows

SMALL = "/root/testdata/sf0.001"


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_severity_and_urgency_bands(spark):
    stages = [6.0, 5.0, 4.99, 2.0, 1.99, 0.5, 0.49, 0.0, None]
    want = ["Extreme", "Extreme", "Severe", "Severe", "Moderate", "Moderate", "Minor", "Minor", "Unknown"]
    assert values(spark, *[hazard.severity(F.lit(x).cast("double")) for x in stages]) == want
    arrivals = [0.0, 30.0, 30.1, 180.0, 180.1, None]
    assert values(spark, *[hazard.urgency(F.lit(x).cast("double")) for x in arrivals]) == ["Immediate", "Immediate", "Expected", "Expected", "Future", "Unknown"]


def test_dam_break_chain(spark):
    sites = spark.createDataFrame([(1000.0, 20.0, 30.0), (1000.0, 20.0, 5.0), (1000.0, 20.0, 0.0), (9000.0, 20.0, 20.0)], "chainage double, channel_depth double, deposit double")
    rows = {(r.chainage, r.deposit): r for r in ensemble.dam_break_chain(sites, F.lit(10.0), F.lit(6000.0)).collect()}
    assert set(rows) == {(1000.0, 30.0), (1000.0, 5.0), (9000.0, 20.0)}  # none without a deposit
    a = rows[(1000.0, 30.0)]
    assert (a["index"], a.index_low, a.index_high, a.dam_height) == (1.5, 0.75, 2.25, 20.0)  # no higher than the channel
    volume = 0.5 * 20 * 20 * 30 / 0.01  # at least 30 m wide
    peak = 0.0026 * (volume * 20) ** 0.79
    assert a.volume == pytest.approx(volume) and a.peak == pytest.approx(peak)
    assert a.duration_s == pytest.approx(2 * volume / peak) and a.rise_s == pytest.approx(a.duration_s / 3)
    assert a.probability == pytest.approx(1 / (1 + math.exp(-0.5 / 0.4))) and rows[(9000.0, 20.0)].probability == pytest.approx(0.5)
    assert a.surge_s == pytest.approx(5000 / (1.5 * math.sqrt(9.80665 * 20))) and rows[(9000.0, 20.0)].surge_s is None


def brute_constrictions(bed, spacing, sites=12, apart=2000.0, reach=1500.0, least=5.0):
    known = [x for x in bed if x is not None]
    if len(known) < 5:
        return []
    z = [max(known) if x is None else x for x in bed]
    half = max(3, round(reach / max(spacing, 1.0)))
    depth = [max(z[max(0, i - half) : i + half + 1]) - z[i] for i in range(len(z))]
    out = []
    for i in sorted(range(len(z)), key=lambda i: (-depth[i], -i)):
        if depth[i] >= least and bed[i] is not None and all(abs(i - j) * spacing >= apart for j in out) and len(out) < sites:
            out.append(i)
    return sorted(out)


def test_constrictions_equal_brute_force(spark):
    r = random.Random(1)
    beds = {k: [None if r.random() < 0.1 else r.uniform(0, 40) for _ in range(r.choice((3, 40, 120)))] for k in range(12)}
    rows = spark.createDataFrame([(k, i, x, 1.0) for k, bed in beds.items() for i, x in enumerate(bed)], "run long, bin int, min_bed double, deposit double")
    got = {k: [] for k in beds}
    for x in ensemble.constrictions(rows, ["run"], 250.0).collect():
        got[x.run].append(x.bin)
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_constrictions(bed, 250.0) for k, bed in beds.items()} and any(got.values())


def test_intervals(spark):
    lit = lambda *xs: tuple(F.lit(float(x)) for x in xs)
    assert values(spark, *contracts.spread(*lit(1, 2, 3))) == [1.0, 2.0, 3.0]
    assert values(spark, *contracts.spread(*lit(3, 3, 4))) == [2.0, 3.0, 4.0]  # only the end that isn't beyond the middle
    assert values(spark, *contracts.spread(*lit(3, 3, 3))) == [2.0, 3.0, 4.5]
    assert values(spark, *contracts.union_interval(lit(1, 4, 8), lit(2, 9, 20))) == [1.0, 6.0, 20.0, 4 / 9]
    low, mid, high, ratio = values(spark, *contracts.union_interval(lit(5, 5, 5), lit(5, 5, 5)))
    assert low < mid < high and ratio == 1.0


def test_corner_is_signed():
    misfit, norm = np.exp([0, 0.1, 0.2, 1.0, 2.0]), np.exp([3.0, 2.0, 1.0, 0.9, 0.8])
    assert inversion.corner(list(misfit), list(norm)) == 2
    # A concave bend of the same size doesn't win over a convex one that is flatter.
    x, y = np.array([0, 1, 2, 2.2, 2.4, 3.4, 4.4]), np.array([5, 4.9, 4.8, 3.8, 2.8, 2.5, 2.2])
    assert inversion.corner(list(np.exp(x)), list(np.exp(y))) in (4, 5)


def brute_summary(f, dt):
    m = np.linalg.norm(f, axis=0)
    run = np.linalg.norm(np.cumsum(f, axis=1) * dt, axis=0)
    loud = np.nonzero(m >= 0.05 * m.max())[0]
    h = np.hypot(f[1], f[2])
    at = int(h.argmax())
    return m.max(), int(m.argmax()), run.max(), int(run.argmax()), loud[0], (loud[-1] - loud[0]) * dt, max(run.argmax() - loud[0], 1) * dt, math.degrees(math.atan2((f[2] * m**2).sum(), (f[1] * m**2).sum())) % 360, math.degrees(math.atan2(abs(f[0, at]), h[at]))


def histories(spark, rows):
    return spark.createDataFrame([(k, [tuple(map(float, x)) for x in f.T]) for k, f in rows.items()], "id long, force array<struct<up:double,north:double,east:double>>")


def test_force_summary_and_masses(spark):
    r = np.random.default_rng(3)
    rows = {k: r.normal(size=(3, 40)).cumsum(1) * 1e9 for k in range(6)} | {9: np.zeros((3, 5))}
    got = {x.id: x for x in force.summarise(histories(spark, rows), "id", "force", 0.5).collect()}
    for k in range(6):
        x = got[k]
        assert [x.peak_force, x.peak_index, x.impulse, x.impulse_index, x.onset_index, x.duration_s, x.acceleration_s, x.azimuth, x.path_angle] == pytest.approx(brute_summary(rows[k], 0.5))
    assert (got[9].peak_force, got[9].path_angle, got[9].impulse) == (0.0, 90.0, 0.0)
    none = F.lit(None).cast("double")
    mass = {x.id: x for x in force.estimates(force.summarise(histories(spark, rows), "id", "force", 0.5), none, F.lit(500.0), F.lit(1000.0)).collect()}
    angle, phi = math.degrees(math.atan2(500, 1000)), np.linspace(0.2, 0.8, 33)
    for k in range(6):
        a = np.percentile(got[k].peak_force / (9.81 * math.sin(math.radians(angle)) * (1 - phi)), [5, 50, 95])
        own = min(55, max(8, got[k].path_angle))
        b = np.percentile(got[k].impulse / (got[k].acceleration_s * np.maximum(9.81 * math.sin(math.radians(own)) * (1 - phi), 0.05)), [5, 50, 95])
        assert [mass[k].force_p05, mass[k].force_p50, mass[k].force_p95, mass[k].impulse_p05, mass[k].impulse_p50, mass[k].impulse_p95] == pytest.approx([*a, *b])
        assert (mass[k].p05, mass[k].p95, mass[k].ratio) == pytest.approx((min(a[0], b[0]), max(a[2], b[2]), a[1] / b[1])) and mass[k].basis == "published"
    assert mass[9].p50 is None


def test_mass_from_terrain_recovers_a_planted_mass(spark):
    dt, true = 1.0, 4e10
    n, e, u = np.zeros(60), np.full(60, -0.8), np.full(60, 0.5)
    f = np.array([u, n, e]) * true  # force is against the motion: down and east
    ends = force.unit_displacement(histories(spark, {1: f}), "id", "force", dt).first()
    t = 59.0
    assert (ends["drop"], ends["runout"]) == pytest.approx((0.5 * true * t * t / 2, 0.8 * true * t * t / 2), rel=1e-9)
    # Ground that is concave: only one mass falls as far as the ground does.
    x = np.linspace(0, 5000, 501)
    z = 0.5 * 59**2 / 2 * (x / (0.8 * 59**2 / 2)) ** 0.5
    df = spark.createDataFrame([(1, ends["drop"], ends["runout"], x.tolist(), z.tolist())], "id long, drop double, runout double, x array<double>, z array<double>")
    assert df.select(force.mass_from_terrain()("drop", "runout", "x", "z")).first()[0] == pytest.approx(true, rel=5e-3)


def test_window_features_equal_direct_computation(spark):
    b = windows.Bands(4.0, (0.1, 0.5), (0.0, 0.1), (1.0, 2.0), (0.5, 1.0), 2.0, 8.0)
    r = np.random.default_rng(5)
    slots = [(k // 3, r.normal(size=128).cumsum(), r.normal(size=128) if k % 4 else None, r.normal(size=128)) for k in range(9)]
    slots += [(3, np.zeros(128), None, None), (4, None, None, None)]
    df = spark.createDataFrame([(w, *[None if x is None else x.tolist() for x in xs]) for w, *xs in slots], "window long, z array<double>, n array<double>, e array<double>")
    got = {x.window: x.asDict() for x in windows.window_features(df, "window", b).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and all(len(x) == 80 for x in got.values())
    assert all(v == 0 for w in (3, 4) for c, v in got[w].items() if c != "window")

    def power(x):  # the transform written out
        x = (x - x.mean()) * np.hanning(len(x))
        k = np.arange(len(x) // 2 + 1)
        return k * 4.0 / len(x), np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(len(x))) / len(x)) @ x) ** 2

    for w in range(3):
        part = [s for s in slots if s[0] == w]
        ratios, horizontal = [], []
        for _, z, n, e in part:
            at, p = power(z)
            ratios.append(np.log10(p[(at >= 0.1) & (at < 0.5)].sum() / p[(at >= 1.0) & (at < 2.0)].sum()))
            if n is not None:
                horizontal.append(np.log10((n @ n + e @ e) / (z @ z)))
        middle = np.median(ratios)
        assert (got[w]["vert_log_lp_sp_ratio_med"], got[w]["vert_log_lp_sp_ratio_mad"], got[w]["vert_log_lp_sp_ratio_p90"]) == pytest.approx((middle, np.median(np.abs(ratios - middle)), np.percentile(ratios, 90)))
        assert got[w]["log_hv_energy_ratio_med"] == pytest.approx(np.median(horizontal))
        env = []
        for _, z, *_ in part:
            spectrum, at = np.fft.rfft(z), np.fft.rfftfreq(128, 0.25)
            low = np.abs(np.fft.irfft(spectrum * ((at >= 0.1) & (at < 0.5)), 128))
            env.append([sum(low[max(0, i - 4) : i + 4]) / 8 for i in range(128)])
        c = np.corrcoef(env)
        assert got[w]["lp_envelope_coherence"] == pytest.approx(np.mean(c[np.triu_indices(3, 1)]))


def test_trace_features_of_known_signals():
    b = windows.Bands()
    t = np.arange(12_000) / b.rate
    slow, fast = np.sin(2 * np.pi * 0.03 * t), np.sin(2 * np.pi * 3 * t)
    assert windows.trace_features(slow, b)["log_lp_sp_ratio"] > 2 and windows.trace_features(fast, b)["log_lp_sp_ratio"] < -2
    assert windows.trace_features(fast, b)["spectral_centroid_hz"] == pytest.approx(3, abs=0.05) and abs(windows.trace_features(fast, b)["centroid_drift_hz_per_s"]) < 1e-4
    chirp = np.sin(2 * np.pi * (1 * t + 0.002 * t * t))
    assert windows.trace_features(chirp, b)["centroid_drift_hz_per_s"] == pytest.approx(0.004, rel=0.05)
    assert len(windows.stems()) == 26


def test_platt_scaling_equals_gradient_steps(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=200).round(1)
    y = (r.random(200) < 1 / (1 + np.exp(-2 * x))).astype(int)
    got = balance.sigmoid(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int"), "x", F.col("y") == 1, 30)
    p, n = y.sum(), 200 - y.sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    a, c = 1.0, 0.0
    for _ in range(30):
        off = 1 / (1 + np.exp(-(a * x + c))) - t
        a, c = a - 0.5 * (off * x).mean(), c - 0.5 * off.mean()
    assert got == pytest.approx((a, c))


def test_designs_and_splits(spark):
    members = spark.range(40).withColumnRenamed("id", "m")
    design = balance.latin_hypercube(members, "m", 3, 7).toPandas()
    for c in ("u0", "u1", "u2"):
        assert sorted(design[c].round(6)) == [round((k + 0.5) / 40, 6) for k in range(40)]
    assert design["u0"].tolist() != design["u1"].tolist()
    rows = members.crossJoin(spark.range(3))
    split = balance.split_by_run(rows, "m", 5)
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count_distinct("m").alias("n")).collect()} == {"train": 28, "val": 6, "test": 6}
    assert balance.overlap(split, "m").count() == 0
    assert balance.overlap(split.unionByName(split.limit(1).withColumn("split", F.lit("other"))), "m").count() == 1


def brute_flood(z, seeds, epsilon):
    level = {c: z[c] if c in seeds else math.inf for c in z}
    while True:
        new = {}
        for (r, c), v in level.items():
            near = [level[(r + i, c + j)] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (r + i, c + j) in level]
            new[(r, c)] = min([v, *(max(z[(r, c)], x + epsilon) for x in near)])
        if new == level:
            return {c: v for c, v in level.items() if v < math.inf}
        level = new


def test_flood_equals_relaxation(spark):
    r = random.Random(4)
    z = {(i, j): round(r.uniform(0, 50), 3) for i in range(14) for j in range(11) if r.random() < 0.85}
    seeds = {c for c in z if c[0] == 0}
    cells = spark.createDataFrame([(i, j, v, (i, j) in seeds) for (i, j), v in z.items()], "r long, c long, z double, seed boolean")
    want = brute_flood(z, seeds, 0.5)
    for tile in (5, 128):
        got = {(x.r, x.c): x.filled for x in corridors.flood(cells, 0.5, tile).collect()}
        assert got == pytest.approx(want)


def test_projection_equals_all_segments(spark):
    r = random.Random(6)
    line = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (25.0, 12.0)]
    points = [(k, r.uniform(-5, 30), r.uniform(-8, 20)) for k in range(200)]
    got = {x.id: (x.s, x.n) for x in corridors.project(spark.createDataFrame(points, "id long, x double, y double"), line).collect()}
    for k, x, y in points:
        best = None
        along = 0.0
        for (ax, ay), (bx, by) in zip(line, line[1:]):
            size = math.hypot(bx - ax, by - ay)
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size**2))
            dx, dy = x - ax - t * (bx - ax), y - ay - t * (by - ay)
            if best is None or math.hypot(dx, dy) < best[0] - 1e-12:
                best = (math.hypot(dx, dy), along + t * size, math.copysign(math.hypot(dx, dy), (bx - ax) * dy - (by - ay) * dx))
            along += size
        assert got[k] == pytest.approx((best[1], best[2]), abs=1e-9)


def test_greedy_clusters_equal_a_loop_over_all(spark):
    from moraine.operators import catalog

    r = random.Random(8)
    rows = [(k, r.randrange(0, 6000), r.uniform(20, 30), r.choice((r.uniform(80, 84), r.uniform(179, 180), r.uniform(-180, -179)))) for k in range(300)]

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    clusters = []
    for row in sorted(rows, key=lambda x: (x[1], x[0])):
        for c in reversed(clusters):
            if any(row[1] - m[1] <= 180 and km(row, m) <= 100 for m in c):
                c.append(row)
                break
        else:
            clusters.append([row])
    want = {m[0]: c[0][0] for c in clusters for m in c}
    df = spark.createDataFrame(rows, "id long, t long, lat double, lon double")
    try:
        for batch in (10_000, 7):  # a region that is cut into many batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert {x.id: x.cluster for x in catalog.greedy_clusters(df, 180, 100.0).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 1 < max(len(c) for c in clusters)


def test_clusters_remember_the_last_seconds_alone():
    from moraine.operators import catalog

    state = catalog.Clusters(180, 100.0)
    r = np.random.default_rng(1)
    for k in range(50):
        t = np.sort(r.uniform(k * 1000, (k + 1) * 1000, 400))
        state.take(t, r.uniform(20, 21, 400), r.uniform(80, 81, 400), np.arange(400) + 400 * k)
        assert all(len(x) < 120 for x in state.held)


def test_seasonal_fit_is_causal_and_exact(spark):
    from moraine.operators import watch

    t = np.arange(0, 1500, 12.0)
    season = 5 * np.cos(2 * np.pi * t / 365.25) + 2 * np.sin(4 * np.pi * t / 365.25)
    rows = [(1, float(a), float(0.01 * a + s), 0.9) for a, s in zip(t, season)] + [(2, float(a), float(s), 0.9) for a, s in zip(t[:5], season)]
    c = watch.WatchConfig(first_step=720, last_step=1440, every=240)
    made = lambda rs: watch.deseasonalised(spark.createDataFrame(rs, "unit_id long, t double, v double, coh double"), c)
    got = {(x.unit_id, x.step, x.t): x.v for x in made(rows).collect()}
    for (unit, step, at), v in got.items():
        k = int(at / 12)
        assert v == pytest.approx(0.01 * at if unit == 1 else season[k], abs=1e-6)
    later = rows + [(1, 1500.0 + k, 9999.0, 0.9) for k in range(20)]
    assert {(x.unit_id, x.step, x.t): x.v for x in made(later).collect()} == pytest.approx(got)


def test_spectral_features_equal_the_transform_written_out(spark):
    from moraine.functions import signal

    x = np.random.default_rng(7).normal(size=50)
    k = np.arange(26)
    power = np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(50)) / 50) @ (x - x.mean())) ** 2 / 50
    power[1:-1] *= 2
    at = k / 50 * 4.0
    centre = (at * power).sum() / power.sum()
    assert signal.spectrum_summary(x, 4.0) == pytest.approx((power.sum(), at[power.argmax()], centre, np.sqrt(((at - centre) ** 2 * power).sum() / power.sum())))
