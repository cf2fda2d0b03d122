"""Resampled inversions against re-inversion of the traces that each draw repeats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.operators import resampling
from moraine.operators.inversion import design
from moraine.plans import terrain

SMALL = "/root/testdata/sf0.01"


def rows(df):
    return {(r.label, r.draw): r for r in df.collect()}


def test_draws_equal_inversion_of_the_repeated_traces(spark):
    traces = terrain.traces(spark, SMALL)
    held = traces.where("label = 3").collect()
    got = rows(resampling.bootstrap(traces, "label", "station", "depth_m", 4, [500.0, 2000.0], draws=40))
    known = traces.groupBy("label").agg(F.count_distinct("station").cast("int").alias("n"))
    plans = rows(resampling.plans(known, "label", 40, [500.0, 2000.0], 20260826, 1e-2, 2.0, (0.2, 0.8)))
    stations = sorted({t.station for t in held})
    assert len(got) == 400
    for draw in range(40):
        plan, found = plans[3, draw], got[3, draw]
        drawn = [t for k in plan.picks for t in held if t.station == stations[k] and t.depth_m == plan.variant]
        a = np.vstack([np.hstack([design(np.array(k), 4) for k in t.kernels]) for t in drawn])
        d = np.concatenate([t.data for t in drawn])
        damped = plan.damping * np.trace(a.T @ a) / 12
        x = np.linalg.solve(a.T @ a + damped * np.eye(12), a.T @ d)
        assert [f[c] for c in resampling.COMPONENTS for f in found.forces] == pytest.approx(x.tolist(), abs=1e-9)
        assert found.variance_reduction == pytest.approx(1 - ((d - a @ x) ** 2).sum() / (d @ d)) and found.n_stations == len(set(plan.picks))
        assert 0.005 <= plan.damping <= 0.02 and 0.2 <= plan.friction <= 0.8


def test_draws_do_not_depend_on_partitions_or_other_draws(spark):
    traces = terrain.traces(spark, SMALL)
    key = lambda df: {k: [tuple(f) for f in r.forces] for k, r in rows(df).items()}
    a = key(resampling.bootstrap(traces, "label", "station", "depth_m", 4, [500.0, 2000.0], draws=7))
    b = key(resampling.bootstrap(traces.repartition(13), "label", "station", "depth_m", 4, [500.0, 2000.0], draws=30))
    assert all(np.allclose(v, b[k]) for k, v in a.items()) and len(a) == 70
    other = key(resampling.bootstrap(traces, "label", "station", "depth_m", 4, [500.0, 2000.0], draws=7, seed=1))
    assert not np.allclose(other[0, 0], a[0, 0])


def test_planted_forces_lie_within_the_envelope(spark):
    found = terrain.bootstrap_forces(spark, SMALL).collect()
    assert len(found) == 10 * 4 * 3
    within = [r.p05 - 0.05 <= r.planted <= r.p95 + 0.05 for r in found]
    assert np.mean(within) > 0.9 and all(r.p05 <= r.p50 <= r.p95 and r.n_draws == 200 for r in found)


def test_silent_traces_fail_and_others_go_on(spark):
    zero, one = [0.0] * 8, [1.0, -1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0]
    data = [("silent", "a", 1, zero, [zero] * 3, 1.0), ("silent", "b", 1, zero, [one] * 3, 1.0), ("odd", "a", 1, None, [one] * 3, 1.0), ("odd", "b", 1, one, None, 1.0), ("odd", "c", 1, one, [one, one], 1.0), ("odd", "d", 1, one, [one, one, one[::-1]], None), ("fine", "a", 1, one, [one, one[::-1], zero], 2.0)]
    df = spark.createDataFrame(data, "label string, station string, depth int, data array<double>, kernels array<array<double>>, weight double")
    drawn = resampling.bootstrap(df, "label", "station", "depth", 2, [1], draws=5).collect()
    assert len(drawn) == 15
    assert all((r.failure is None) == (r.label == "fine") == (r.forces is not None) for r in drawn) and all("silent" in r.failure for r in drawn if r.failure)
    scalars = resampling.draw_scalars(spark.createDataFrame(drawn, resampling.bootstrap(df, "label", "station", "depth", 2, [1], draws=5).schema), "label", 1.0).collect()
    assert {r.label for r in scalars} == {"fine"} and len(scalars) == 5
    none = df.where("label = 'nobody'")
    assert resampling.bootstrap(none, "label", "station", "depth", 2, [1], draws=5).count() == 0


def test_intervals_of_scalars(spark):
    out = terrain.bootstrap_intervals(spark, SMALL).collect()
    assert {r.what for r in out} == {"peak_force", "impulse", "duration_s", "azimuth", "mass_force", "mass_impulse"}
    assert all(r.p05 <= r.p50 <= r.p95 for r in out) and len(out) == 60
