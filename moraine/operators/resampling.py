"""Uncertainty of an inversion by resampling its stations over additive normal equations.

A trace is read once. What it adds to the normal equations is summed by station and variant (a depth, a band or
any other way the kernels and the data were prepared), and a draw is a weighted sum of those: as many times
a station as it was drawn. So the work of a draw depends on the number of stations and unknowns, not of samples.

Draws are a pure function of the seed, the group and the draw's number: hashes decide what is drawn, so reruns, other
partitions and other draws don't change a draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import hazard, quantiles
from moraine.operators import force
from moraine.operators.inversion import design

CHUNK_DRAWS = 25
COMPONENTS = ("up", "north", "east")


def uniform(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 11) / F.lit(float(1 << 53))


def station_equations(traces: DataFrame, keys: list[str], n_basis: int) -> DataFrame:
    """keys, ``cells`` (AtA row by row, then Atd, then the energy of the data) and the number of traces of each combination of keys.

    traces: keys, kernels (one array for each of up, north and east), data and weight. Rows whose arrays are null or of different lengths
    add nothing. Tasks send one row a key and batch, of a fixed size.
    """
    n = n_basis * len(COMPONENTS)
    kinds = dict(traces.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", cells array<double>, n_traces long"

    def add(batches):
        for batch in batches:
            rows = []
            for key, held in batch.groupby(keys, sort=False, dropna=False):
                total, count = np.zeros(n * n + n + 1), 0
                for kernels, data, weight in zip(held["kernels"], held["data"], held["weight"]):
                    if data is None or kernels is None or any(k is None or len(k) != len(data) for k in kernels) or len(kernels) != len(COMPONENTS) or not np.isfinite(weight):
                        continue
                    d = np.asarray(data, float) * weight
                    a = np.hstack([design(np.asarray(k, float), n_basis) for k in kernels]) * weight
                    total += np.concatenate(((a.T @ a).ravel(), a.T @ d, [d @ d]))
                    count += 1
                rows.append((*key, total.tolist(), count))
            yield pd.DataFrame(rows, columns=[*keys, "cells", "n_traces"])

    def join(held: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.asarray(x) for x in held["cells"]], 0)
        return pd.DataFrame([(*held[keys].iloc[0], total.tolist(), int(held["n_traces"].sum()))], columns=[*keys, "cells", "n_traces"])

    return traces.select(*keys, "kernels", "data", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")).mapInPandas(add, schema).groupBy(*keys).applyInPandas(join, schema)


def plans(stations: DataFrame, group: str, draws: int, variants: list, seed: int, damping: float, jitter: float, friction: tuple[float, float]) -> DataFrame:
    """group, draw, the stations drawn (with repeats), the variant, the damping (within a factor ``jitter``) and the friction of every draw. stations: group, n."""
    rows = stations.select(group, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    own = lambda what: uniform(seed, F.col(group), F.col("draw"), F.lit(what))
    picks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.floor(uniform(seed, F.col(group), F.col("draw"), F.lit("station"), k) * F.col("n")).cast("int"))
    return rows.select(
        group, "draw", picks.alias("picks"), F.element_at(F.array(*[F.lit(v) for v in variants]), F.floor(own("variant") * len(variants)).cast("int") + 1).alias("variant"),
        (F.lit(damping) * F.exp((2 * own("damping") - 1) * math.log(jitter))).alias("damping"), (F.lit(friction[0]) + own("friction") * (friction[1] - friction[0])).alias("friction"),
    )


def solved(total: np.ndarray, n: int, damping: float) -> tuple[np.ndarray, float]:
    """The damped solution of summed equations and the share of the data's energy that it explains."""
    ata, atd, energy = total[: n * n].reshape(n, n), total[n * n : n * n + n], total[-1]
    if not energy > 0:
        raise ValueError("the data drawn are silent")
    scale = np.trace(ata) / n
    if not scale > 0:
        raise ValueError("the kernels drawn are silent")
    x = np.linalg.solve(ata + damping * scale * np.eye(n), atd)
    return x, float(1 - (energy - 2 * x @ atd + x @ ata @ x) / energy)


def bootstrap(traces: DataFrame, group: str, station: str, variant: str, n_basis: int, variants: list, draws: int = 200, seed: int = 20260826, damping: float = 1e-2, jitter: float = 2.0, friction: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """group, draw, how many stations are in it, variant, damping, friction, variance_reduction, failure and the forces of each draw.

    Stations of a group are drawn with replacement, as many as there are. A draw that can't be solved has a failure and no forces.
    A task holds the equations of one group, a row for each station and variant, and ``CHUNK_DRAWS`` draws.
    """
    n = n_basis * len(COMPONENTS)
    kinds = dict(traces.dtypes)
    equations = station_equations(traces, [group, station, variant], n_basis)
    known = equations.select(group, station).distinct().groupBy(group).agg(F.count("*").cast("int").alias("n"))
    drawn = plans(known, group, draws, variants, seed, damping, jitter, friction).withColumn("chunk", F.floor(F.col("draw") / CHUNK_DRAWS))
    sent = equations.select(F.col(group).alias("_group"), F.col(station).alias("_station"), F.col(variant).alias("_variant"), "cells", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // CHUNK_DRAWS))).alias("_chunk"))
    schema = f"`{group}` {kinds[group]}, draw int, n_stations int, variant {kinds[variant]}, damping double, friction double, variance_reduction double, failure string, forces array<struct<up:double,north:double,east:double>>"

    def run(plan: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        # Stations in their own order; what a station lacks of a variant adds nothing.
        place = {s: k for k, s in enumerate(sorted(held["_station"].unique()))}
        parts = {v: np.zeros((len(place), n * n + n + 1)) for v in held["_variant"].unique()}
        for s, v, cells in zip(held["_station"], held["_variant"], held["cells"]):
            parts[v][place[s]] = cells
        out = []
        for p in plan.itertuples(index=False):
            times = np.bincount(np.asarray(p.picks, int), minlength=len(place)).astype(float)
            failure, reduction, forces = None, None, None
            try:
                x, reduction = solved(times @ parts[p.variant] if p.variant in parts else np.zeros(n * n + n + 1), n, p.damping)
                forces = [dict(zip(COMPONENTS, f)) for f in x.reshape(len(COMPONENTS), n_basis).T.tolist()]
            except (ValueError, np.linalg.LinAlgError) as e:
                failure = f"draw {p.draw}: {e}"
            out.append((getattr(p, group), p.draw, int((times > 0).sum()), p.variant, p.damping, p.friction, reduction, failure, forces))
        return pd.DataFrame(out, columns=[group, "draw", "n_stations", "variant", "damping", "friction", "variance_reduction", "failure", "forces"])

    return drawn.groupBy(group, "chunk").cogroup(sent.groupBy("_group", "_chunk")).applyInPandas(run, schema)


def draw_scalars(drawn: DataFrame, group: str, dt: float) -> DataFrame:
    """group, draw and the scalars of each draw that was solved: peak force, impulse, duration, azimuth and the two masses at its own friction; masses are null without a usable peak."""
    keyed = drawn.where("forces is not null").select(F.struct(group, "draw").alias("key"), "friction", "forces")
    rows = force.summarise(keyed, "key", "forces", dt).join(keyed.select("key", "friction"), "key")
    usable = (F.col("peak_force") > 0) & (F.col("impulse") > 0) & (F.col("acceleration_s") > 0) & (F.col("duration_s") > 0)
    none = F.lit(None).cast("double")
    angle, _ = force.path_angle(none, none, none, F.col("path_angle"))
    pull = hazard.effective_acceleration(angle, F.col("friction"))
    return rows.select(
        "key.*", "peak_force", "impulse", "duration_s", "azimuth", "friction",
        F.when(usable & (pull > 0), F.col("peak_force") / pull).alias("mass_force"), F.when(usable & (pull > 0), F.col("impulse") / F.col("acceleration_s") / pull).alias("mass_impulse"),
    )


def envelope(drawn: DataFrame, group: str) -> DataFrame:
    """group, i, component and the percentiles p05, p50 and p95 over draws, each sample for itself."""
    one = drawn.where("forces is not null").select(group, F.posexplode("forces").alias("i", "f"))
    long = one.select(group, "i", F.explode(F.create_map(*[x for c in COMPONENTS for x in (F.lit(c), F.col(f"f.{c}"))])).alias("component", "force"))
    return long.groupBy(group, "i", "component").agg(F.count("*").alias("n_draws"), *[quantiles.linear("force", q).alias(name) for name, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])


def intervals(scalars: DataFrame, group: str) -> DataFrame:
    """group, what, number of draws, p05, p50 and p95 of the scalars; an azimuth's are about its mean direction and aren't wrapped back."""
    names = ("peak_force", "impulse", "duration_s", "mass_force", "mass_impulse")
    long = scalars.select(group, F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("what", "x")).where("x is not null")
    plain = long.groupBy(group, "what").agg(F.count("*").alias("n_draws"), *[quantiles.linear("x", q).alias(p) for p, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])
    turned = force.circular_percentiles(scalars, [group], "azimuth").join(scalars.groupBy(group).agg(F.count("*").alias("n_draws")), group)
    return plain.unionByName(turned.select(group, F.lit("azimuth").alias("what"), "n_draws", "p5", "p50", "p95").withColumnRenamed("p5", "p05"))
