"""Causal walk-forward scoring of unit series: trailing regressions, robust z-scores, tiers.

Each sample is dealt to the steps whose trailing span holds it, so as-of selection is an
expression and one grouping instead of a range join; the copies are bounded by span / step.
A step never sees a later sample, and history is earlier steps only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.checkpoints import cut
from moraine.functions import quantiles as Q
from moraine.functions.hazard import tier


@dataclass(frozen=True)
class WatchConfig:
    """Days, counts and floors; the defaults are those of multi-year monthly series."""

    slope_days: float = 180.0
    span_days: float = 730.0
    min_samples: int = 24
    min_history: int = 8
    min_coherence: float = 0.30
    min_sensitivity: float = 0.30
    first_step: int = 0
    last_step: int = 0
    every: int = 30
    year_days: float = 365.25


def month_starts(first: Column, last: Column) -> Column:
    """The first day of every month within [first, last]."""
    start = F.when(F.dayofmonth(first) == 1, first).otherwise(F.add_months(F.trunc(first, "month"), 1))
    return F.when(start <= last, F.sequence(start, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def at_steps(samples: DataFrame, config: WatchConfig) -> DataFrame:
    """samples (unit_id, t, v, coh) once for each step whose (step - span, step] holds them."""
    last = F.lit(config.last_step).cast("long")
    start = F.greatest(F.lit(config.first_step).cast("long"), F.lit(config.first_step) + F.ceil((F.col("t") - config.first_step) / config.every) * config.every)
    end = F.least(last, F.lit(config.first_step) + F.ceil((F.col("t") + config.span_days - config.first_step) / config.every) * config.every - config.every)
    return samples.withColumn("step", F.explode(F.when(start <= end, F.sequence(start, end, F.lit(config.every).cast("long")))))


def trailing_slope(v: Column, t: Column, low: Column, high: Column, year: float) -> Column:
    """Aggregate: least squares slope a year over (low, high]; null below three samples or without a time span."""
    inside = (t > low) & (t <= high) & v.isNotNull()
    x = F.when(inside, t)
    enough = (F.count(x) >= 3) & (F.max(x) > F.min(x))
    return F.when(enough, year * F.regr_slope(F.when(inside, v), x))


def unit_states(dealt: DataFrame, units: DataFrame, config: WatchConfig) -> DataFrame:
    """Velocity, acceleration, counts and the first reason against scoring of each unit and step.

    Each unit has a row for each step, samples or not; the steps are a sequence, the units are
    joined once, on unit_id.
    """
    t, v, step = F.col("t"), F.col("v"), F.col("step")
    w = config.slope_days
    sums = dealt.groupBy("unit_id", "step").agg(
        F.count("v").alias("n_samples"),
        F.percentile(F.when(t > step - w, F.col("coh")), F.lit(0.5)).alias("median_coherence"),
        trailing_slope(v, t, step - w, step, config.year_days).alias("velocity"),
        trailing_slope(v, t, step - 2 * w, step - w, config.year_days).alias("before"),
    )
    steps = F.explode(F.sequence(F.lit(config.first_step).cast("long"), F.lit(config.last_step).cast("long"), F.lit(config.every).cast("long")))
    every = units.withColumn("step", steps).join(sums, ["unit_id", "step"], "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)).cast("long"))
    reason = (
        F.when(~F.col("inside"), "outside_footprint")
        .when(F.abs("sens") < config.min_sensitivity, "low_los_sensitivity")
        .when(F.col("n_samples") < config.min_samples, "too_few_samples")
        .when(F.coalesce(F.col("median_coherence"), F.lit(0.0)) < config.min_coherence, "low_coherence")
    )
    every = every.withColumn("acceleration", (F.col("velocity") - F.col("before")) / (w / config.year_days))
    return every.select("unit_id", "step", "n_samples", "median_coherence", "velocity", "acceleration", reason.alias("reason"))


def _against_history(states: DataFrame, x: str, past: Window, config: WatchConfig) -> DataFrame:
    """Adds the z-score zt_x of a value against the unit's own earlier values.

    The earlier values are one sorted array a row, as long as the steps; each intermediate is a
    column of its own, so that none is computed again for every element.
    """
    seen = states.withColumn("_seen", F.collect_list(F.when(F.col("reason").isNull(), F.col(x))).over(past))
    sorted_ = seen.withColumn("_seen", F.sort_array("_seen")).withColumn("_centre", Q.array_linear(F.col("_seen"), 0.5))
    off = sorted_.withColumn("_off", F.sort_array(F.transform("_seen", lambda y: F.abs(y - F.col("_centre")))))
    s = F.col("_seen")
    scaled = off.withColumn("_scale", Q.robust_scale(Q.array_linear(F.col("_off"), 0.5), Q.array_linear(s, 0.25), Q.array_linear(s, 0.75)))
    z = F.when(F.size(s) < config.min_history, 0.0).otherwise(Q.robust_z(F.col(x), F.col("_centre"), F.col("_scale")))
    return scaled.withColumn(f"zt_{x}", z).drop("_seen", "_centre", "_off", "_scale")


def peer_scales(states: DataFrame, *values: str) -> DataFrame:
    """(step, x_c, x_s of each value x): centre and scale over all measurable units, the scored one included."""
    free = states.where("reason is null")
    first = free.groupBy("step").agg(*[Q.linear(x, q).alias(f"{x}_{n}") for x in values for n, q in (("c", 0.5), ("q1", 0.25), ("q3", 0.75))])
    mad = free.join(F.broadcast(first), "step").groupBy("step").agg(*[F.percentile(F.abs(F.col(x) - F.col(f"{x}_c")), F.lit(0.5)).alias(f"{x}_mad") for x in values])
    scales = [F.col(f"{x}_c") for x in values] + [Q.robust_scale(F.col(f"{x}_mad"), F.col(f"{x}_q1"), F.col(f"{x}_q3")).alias(f"{x}_s") for x in values]
    return first.join(mad, "step").select("step", *scales)


def score(states: DataFrame, config: WatchConfig) -> DataFrame:
    """step, unit_id, tier, score and what they rest on, of each unit and step.

    Peers are a row for each step, and steps are bounded by the configuration, hence the broadcast.
    """
    past = Window.partitionBy("unit_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    states = cut(states)  # read for histories and twice for peers
    peers = F.broadcast(peer_scales(states, "velocity", "acceleration"))
    own = states.withColumn("history", F.count(F.when(F.col("reason").isNull(), 1)).over(past))
    for x in ("velocity", "acceleration"):
        own = _against_history(own, x, past, config)
    own = own.join(peers, "step", "left").withColumns({f"zs_{x}": Q.robust_z(F.col(x), F.col(f"{x}_c"), F.col(f"{x}_s")) for x in ("velocity", "acceleration")})
    reason = F.coalesce("reason", F.when(F.col("history") < config.min_history, "too_little_history"))
    value = F.greatest(F.least("zt_velocity", "zs_velocity"), F.least("zt_acceleration", "zs_acceleration"))
    out = own.withColumn("reason", reason).withColumn("score", F.when(F.col("reason").isNull(), value))
    return out.select("step", "unit_id", tier(F.col("score"), F.col("reason")).alias("tier"), "score", "velocity", "acceleration", "n_samples", "median_coherence", "reason")


def score_as_of(samples: DataFrame, units: DataFrame, config: WatchConfig, as_of: int, asked: DataFrame | None = None) -> DataFrame:
    """What ``score`` says of each unit on one day, from samples up to that day alone, with ``max_input_t``, the latest sample of all that was read.

    Steps go back from the day by ``every`` as far as the configuration's first. asked: unit_id; one that has no row in units is ``unit_not_in_view``.
    """
    steps = max(0, (as_of - config.first_step) // config.every)
    own = replace(config, first_step=as_of - steps * config.every, last_step=as_of)
    seen = samples.where(F.col("t") <= as_of)
    out = score(unit_states(at_steps(seen, own), units, own), own).where(F.col("step") == as_of)
    latest = F.broadcast(seen.agg(F.max("t").alias("max_input_t")))  # one row
    out = out.crossJoin(latest)
    if asked is None:
        return out
    gone = asked.join(units, "unit_id", "left_anti").select("unit_id", F.lit(as_of).cast("long").alias("step"), F.lit("insufficient").alias("tier"), F.lit("unit_not_in_view").alias("reason")).crossJoin(latest)
    return out.join(asked, "unit_id", "left_semi").unionByName(gone, allowMissingColumns=True)


def deseasonalised(samples: DataFrame, config: WatchConfig, orders: int = 2) -> DataFrame:
    """(unit_id, step, t, v, coh) with each step's own seasonal fit removed.

    At each step the fit of offset, rate and harmonics uses samples up to that step only; below
    seven finite samples the values pass unchanged. A unit's series is one group, its length
    bounded by the revisit time; units are spread over tasks.
    """
    year, first, last, every, span = config.year_days, config.first_step, config.last_step, config.every, config.span_days

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "v"], kind="stable")
        t, v, coh = (rows[c].to_numpy(float) for c in ("t", "v", "coh"))
        good = np.isfinite(v)
        centred = t - (t.mean() if len(t) else 0.0)
        angle = 2 * np.pi * t / year
        season = np.column_stack([f(k * angle) for k in range(1, orders + 1) for f in (np.cos, np.sin)])
        design = np.column_stack([np.ones(len(t)), centred, season])
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        for step in range(first, last + 1, every):
            # Rows are in the order of t: a step's are the first so many, and those of its span follow each other.
            n, start = np.searchsorted(t, (step, step - span), "right")
            upto = good[:n]
            left = v[start:n]
            if upto.sum() >= 7:
                left = left - season[start:n] @ np.linalg.lstsq(design[:n][upto], v[:n][upto], rcond=None)[0][2:]
            held.append((step, np.arange(start, n), left))
        at = np.concatenate([x for _, x, _ in held]) if held else np.empty(0, np.int64)
        steps = np.repeat([x for x, _, _ in held], [len(x) for _, x, _ in held]).astype(np.int64)
        left = np.concatenate([x for _, _, x in held]) if held else np.empty(0)
        return pd.DataFrame({"unit_id": rows["unit_id"].iloc[0], "step": steps, "t": t[at], "v": left, "coh": coh[at]})

    return samples.select("unit_id", "t", "v", "coh").groupBy("unit_id").applyInPandas(fit, "unit_id long, step long, t double, v double, coh double")


def step_counts(scored: DataFrame) -> DataFrame:
    """How many units have each tier at each step."""
    tiers = ("watch", "elevated", "quiet", "insufficient")
    return scored.groupBy("step").agg(*[F.count_if(F.col("tier") == x).alias(f"n_{x}") for x in tiers], F.max("score").alias("best_score"))


def unit_history(scored: DataFrame) -> DataFrame:
    """Of each unit: steps with a score, best tier, first watch step, reasons met."""
    rank = F.when(F.col("tier") == "watch", 3).when(F.col("tier") == "elevated", 2).when(F.col("tier") == "quiet", 1).otherwise(0)
    return scored.groupBy("unit_id").agg(
        F.count_if(F.col("reason").isNull()).alias("n_measurable"),
        F.element_at(F.array(*map(F.lit, ("insufficient", "quiet", "elevated", "watch"))), F.max(rank) + 1).alias("best_tier"),
        F.min(F.when(F.col("tier") == "watch", F.col("step"))).alias("first_watch_step"),
        F.count_distinct("reason").alias("n_reasons"),
    )
