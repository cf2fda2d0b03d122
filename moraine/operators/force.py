"""Force histories: summaries, trajectories and mass estimates. A history is an array of structs (up, north, east) at equal steps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from moraine.functions import geo, hazard, quantiles
from moraine.operators import contracts

# Friction as a share of the slope's tangent, path angles and draws of the mass estimates.
FRICTION, FRICTION_STEPS = (0.2, 0.8), 33
PATH_ANGLE = (8.0, 55.0)


def samples(histories: DataFrame, key: str, force: str) -> DataFrame:
    """(key, i, up, north, east) of every sample."""
    return histories.select(key, F.posexplode(force).alias("i", "f")).select(key, "i", "f.*")


def summarise(histories: DataFrame, key: str, force: str, dt: float, onset: float = 0.05) -> DataFrame:
    """Peak force and running impulse with their places, onset, duration and acceleration time, mean azimuth and path angle of each history.

    The path angle is that of the force at the greatest horizontal force. A history without force has zeros and 90 degrees.
    """
    run = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = lambda *names: F.sqrt(sum(F.col(n) * F.col(n) for n in names))
    rows = samples(histories, key, force).withColumns({f"s_{n}": F.sum(n).over(run) * dt for n in ("up", "north", "east")})
    rows = rows.withColumns({"m": size("up", "north", "east"), "h": size("north", "east"), "r": size("s_up", "s_north", "s_east")}).withColumn("peak", F.max("m").over(Window.partitionBy(key)))
    first = lambda c: F.min_by("i", F.struct(-F.col(c), F.col("i")))
    loud = F.when(F.col("m") >= onset * F.col("peak"), F.col("i"))
    weight = F.col("m") * F.col("m")
    at = F.min_by(F.struct("up", "h"), F.struct(-F.col("h"), F.col("i")))
    out = rows.groupBy(key).agg(
        F.max("m").alias("peak_force"), first("m").alias("peak_index"), F.max("r").alias("impulse"), first("r").alias("impulse_index"), F.min(loud).alias("onset_index"), F.max(loud).alias("_last"),
        F.pmod(F.degrees(F.atan2(F.sum(F.col("east") * weight), F.sum(F.col("north") * weight))), F.lit(360.0)).alias("azimuth"), at.alias("_at"),
    )
    some = F.col("peak_force") > 0
    return out.select(
        key, "peak_force", F.when(some, F.col("peak_index")).otherwise(0).alias("peak_index"), F.when(some, F.col("impulse")).otherwise(0.0).alias("impulse"), F.when(some, F.col("impulse_index")).otherwise(0).alias("impulse_index"),
        F.when(some, F.col("onset_index")).otherwise(0).alias("onset_index"), F.when(some, (F.col("_last") - F.col("onset_index")) * dt).otherwise(0.0).alias("duration_s"),
        F.when(some, F.greatest(F.col("impulse_index") - F.col("onset_index"), F.lit(1)) * dt).otherwise(0.0).alias("acceleration_s"), F.when(some, F.col("azimuth")).otherwise(0.0).alias("azimuth"),
        F.when(some & (F.col("_at.h") > 0), F.degrees(F.atan2(F.abs("_at.up"), F.col("_at.h")))).otherwise(90.0).alias("path_angle"),
    )


def unit_displacement(histories: DataFrame, key: str, force: str, dt: float) -> DataFrame:
    """(key, drop, runout): where a unit mass ends, from acceleration against the force by two cumulative trapezoids."""
    w = Window.partitionBy(key).orderBy("i")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    step = lambda c: F.coalesce((F.col(c) + F.lag(c).over(w)) / 2 * dt, F.lit(0.0))
    names = ("up", "north", "east")
    rows = samples(histories, key, force).withColumns({n: -F.col(n) for n in names}).withColumns({f"d_{n}": step(n) for n in names})
    rows = rows.withColumns({f"v_{n}": F.sum(f"d_{n}").over(run) for n in names}).withColumns({f"e_{n}": step(f"v_{n}") for n in names})
    ends = rows.groupBy(key).agg(*[F.sum(f"e_{n}").alias(n) for n in names])
    return ends.select(key, (-F.col("up")).alias("drop"), F.sqrt(F.col("north") * F.col("north") + F.col("east") * F.col("east")).alias("runout"))


def mass_from_terrain(low: float = 1e7, high: float = 1e13, tolerance: float = 1e-3, most: int = 200):
    """UDF of (drop, runout, distances, drops): the mass at which a unit mass's path scaled by it falls as far as the ground does, by geometric bisection.

    Beyond the profile its far end counts. Null where the path neither falls nor travels or the bracket shows no change of sign.
    """

    def solve(drop: float, runout: float, x: np.ndarray, z: np.ndarray) -> float | None:
        def gap(mass: float) -> float:
            return drop / mass - float(np.interp(min(runout / mass, x[-1]), x, z))

        lo, hi = low, high
        at_low = gap(lo)
        if drop <= 0 or runout <= 0 or at_low * gap(hi) > 0:
            return None
        middle = (lo * hi) ** 0.5
        for _ in range(most):
            middle = (lo * hi) ** 0.5
            value = gap(middle)
            if abs(value) < tolerance * max(abs(drop / middle), 1.0):
                break
            if value * at_low > 0:
                lo, at_low = middle, value
            else:
                hi = middle
        return middle

    @pandas_udf("double")
    def found(drop: pd.Series, runout: pd.Series, distances: pd.Series, drops: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or x is None or len(x) == 0 else solve(a, b, np.asarray(x, float), np.asarray(z, float)) for a, b, x, z in zip(drop, runout, distances, drops)], dtype=float)

    return found


def path_angle(terrain: Column, drop: Column, runout: Column, force: Column) -> tuple[Column, Column]:
    """The angle in its allowed range, and where it comes from: terrain, a published drop and runout, or the force itself."""
    published = F.when(runout > 0, F.degrees(F.atan2(drop, runout)))
    angle = F.greatest(F.lit(PATH_ANGLE[0]), F.least(F.lit(PATH_ANGLE[1]), F.coalesce(terrain, published, force)))
    return angle, F.when(terrain.isNotNull(), "dem_trajectory").when(published.isNotNull(), "published").otherwise("force_history")


def mass_interval(numerator: Column, angle: Column) -> tuple[Column, Column, Column]:
    """5, 50 and 95 % of numerator over the acceleration at equally spaced frictions, made strict."""
    share = lambda k: FRICTION[0] + (FRICTION[1] - FRICTION[0]) * k / F.lit(FRICTION_STEPS - 1.0)
    masses = F.transform(F.sequence(F.lit(0), F.lit(FRICTION_STEPS - 1)), lambda k: numerator / hazard.effective_acceleration(angle, share(k)))
    return contracts.spread(*(quantiles.array_linear(masses, q) for q in (0.05, 0.5, 0.95)))


def estimates(summary: DataFrame, terrain: Column, drop: Column, runout: Column) -> DataFrame:
    """Both estimates of a mass (force over acceleration, impulse over velocity) and their union; nulls for a history that has no peak or impulse."""
    usable = (F.col("peak_force") > 0) & (F.col("impulse") > 0) & (F.col("acceleration_s") > 0) & (F.col("duration_s") > 0)
    angle, basis = path_angle(terrain, drop, runout, F.col("path_angle"))
    own, _ = path_angle(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("path_angle"))
    rows = summary.withColumns({"angle": angle, "basis": basis, "own": own})
    a = mass_interval(F.when(usable, F.col("peak_force")), F.col("angle"))
    b = mass_interval(F.when(usable, F.col("impulse") / F.col("acceleration_s")), F.col("own"))
    rows = rows.withColumns({f"{n}_{q}": x for n, found in (("force", a), ("impulse", b)) for q, x in zip(("p05", "p50", "p95"), found)})
    named = lambda n: tuple(F.col(f"{n}_{q}") for q in ("p05", "p50", "p95"))
    low, mid, high, ratio = contracts.union_interval(named("force"), named("impulse"))
    return rows.withColumns({"p05": low, "p50": mid, "p95": high, "ratio": ratio}).drop("own")


def circular_percentiles(rows: DataFrame, keys: list[str], degrees: str, levels: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Percentiles of angles about their mean direction, not wrapped back, so that an interval over north stays in order."""
    mean = rows.groupBy(*keys).agg(quantiles.circular_mean_deg(F.col(degrees)).alias("mean"))
    off = rows.join(mean, keys).withColumn("off", quantiles.wrapped_deg(F.col(degrees) - F.col("mean")))
    return off.groupBy(*keys, "mean").agg(*[quantiles.linear("off", q).alias(f"o{k}") for k, q in enumerate(levels)]).select(*keys, *[(F.col("mean") + F.col(f"o{k}")).alias(f"p{round(100 * q)}") for k, q in enumerate(levels)])


def station_weights(traces: DataFrame, group: str, x: str) -> DataFrame:
    """One over the root mean square of each trace, scaled to mean 1 in its group; a silent trace weighs 0."""
    power = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v) / F.size(x)
    rows = traces.withColumn("weight", F.coalesce(F.when(power > 0, 1 / F.sqrt(power)), F.lit(0.0)))
    total = rows.groupBy(group).agg((F.count("*") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("_scale"))
    return rows.join(total, group).withColumn("weight", F.col("weight") * F.coalesce("_scale", F.lit(1.0))).drop("_scale")


def refusal(n_stations: Column, gap_deg: Column, least: int = 5, most: float = 200.0) -> Column:
    """Why a geometry is refused, the first rule that fails; null if it isn't."""
    few = F.concat(F.lit("only "), n_stations.cast("string"), F.lit(f" station(s) contributed, below the minimum of {least}"))
    wide = F.concat(F.lit("azimuthal gap "), F.format_string("%.0f", gap_deg), F.lit(f" deg exceeds the limit of {most:.0f} deg"))
    return F.when(n_stations < least, few).when(gap_deg > most, wide)


def usable_channels(channels: DataFrame, group: str, near: float = 0.5, far: float = 15.0, factor: float = 20.0) -> DataFrame:
    """channels (group, distance_deg, amplitude) with ``dropped``: outside the distances, or above ``factor`` times the median of the positive amplitudes within."""
    inside = F.col("distance_deg").between(near, far)
    middle = channels.where(inside & (F.col("amplitude") > 0)).groupBy(group).agg(F.median("amplitude").alias("_m"))
    reason = F.when(~inside, "distance").when(F.col("amplitude") > factor * F.col("_m"), "glitch")
    return channels.join(middle, group, "left").withColumn("dropped", reason).drop("_m")


def trial_grid(sources: DataFrame, spacing_km: float, side: int, depths_m: tuple[float, ...]) -> DataFrame:
    """sources (latitude, longitude) with every trial location of a square grid about them, square on the ground."""
    half, degree = (side - 1) // 2, math.pi * geo.EARTH_KM / 180
    step = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    rows = sources.withColumn("i", step).withColumn("j", step).withColumn("depth_m", F.explode(F.array(*[F.lit(float(d)) for d in depths_m])))
    east = spacing_km / (degree * F.greatest(F.cos(F.radians("latitude")), F.lit(1e-6)))
    return rows.withColumns({"trial_latitude": F.col("latitude") + F.col("i") * spacing_km / degree, "trial_longitude": F.col("longitude") + F.col("j") * east})


def uncertainty_radius(nodes: DataFrame, key: str, score: str, distance: str, drop: float = 0.02) -> DataFrame:
    """How far from the best node others lie that fit nearly as well. ``distance`` is that to the best node."""
    best = Window.partitionBy(key)
    return nodes.withColumn("_best", F.max(score).over(best)).where(F.col(score) >= F.col("_best") - drop).groupBy(key).agg(F.max(distance).alias("radius"), F.count("*").alias("n_nodes"))
