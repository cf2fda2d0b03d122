"""Hazard, damage, alert and interval formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers of a score; breach regression and wedge of a dam; standard gravity and that of closed forms.
ELEVATED, WATCH = 2.0, 3.0
BREACH_FACTOR, BREACH_POWER = 0.0026, 0.79
BED_SLOPE, LEAST_WIDTH_M, INDEX_BAND, INDEX_SCALE = 0.01, 30.0, 0.5, 0.4
GRAVITY = 9.81
STANDARD_GRAVITY = 9.80665
# Severity by largest stage (m) and urgency by earliest arrival (min).
SEVERITY = ((5.0, "Extreme"), (2.0, "Severe"), (0.5, "Moderate"), (0.0, "Minor"))
IMMEDIATE_MIN, EXPECTED_MIN = 30.0, 180.0


def tier(score: Column, reason: Column | None = None) -> Column:
    """Null and NaN come first: Spark orders NaN above every number."""
    gone = score.isNull() | F.isnan(score)
    gone = gone if reason is None else gone | reason.isNotNull()
    return F.when(gone, "insufficient").when(score >= WATCH, "watch").when(score >= ELEVATED, "elevated").otherwise("quiet")


def damage_fraction(depth: Column, scale: Column, shape: Column) -> Column:
    return F.when(depth <= 0, 0.0).otherwise(F.least(F.lit(1.0), 1 - F.exp(-F.pow(depth / scale, shape))))


def avoidable_share(lead_min: Column, threshold: float, full: float, most: float) -> Column:
    """A ramp from nothing at the threshold to ``most`` at the full lead time."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (lead_min - threshold) / (full - threshold))) * most


def damming_index(deposit: Column, channel: Column) -> Column:
    """Depth of the deposit as a share of the channel's."""
    return deposit / F.greatest(channel, F.lit(1e-6))


def dam_height(deposit: Column, channel: Column) -> Column:
    """A dam is no higher than its channel is deep."""
    return F.least(deposit, channel)


def wedge_volume(height: Column, width: Column) -> Column:
    """Water behind a dam of that height, a wedge over the bed's slope."""
    return 0.5 * height * height * F.greatest(width, F.lit(LEAST_WIDTH_M)) / BED_SLOPE


def damming_probability(index: Column) -> Column:
    """An uncalibrated logistic with its middle at index 1."""
    return logistic((index - 1) / INDEX_SCALE)


def breach_wave(volume: Column, height: Column) -> tuple[Column, Column, Column]:
    """Peak discharge, rise and total time of a triangle whose area is the volume."""
    volume = F.greatest(volume, F.lit(1.0))
    peak = BREACH_FACTOR * F.pow(volume * F.greatest(height, F.lit(0.1)), F.lit(BREACH_POWER))
    total = 2 * volume / F.greatest(peak, F.lit(1e-6))
    return peak, total / 3, total


def surge_travel_s(distance: Column, height: Column) -> Column:
    """Null at the dam and upstream of it."""
    return F.when(distance > 0, distance / (1.5 * F.sqrt(STANDARD_GRAVITY * F.greatest(height, F.lit(1.0)))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def signed_gap(x: Column, low: Column, high: Column) -> Column:
    """Distance to an interval, negative below it and 0 inside."""
    return F.when(x < low, x - low).when(x > high, x - high).otherwise(F.when(x.isNotNull(), 0.0))


def conformity(low: Column, high: Column, truth: Column) -> Column:
    return F.greatest(low - truth, truth - high)


def corrected(low: Column, high: Column, by: Column, floor: float | None = 0.0) -> tuple[Column, Column]:
    """The interval widened on both sides; one that crosses becomes its midpoint; clamped from below."""
    a, b = low - by, high + by
    middle = (a + b) / 2
    a, b = F.when(a > b, middle).otherwise(a), F.when(a > b, middle).otherwise(b)
    return (a, b) if floor is None else (F.greatest(a, F.lit(floor)), F.greatest(b, F.lit(floor)))


def pinball(prediction: Column, truth: Column, q: float) -> Column:
    d = truth - prediction
    return F.greatest(q * d, (q - 1) * d)


def severity(largest_stage_m: Column) -> Column:
    """Of a forecast, by the largest stage of its transects; unknown without one."""
    out = F.lit("Unknown")
    for least, name in reversed(SEVERITY):
        out = F.when(largest_stage_m >= least, name).otherwise(out)
    return out


def urgency(earliest_arrival_min: Column) -> Column:
    """Of a forecast, by the earliest arrival at its transects; unknown if it reaches none."""
    return F.when(earliest_arrival_min.isNull(), "Unknown").when(earliest_arrival_min <= IMMEDIATE_MIN, "Immediate").when(earliest_arrival_min <= EXPECTED_MIN, "Expected").otherwise("Future")


def in_season(day: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Month and day within a season, which may wrap over new year."""
    at = F.month(day) * 100 + F.dayofmonth(day)
    a, b = first[0] * 100 + first[1], last[0] * 100 + last[1]
    return (at >= a) & (at <= b) if a <= b else (at >= a) | (at <= b)


def terminal_velocity(depth: Column, slope_rad: Column, mu: Column, xi: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), xi * depth * (F.sin(slope_rad) - mu * F.cos(slope_rad))))


def dam_break_depth(x: Column, t: Column, depth: float) -> Column:
    """Analytic depth of an instantaneous dam break on a dry flat bed."""
    c = (GRAVITY * depth) ** 0.5
    return F.when(x <= -c * t, depth).when(x >= 2 * c * t, 0.0).otherwise(F.pow(2 * c - x / t, F.lit(2.0)) / (9 * GRAVITY))


def effective_acceleration(angle_deg: Column, friction: Column) -> Column:
    return F.greatest(GRAVITY * F.sin(F.radians(angle_deg)) * (1 - friction), F.lit(0.05))


def issue_delay_s(*parts: Column) -> Column:
    """Seconds until an alert, the sum of its parts; null if one of them is unknown."""
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def delivered_lead(arrival: tuple[Column, Column, Column], elapsed_min: Column) -> tuple[Column, Column, Column]:
    """Minutes from the message to the arrival (its ends in either order, best or null); may be negative."""
    a, b, best = arrival
    return F.least(a, b) - elapsed_min, F.greatest(a, b) - elapsed_min, best - elapsed_min


# Nearest permitted receiver, assumed speed of surface waves, start of a window before origin.
NEAREST_KM, WAVE_KM_S, LEAD_IN_S = 100.0, 3.0, 60.0


def detection_floor_s(record_s: Column) -> Column:
    """The earliest that any detector could decide: travel time and the record it needs, less the lead-in."""
    return NEAREST_KM / WAVE_KM_S + record_s - LEAD_IN_S


def log_parameter(x: Column) -> Column:
    """A parameter that was sampled by its logarithm."""
    return F.ln(F.greatest(x, F.lit(1e-12)))
