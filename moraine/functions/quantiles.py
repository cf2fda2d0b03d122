"""The three percentile conventions in use, robust scale and angles. They are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes MAD and IQR estimate a normal standard deviation.
MAD_TO_SIGMA, IQR_TO_SIGMA = 1.4826, 1.349


def linear(x: Column | str, q: float) -> Column:
    """Aggregate: linear interpolation between order statistics, nulls skipped."""
    return F.percentile(x, F.lit(q))


def array_linear(values: Column, q: float) -> Column:
    """The same over an array that is sorted and holds no null; null if it is empty."""
    place = (F.size(values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(place).cast("int"))
    return F.when(F.size(values) > 0, a + (b - a) * (place - low))


def conformal_rank(n: Column, level: float) -> Column:
    """Place, from 1, of the conservative order statistic: ceil((n + 1) level), at most n."""
    return F.least(n, F.ceil((n + 1) * F.lit(level))).cast("long")


def index_pick(values: Column, q: float) -> Column:
    """Latency reports: the element at floor(n q), at most the last, of a sorted array; no interpolation."""
    return F.when(F.size(values) > 0, F.get(values, F.least(F.size(values) - 1, F.floor(F.size(values) * F.lit(q)).cast("int"))))


def robust_scale(mad: Column, q1: Column, q3: Column) -> Column:
    """Scaled MAD, else scaled IQR, else 0."""
    return F.when(mad > 0, mad * MAD_TO_SIGMA).when(q3 > q1, (q3 - q1) / IQR_TO_SIGMA).otherwise(F.lit(0.0))


def robust_z(x: Column, centre: Column, scale: Column) -> Column:
    """(x - centre) / scale; 0 where there is no value or no spread."""
    return F.when((scale > 0) & x.isNotNull() & centre.isNotNull(), (x - centre) / scale).otherwise(F.lit(0.0))


def circular_mean_deg(degrees: Column) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    mean = F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))
    return F.pmod(mean, F.lit(360.0))


def wrapped_deg(degrees: Column) -> Column:
    """An angle's difference, taken into [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0
