"""Spherical and radar geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in km; first eccentricity squared of WGS 84.
EARTH_KM = 6371.0088
ECC2 = 0.00669437999014


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first to the second point in [0, 360)."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def geocentric_lat(lat: Column) -> Column:
    return F.degrees(F.atan((1 - ECC2) * F.tan(F.radians(lat))))


def geocentric_distance_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.degrees(haversine_km(geocentric_lat(lat1), lon1, geocentric_lat(lat2), lon2) / EARTH_KM)


def los_unit_vector(incidence: Column, heading: Column) -> tuple[Column, Column, Column]:
    """East, north and up of the direction from ground to a right-looking satellite."""
    look = F.radians(heading - 90.0)
    s = F.sin(F.radians(incidence))
    return s * F.sin(look), s * F.cos(look), F.cos(F.radians(incidence))


def downslope_vector(slope: Column, aspect: Column) -> tuple[Column, Column, Column]:
    c = F.cos(F.radians(slope))
    return c * F.sin(F.radians(aspect)), c * F.cos(F.radians(aspect)), -F.sin(F.radians(slope))


def los_sensitivity(slope: Column, aspect: Column, incidence: Column, heading: Column) -> Column:
    """How much of a downslope movement is seen along the line of sight, 0 to 1."""
    u, d = los_unit_vector(incidence, heading), downslope_vector(slope, aspect)
    return F.abs(u[0] * d[0] + u[1] * d[1] + u[2] * d[2])


def local_incidence_deg(slope: Column, aspect: Column, incidence: Column, heading: Column) -> Column:
    u = los_unit_vector(incidence, heading)
    s, c = F.sin(F.radians(slope)), F.cos(F.radians(slope))
    dot = u[0] * s * F.sin(F.radians(aspect)) + u[1] * s * F.cos(F.radians(aspect)) + u[2] * c
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def layover_shadow(slope: Column, aspect: Column, incidence: Column, heading: Column) -> tuple[Column, Column]:
    """Whether the slope's dip along the look direction exceeds the incidence, or faces away beyond the horizon."""
    toward = F.cos(F.radians(aspect - (heading - 90.0)))
    dip = F.degrees(F.atan(F.tan(F.radians(slope)) * toward))
    return dip >= incidence, dip <= incidence - 90.0


def region(lat: Column, lon: Column, boxes: list[tuple[str, float, float, float, float]]) -> Column:
    """The first box (name, south, north, west, east) that holds the point; west > east crosses the date line."""
    out = F.lit("other")
    for name, south, north, west, east in reversed(boxes):
        across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
        out = F.when((lat >= south) & (lat <= north) & across, F.lit(name)).otherwise(out)
    return out


def snapped_box(west: Column, south: Column, east: Column, north: Column, resolution: float, buffer: float = 0.0) -> tuple[Column, ...]:
    """The box grown outward to multiples of the resolution."""
    low = lambda x: F.floor((x - buffer) / resolution) * resolution
    high = lambda x: F.ceil((x + buffer) / resolution) * resolution
    return low(west), low(south), high(east), high(north)


def offsets_deg(km: float, lat: float) -> tuple[float, float]:
    """Degrees of latitude and longitude that hold at least so many km up to that latitude."""
    step = math.degrees(km / EARTH_KM) * 1.0001
    return step, min(360.0, step / max(1e-6, math.cos(math.radians(min(89.9, abs(lat) + step)))))
