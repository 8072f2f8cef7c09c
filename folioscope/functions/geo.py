"""Distances and boxes on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the earth and metres in a degree of latitude.
EARTH_RADIUS = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def encode(value: Column, span: float) -> Column:
    """A coordinate as a 32-bit integer; ``span`` is 180 for latitudes, 360 for longitudes."""
    return F.floor(F.least((value + span / 2) / span * 4294967296.0, F.lit(4294967295.0)) - 2147483648.0).cast("int")


def decode(code: Column, span: float) -> Column:
    return (code.cast("double") + 2147483648.0) / 4294967296.0 * span - span / 2
