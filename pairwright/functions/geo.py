"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
FLATTENING = 1.0 / 298.257223563
EQUATOR_RADIUS_M = 6378137.0


def geo_distance(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, ellipsoid: bool = False
) -> Column:
    """Metres between two points; null when a coordinate is null.

    The default is the great-circle (haversine) distance, which differs from the distance
    on the ellipsoid by up to about 0.5 %. ``ellipsoid`` adds the first-order flattening
    term of Andoyer and Lambert, which brings the error to some tens of metres per 1000 km.
    """
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    if not ellipsoid:
        return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(_half_chord(phi1, phi2, lon1, lon2)))
    beta1 = F.atan((1.0 - FLATTENING) * F.tan(phi1))
    beta2 = F.atan((1.0 - FLATTENING) * F.tan(phi2))
    sigma = 2.0 * F.asin(F.sqrt(_half_chord(beta1, beta2, lon1, lon2)))
    mean, half = (beta1 + beta2) / 2.0, (beta2 - beta1) / 2.0
    squared = lambda c: c * c
    plus = (sigma - F.sin(sigma)) * squared(F.sin(mean) * F.cos(half)) / squared(F.cos(sigma / 2))
    minus = (sigma + F.sin(sigma)) * squared(F.cos(mean) * F.sin(half)) / squared(F.sin(sigma / 2))
    corrected = EQUATOR_RADIUS_M * (sigma - FLATTENING / 2.0 * (plus + minus))
    return F.when(sigma == 0, F.lit(0.0)).otherwise(corrected)


def _half_chord(phi1: Column, phi2: Column, lon1: Column, lon2: Column) -> Column:
    dphi = F.sin((phi2 - phi1) / 2.0)
    dlam = F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    return F.least(F.lit(1.0), dphi * dphi + F.cos(phi1) * F.cos(phi2) * dlam * dlam)
