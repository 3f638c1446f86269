"""Distances. Two Earth radii are in use, and a planar rule for rain grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skywharf.schema import EARTH_RADIUS_KM, REFERENCE_POINTS


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    inner = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(inner))


def planar_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def distance_to_points(lat: Column, lon: Column, points=REFERENCE_POINTS, radius: float = EARTH_RADIUS_KM) -> Column:
    """Smallest distance to a few fixed points, as one expression instead of a cross join."""
    distances = [haversine_km(lat, lon, F.lit(p_lat), F.lit(p_lon), radius) for _, p_lon, p_lat in points]
    return distances[0] if len(distances) == 1 else F.least(*distances)
