"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres; null if any coordinate is."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    a = half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) ** 2
    return 2 * RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))
