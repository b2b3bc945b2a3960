"""Scores: decay, intervals of proportions, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(positive: Column, total: Column) -> Column:
    """Lower bound of the Wilson interval; 0 without observations; positives are kept within 0 and the total."""
    n = total.cast("double")
    p = F.greatest(F.lit(0.0), F.least(positive.cast("double"), n)) / n
    centre, spread = p + Z * Z / (2 * n), Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - spread) / (1 + Z * Z / n)))


def half_life(age_days: Column, days: float) -> Column:
    """0.5 to the power of age over half-life; 1 for ages that are not positive or not known."""
    return F.when(age_days > 0, F.pow(F.lit(0.5), age_days / days)).otherwise(1.0)


def decayed(weight: Column, age_days: Column, days: float = 90.0) -> Column:
    return weight * F.exp(-age_days / days)


def great_circle_km(lat: Column, lng: Column, lat0: Column, lng0: Column) -> Column:
    """Spherical law of cosines with radius 6371; the cosine is kept within 1, as identical points round above it."""
    cosine = F.sin(F.radians(lat)) * F.sin(F.radians(lat0)) + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * F.cos(F.radians(lng - lng0))
    return 6371 * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def haversine_km(lat: Column, lng: Column, lat0: Column, lng0: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * F.pow(F.sin(F.radians(lng - lng0) / 2), 2)
    return 2 * 6371 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
