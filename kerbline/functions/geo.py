"""Distance and coordinate expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
ROAD_FACTOR = 1.25
CITY_SPEED_KMH = 25.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, clamp: bool = False) -> Column:
    """Great-circle kilometres. ``clamp`` keeps the angle inside [0, 1] against rounding."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    angle = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    if clamp:
        angle = F.least(F.lit(1.0), F.greatest(F.lit(0.0), angle))
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(angle), F.sqrt(1 - angle))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2, clamp=True) * 1000


def round_km(km: Column) -> Column:
    """Kilometres as DECIMAL(8,2), half up."""
    return km.cast("decimal(20,10)").cast("decimal(8,2)")


def metres(km: Column) -> Column:
    """Whole metres, half up."""
    return F.round(km.cast("decimal(20,10)") * 1000, 0).cast("bigint")


def city_road_estimate(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column]:
    """Road kilometres and whole minutes at city speed; minutes come from the unrounded kilometres."""
    km = F.greatest(F.lit(0.1), haversine_km(lat1, lng1, lat2, lng2) * ROAD_FACTOR)
    minutes = F.greatest(F.lit(1), F.ceil(km / CITY_SPEED_KMH * 60)).cast("int")
    return round_km(km), minutes


Estimate = Callable[[Column, Column, Column, Column], tuple[Column, Column]]
DISTANCE_STRATEGIES: dict[str, Estimate] = {"city_road": city_road_estimate}


def register_distance_strategy(name: str, estimate: Estimate) -> None:
    DISTANCE_STRATEGIES[name] = estimate


def valid_point(lat: Column, lng: Column) -> Column:
    """False, never null, for a missing or out-of-range coordinate."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def inside_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])
