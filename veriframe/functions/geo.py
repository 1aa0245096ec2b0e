"""Geographic columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriframe import config


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    )
    return 2 * config.EARTH_RADIUS_M * F.asin(F.sqrt(half))


def meters(distance: Column) -> Column:
    """Whole meters, half up."""
    return F.floor(distance + 0.5).cast("bigint")


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(
        lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
        & (F.abs(lat) <= 90) & (F.abs(lon) <= 180),
        F.lit(False),
    )


def valid_gps(lat: Column, lon: Column) -> Column:
    """Camera position: (0, 0) means "no fix"."""
    return valid_point(lat, lon) & ((lat != 0) | (lon != 0))
