"""Great-circle and unit-sphere expressions. The earth radius is always an argument."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .exprs import as_column

# The three radii in use and the length of a mile.
EARTH_MILES = 3958.7613
EARTH_MILES_ROUNDED = 3958.8
EARTH_KM = 6371.0088
KM_PER_MILE = 1.609344


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_MILES) -> Column:
    p1, p2 = F.radians(as_column(lat1)), F.radians(as_column(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(as_column(lon2) - as_column(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def sphere_x(lat, lon) -> Column:
    return F.cos(F.radians(as_column(lat))) * F.cos(F.radians(as_column(lon)))


def sphere_y(lat, lon) -> Column:
    return F.cos(F.radians(as_column(lat))) * F.sin(F.radians(as_column(lon)))


def sphere_z(lat) -> Column:
    return F.sin(F.radians(as_column(lat)))


def chord_of(distance: float, radius: float = EARTH_MILES) -> float:
    """Straight chord through the unit sphere for a surface distance."""
    return 2.0 * math.sin(min(distance / radius, math.pi) / 2.0)


def chord_col(distance, radius: float = EARTH_MILES) -> Column:
    return F.lit(2.0) * F.sin(F.least(as_column(distance) / F.lit(radius), F.lit(math.pi)) / 2)


def arc_of(chord, radius: float = EARTH_MILES) -> Column:
    """Surface distance for a chord."""
    clipped = F.greatest(F.least(as_column(chord), F.lit(2.0)), F.lit(0.0))
    return F.lit(2.0 * radius) * F.asin(clipped / 2)


def point_wkt(lon, lat) -> Column:
    return F.concat(F.lit("POINT ("), as_column(lon).cast("string"), F.lit(" "), as_column(lat).cast("string"), F.lit(")"))


# Fixed value: text form of a point, longitude first.
POINT_PATTERN = r"(?i)POINT\s*\(\s*(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)\s*\)"


def wkt_lon(text) -> Column:
    return F.regexp_extract(as_column(text), POINT_PATTERN, 1).try_cast("double")


def wkt_lat(text) -> Column:
    return F.regexp_extract(as_column(text), POINT_PATTERN, 2).try_cast("double")


def coverage_ring(lon, lat, miles, steps: int = 64, radius: float = EARTH_MILES_ROUNDED) -> Column:
    """Closed ring of ``steps + 1`` points at a fixed distance around a point."""
    phi, d = F.radians(as_column(lat)), as_column(miles) / F.lit(radius)

    def vertex(i: Column) -> Column:
        bearing = i * F.lit(2 * math.pi / steps)
        lat2 = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(bearing))
        east = F.sin(bearing) * F.sin(d) * F.cos(phi)
        north = F.cos(d) - F.sin(phi) * F.sin(lat2)
        lon2 = as_column(lon) + F.degrees(F.atan2(east, north))
        return F.struct(lon2.alias("x"), F.degrees(lat2).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), vertex)
