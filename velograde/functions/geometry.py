"""Map projection as column expressions: longitude and latitude to Lambert-93 (EPSG:2154)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from velograde.functions.physics import checked, finite

#: Fixed values of EPSG:2154: eccentricity, exponent, constant, false easting and northing, origin.
E, N, C = 0.0818191910428158, 0.7256077650532670, 11754255.426096
EASTING, NORTHING, ORIGIN = 700000.0, 12655612.049876, math.radians(3.0)


def valid_lonlat(lon: Column, lat: Column) -> Column:
    return finite(lon) & finite(lat) & lon.between(-180.0, 180.0) & (lat > -90.0) & (lat < 90.0)


def lambert93(lon: Column, lat: Column, strict: bool = False) -> Column:
    """struct<x, y> in metres; null (or an error if strict) outside the valid range."""
    phi = F.radians(lat)
    s = E * F.sin(phi)
    iso = F.ln(F.tan(F.lit(math.pi / 4) + phi / 2) * F.pow((1 - s) / (1 + s), F.lit(E / 2)))
    radius, angle = C * F.exp(-N * iso), N * (F.radians(lon) - ORIGIN)
    point = F.struct((EASTING + radius * F.sin(angle)).alias("x"), (NORTHING - radius * F.cos(angle)).alias("y"))
    ok = valid_lonlat(lon, lat)
    return checked(point, ok, "longitude or latitude is outside its range") if strict else F.when(ok, point)
