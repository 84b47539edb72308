"""Transverse Mercator (UTM zone 20 north on GRS80, EPSG:2961), geographic (4326) and spherical Mercator (3857).

Krüger's series to the sixth order in the third flattening, as Column expressions; the shift between NAD83(CSRS) and WGS84
is not modelled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid and zone.
A, INVERSE_FLATTENING = 6378137.0, 298.257222101
LON0, SCALE, EAST, NORTH = -63.0, 0.9996, 500000.0, 0.0
SPHERE = 6378137.0

_f = 1 / INVERSE_FLATTENING
_n = _f / (2 - _f)
_e = math.sqrt(_f * (2 - _f))
RADIUS = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
# Coefficients of the series, in powers of n.
FORWARD = [
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
]
BACKWARD = [
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
]
LATITUDE = [
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
]


def to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees of easting and northing."""
    xi, eta = (y - NORTH) / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    xi1, eta1 = xi, eta
    for k, b in enumerate(BACKWARD, 1):
        xi1 = xi1 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta1 = eta1 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for k, d in enumerate(LATITUDE, 1):
        lat = lat + d * F.sin(2 * k * chi)
    return F.degrees(lat), F.lit(LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))


def from_geographic(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) of degrees."""
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - _e * F.atanh(_e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(FORWARD, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EAST + SCALE * RADIUS * x, NORTH + SCALE * RADIUS * y


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates as (x, y) or, for 4326, (longitude, latitude)."""
    if source == target:
        return x, y
    if {source, target} - {2961, 4326, 3857}:
        raise ValueError(f"no way from EPSG:{source} to EPSG:{target}; known are 2961, 4326 and 3857")
    lon, lat = x, y
    if source == 2961:
        lat, lon = to_geographic(x, y)
    elif source == 3857:
        lon, lat = F.degrees(x / SPHERE), F.degrees(2 * F.atan(F.exp(y / SPHERE)) - math.pi / 2)
    if target == 4326:
        return lon, lat
    if target == 2961:
        return from_geographic(lat, lon)
    return F.radians(lon) * SPHERE, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * SPHERE
