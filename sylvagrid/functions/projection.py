"""Transverse Mercator on the GRS80 ellipsoid as column expressions (Krueger's series, third order)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 axis and flattening, UTM scale and false easting.
AXIS = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
EASTING = 500000.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240]
BETA = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480]
DELTA = [2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15]
ECC = 2 * math.sqrt(N) / (1 + N)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) of geographic degrees."""
    phi, dl = F.radians(lat), F.radians(lon) - central_meridian(zone)
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1.0 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return EASTING + SCALE * RADIUS * east, SCALE * RADIUS * north


def from_utm(easting: Column, northing: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi = northing / (SCALE * RADIUS)
    eta = (easting - EASTING) / (SCALE * RADIUS)
    x, e = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        e = e - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2.0 * j * chi)
    return F.degrees(central_meridian(zone) + F.atan2(F.sinh(e), F.cos(x))), F.degrees(phi)
