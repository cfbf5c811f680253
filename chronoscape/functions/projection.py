"""Map projections as column expressions: transverse Mercator zones (UTM), spherical Mercator and degrees, by EPSG code.

The transverse Mercator series in the third flattening n is exact to far below a millimetre within a zone and some
degrees around it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import Grid, lat_of, lon_of, x_of, y_of

# The WGS 84 ellipsoid, scale and false origin of UTM.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0
DEGREES, MERCATOR = 4326, 3857

N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Radius of the sphere of equal meridian length.
RECTIFYING = MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Coefficients of the series in N, first to fourth: to the plane, back, and from conformal to true latitude.
TO_PLANE = (
    N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3 + 41 / 180 * N**4,
    13 / 48 * N**2 - 3 / 5 * N**3 + 557 / 1440 * N**4,
    61 / 240 * N**3 - 103 / 140 * N**4,
    49561 / 161280 * N**4,
)
FROM_PLANE = (
    N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3 - 1 / 360 * N**4,
    1 / 48 * N**2 + 1 / 15 * N**3 - 437 / 1440 * N**4,
    17 / 480 * N**3 - 37 / 840 * N**4,
    4397 / 161280 * N**4,
)
TRUE_LATITUDE = (
    2 * N - 2 / 3 * N**2 - 2 * N**3 + 116 / 45 * N**4,
    7 / 3 * N**2 - 8 / 5 * N**3 - 227 / 45 * N**4,
    56 / 15 * N**3 - 136 / 35 * N**4,
    4279 / 630 * N**4,
)


def utm_zone(lon: float, lat: float) -> int:
    """EPSG code of the zone of a place."""
    return (32600 if lat >= 0 else 32700) + min(60, int((lon + 180) // 6) + 1)


def _zone(epsg: int) -> tuple[float, float]:
    """Central meridian in degrees and false northing."""
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"no projection is known for EPSG:{epsg}")
    return epsg % 100 * 6 - 183.0, UTM_SOUTH if epsg > 32700 else 0.0


def _added(xi: Column, eta: Column, coefficients: tuple[float, ...], sign: int) -> tuple[Column, Column]:
    x, y = xi, eta
    for j, c in enumerate(coefficients, 1):
        x = x + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * (sign * c)
        y = y + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * (sign * c)
    return x, y


def to_plane(epsg: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y of a place in degrees."""
    if epsg == DEGREES:
        return lon, lat
    if epsg == MERCATOR:
        return x_of(lon), y_of(lat)
    meridian, north = _zone(epsg)
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * ECCENTRICITY) * ECCENTRICITY)  # tangent of the conformal latitude
    xi, eta = _added(F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1)), TO_PLANE, 1)
    return eta * (UTM_SCALE * RECTIFYING) + UTM_EAST, xi * (UTM_SCALE * RECTIFYING) + north


def from_plane(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place in the plane."""
    if epsg == DEGREES:
        return x, y
    if epsg == MERCATOR:
        return lon_of(x), lat_of(y)
    meridian, north = _zone(epsg)
    xi, eta = _added((y - north) / (UTM_SCALE * RECTIFYING), (x - UTM_EAST) / (UTM_SCALE * RECTIFYING), FROM_PLANE, -1)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, c in enumerate(TRUE_LATITUDE, 1):
        phi = phi + F.sin(chi * (2 * j)) * c
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + meridian, F.degrees(phi)


@dataclass(frozen=True)
class Raster:
    """A raster's place in the plane: x = x0 + col * dx, y = y0 + row * dy at the corners of pixels (dy is usually negative)."""

    epsg: int
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int

    @classmethod
    def of_grid(cls, grid: Grid) -> Raster:
        return cls(MERCATOR, grid.x0, grid.y0, grid.scale, -grid.scale, grid.width, grid.height)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return (col + 0.5) * self.dx + self.x0, (row + 0.5) * self.dy + self.y0

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of the pixel that holds a place of the plane, whether or not the raster reaches so far."""
        return F.floor((y - self.y0) / self.dy).cast("int"), F.floor((x - self.x0) / self.dx).cast("int")
