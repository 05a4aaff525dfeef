"""Planar and map-projection expressions on coordinate columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the universal transverse Mercator grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500_000.0
FALSE_NORTHING_SOUTH = 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Third-order Krueger series: forward, inverse and conformal latitude.
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = ((px - x1) * dx + (py - y1) * dy) / length2
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))).otherwise(0.0)
    ex, ey = x1 + t * dx - px, y1 + t * dy - py
    return ex * ex + ey * ey


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def _central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of a longitude and latitude in degrees."""
    phi, lam = F.radians(lat), F.radians(lon) - _central_meridian(zone)
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_FORWARD, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    shift = F.when(south, FALSE_NORTHING_SOUTH).otherwise(0.0)
    return FALSE_EASTING + SCALE * _RECTIFYING * east, shift + SCALE * _RECTIFYING * north


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of an easting and northing."""
    shift = F.when(south, FALSE_NORTHING_SOUTH).otherwise(0.0)
    xi = (y - shift) / (SCALE * _RECTIFYING)
    eta = (x - FALSE_EASTING) / (SCALE * _RECTIFYING)
    a, b = xi, eta
    for j, c in enumerate(_INVERSE, start=1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, d in enumerate(_LATITUDE, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = _central_meridian(zone) + F.atan2(F.sinh(b), F.cos(a))
    return F.degrees(lam), F.degrees(phi)


def tile_code(south_edge: Column, west_edge: Column) -> Column:
    """Code of a land-cover tile from its south-west corner, e.g. N06E003."""
    return F.concat(
        F.when(south_edge >= 0, "N").otherwise("S"),
        F.lpad(F.abs(south_edge).cast("string"), 2, "0"),
        F.when(west_edge >= 0, "E").otherwise("W"),
        F.lpad(F.abs(west_edge).cast("string"), 3, "0"),
    )


TILE_DEGREES = 3


def _edges(low: Column, high: Column) -> Column:
    first = (F.floor(low / float(TILE_DEGREES)) * TILE_DEGREES).cast("int")
    last = (F.floor(high / float(TILE_DEGREES)) * TILE_DEGREES).cast("int")
    return F.sequence(first, last, F.lit(TILE_DEGREES))


def tiles_for_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Codes of all tiles a bounding box touches, south to north, west to east."""
    rows = F.transform(
        _edges(miny, maxy),
        lambda south: F.transform(_edges(minx, maxx), lambda west: tile_code(south, west)),
    )
    return F.flatten(rows)


def resolve_tiles(explicit_many: Column, explicit_one: Column, inferred: Column) -> Column:
    """Configured tiles first, then a single configured one, then the inferred."""
    listed = F.when(F.size(explicit_many) > 0, F.sort_array(F.array_distinct(explicit_many)))
    single = F.when(F.length(explicit_one) > 0, F.array(explicit_one))
    return F.coalesce(listed, single, inferred)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal for z >= 0 (Abramowitz-Stegun 26.2.17,
    absolute error below 7.5e-8)."""
    # The coefficients of the published approximation.
    p = 0.2316419
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1.0 / (1.0 + p * z)
    series = F.lit(0.0)
    for c in reversed(b):
        series = (series + c) * t
    return F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi) * series
