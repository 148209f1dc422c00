"""Geographic <-> projected coordinates as Column arithmetic.

The working CRS is a Transverse Mercator on GRS80, so both directions are closed series (Krueger, to fourth
order in the third flattening; see Karney 2011). Everything stays in JVM code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g

# EPSG:2193 parameters.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
CENTRAL_MERIDIAN = 173.0
SCALE = 0.9996
FALSE_EASTING = 1600000.0
FALSE_NORTHING = 10000000.0

WORKING_SRID = 2193
GEOGRAPHIC_SRID = 4326

_f = 1.0 / INVERSE_FLATTENING
_n = _f / (2.0 - _f)
_ECC = 2.0 * math.sqrt(_n) / (1.0 + _n)
_RADIUS = SCALE * SEMI_MAJOR / (1.0 + _n) * (1.0 + _n**2 / 4.0 + _n**4 / 64.0)


def _series(*rows: tuple[float, ...]) -> tuple[float, ...]:
    """Row j holds the coefficients of n^j, n^(j+1), ... of the j-th harmonic."""
    return tuple(sum(c * _n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, start=1))


# Krueger series.
FORWARD = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
INVERSE = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
LATITUDE = _series((2.0, -2 / 3, -2.0, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def _forward_start(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(lat.cast("double"))
    lam = F.radians(lon.cast("double") - CENTRAL_MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    return F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))


def _forward_end(xi: Column, eta: Column) -> tuple[Column, Column]:
    east, north = eta, xi
    for j, coefficient in enumerate(FORWARD, start=1):
        east = east + coefficient * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + coefficient * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return FALSE_EASTING + _RADIUS * east, FALSE_NORTHING + _RADIUS * north


def _inverse_start(x: Column, y: Column) -> tuple[Column, Column]:
    xi = (y.cast("double") - FALSE_NORTHING) / _RADIUS
    eta = (x.cast("double") - FALSE_EASTING) / _RADIUS
    xi0, eta0 = xi, eta
    for j, coefficient in enumerate(INVERSE, start=1):
        xi0 = xi0 - coefficient * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        eta0 = eta0 - coefficient * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    return xi0, eta0


def _inverse_end(xi0: Column, eta0: Column) -> tuple[Column, Column]:
    def latitude(chi: Column) -> Column:
        phi = chi
        for j, coefficient in enumerate(LATITUDE, start=1):
            phi = phi + coefficient * F.sin(2.0 * j * chi)
        return F.degrees(phi)

    lon = CENTRAL_MERIDIAN + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))
    return lon, latitude(F.asin(F.sin(xi0) / F.cosh(eta0)))


def to_projected(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude/latitude in degrees to easting/northing in metres."""
    return _forward_end(*_forward_start(lon, lat))


def to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """Easting/northing in metres to longitude/latitude in degrees."""
    return _inverse_end(*_inverse_start(x, y))


def transform_geometry(geom: Column | str, from_srid: int, to_srid: int) -> Column:
    """Reproject every vertex of a geometry struct."""
    col = F.col(geom) if isinstance(geom, str) else geom
    if from_srid == to_srid:
        return col
    steps = {
        (GEOGRAPHIC_SRID, WORKING_SRID): (_forward_start, _forward_end),
        (WORKING_SRID, GEOGRAPHIC_SRID): (_inverse_start, _inverse_end),
    }.get((from_srid, to_srid))
    if steps is None:
        raise ValueError(f"no transformation from EPSG:{from_srid} to EPSG:{to_srid}")
    start, end = steps

    def move(p: Column) -> Column:
        # Binding the halfway point keeps each vertex at one evaluation of either half.
        return g.let(g.point(*start(p["x"], p["y"])), lambda half: g.point(*end(half["x"], half["y"])))

    def moved(shape: Column) -> Column:
        parts = F.transform(shape["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, move)))
        return g.geometry(shape["kind"], parts)

    return g.let(col, lambda shape: F.when(shape.isNotNull(), moved(shape)))


def wkt_to_working_box(wkt: Column | str) -> Column:
    """Geographic WKT to the rectangle around its reprojected vertices, as ``struct<xmin,ymin,xmax,ymax>``."""
    moved = transform_geometry(g.from_wkt(wkt), GEOGRAPHIC_SRID, WORKING_SRID)
    return F.struct(*(moved[side].alias(side) for side in g.BOX))
