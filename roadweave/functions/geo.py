"""Geometry as column expressions: UTM projection, boxes, point-segment distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 (fixed values).
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krüger series to the third order.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def utm(lon: Column, lat: Column, zone: int = 32) -> tuple[Column, Column]:
    """Easting and northing in metres (northern half) of degrees; centimetres within a zone's reach."""
    lam, phi = F.radians(lon - (zone * 6 - 183)), F.radians(lat)
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * _RADIUS * x, 0.9996 * _RADIUS * y


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside x0, y0, x1, y1; as plain ranges it reaches the parquet scan."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    along = F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))
