"""Viewing geometry, projections and coordinates as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree of latitude, from the length of a meridian circle.
DEGREE_M = 40075e3 / 360
# Semi-major axis and flattening of WGS84, scale and false easting of UTM.
WGS84_A, WGS84_F, UTM_SCALE, UTM_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def angles(look: Column, heading: Column) -> tuple[Column, Column]:
    """theta and phi in radians from look and heading in degrees."""
    return F.radians(90 - look), F.radians(-90 - heading)


def los_vector(look: Column, heading: Column) -> tuple[Column, Column, Column]:
    """Unit vector to the sensor: east, north, up."""
    theta, phi = angles(look, heading)
    return F.cos(phi) * F.cos(theta), F.sin(phi) * F.cos(theta), F.sin(theta)


def slope_frame(e: Column, n: Column, u: Column, rotation: Column, slope: Column) -> tuple[Column, Column, Column]:
    """A line-of-sight vector in a frame turned about the vertical by `rotation` and then tilted by `slope` (radians)."""
    first = e * F.cos(rotation) - n * F.sin(rotation)
    second = e * F.sin(rotation) + n * F.cos(rotation)
    return first * F.cos(slope) - u * F.sin(slope), second, first * F.sin(slope) + u * F.cos(slope)


def enu_to_los(e: Column, n: Column, u: Column, look: Column, heading: Column, convention: str = "ROIPAC") -> Column:
    """East, north, up projected onto the line of sight; GAMMA's angles are given as theta and phi in radians instead of look and heading."""
    if convention == "GAMMA":
        ve, vn, vu = F.cos(heading) * F.cos(look), F.sin(heading) * F.cos(look), F.sin(look)
    else:
        ve, vn, vu = los_vector(look, heading)
    return e * ve + n * vn + u * vu


def enu_sigma_to_los_linear(se: Column, sn: Column, su: Column, look: Column, heading: Column) -> Column:
    """Standard deviations projected like displacements, signs included: the form that published tables hold."""
    return enu_to_los(se, sn, su, look, heading)


def enu_sigma_to_los(se: Column, sn: Column, su: Column, look: Column, heading: Column) -> Column:
    """Standard deviation of independent components along the line of sight."""
    e, n, u = los_vector(look, heading)
    return F.sqrt(se * se * e * e + sn * sn * n * n + su * su * u * u)


def cell(coordinate: Column, origin: float, step: float) -> Column:
    """Index of the nearest cell centre."""
    return F.floor((coordinate - F.lit(origin)) / F.lit(step) + 0.5).cast("int")


def coordinate(index: Column, origin: float, step: float) -> Column:
    return F.lit(origin) + F.lit(step) * index


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres on the northern grid: Krueger's series to the third order."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183))
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, alpha in enumerate(series, 1):
        east = east + alpha * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + alpha * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EAST + UTM_SCALE * radius * east, UTM_SCALE * radius * north


def side_of_edge(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    return F.lit(x2 - x1) * (y - F.lit(y1)) - F.lit(y2 - y1) * (x - F.lit(x1))


def in_convex_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Strictly inside; corners in either direction."""
    sides = [side_of_edge(x, y, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    left, right = F.lit(True), F.lit(True)
    for s in sides:
        left, right = left & (s > 0), right & (s < 0)
    return left | right


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear between two known points; at a known point its value."""
    return F.when(x0.isNull(), y1).when(x1.isNull() | (x1 == x0), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
