"""Geodesy and affine arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius, metres per degree and the WGS84 ellipsoid.
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563

WGS84_B = WGS84_A * (1.0 - WGS84_F)
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)
WGS84_E = math.sqrt(WGS84_E2)

MIN_HECTARES = 0.005


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def tangent_x(lon, lat0: float, lon0: float) -> Column:
    """Eastward metres in the plane touching the sphere at (lat0, lon0)."""
    return F.radians(_c(lon) - lon0) * (EARTH_RADIUS_M * math.cos(math.radians(lat0)))


def tangent_y(lat, lat0: float) -> Column:
    """Northward metres in the plane touching the sphere at latitude lat0."""
    return F.radians(_c(lat) - lat0) * EARTH_RADIUS_M


def pixel_to_lon(affine, col, row) -> Column:
    affine = _c(affine)
    return affine["a"] * _c(col) + affine["b"] * _c(row) + affine["c"]


def pixel_to_lat(affine, col, row) -> Column:
    affine = _c(affine)
    return affine["d"] * _c(col) + affine["e"] * _c(row) + affine["f"]


def geo_to_col(affine, lon, lat) -> Column:
    """Fractional pixel column of a lon/lat point (closed-form 2x2 inverse)."""
    t = _c(affine)
    det = t["a"] * t["e"] - t["b"] * t["d"]
    return (t["e"] * (_c(lon) - t["c"]) - t["b"] * (_c(lat) - t["f"])) / det


def geo_to_row(affine, lon, lat) -> Column:
    """Fractional pixel row of a lon/lat point."""
    t = _c(affine)
    det = t["a"] * t["e"] - t["b"] * t["d"]
    return (t["a"] * (_c(lat) - t["f"]) - t["d"] * (_c(lon) - t["c"])) / det


def ground_sample_distance(affine, is_geographic, mean_lat) -> Column:
    """Geometric mean of the pixel size in metres."""
    t = _c(affine)
    phi = F.radians(_c(mean_lat))
    per_lat = 111132.954 - 559.822 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi)
    per_lon = 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi)
    pixel_area = F.abs(t["a"]) * F.abs(t["e"])
    return F.when(_c(is_geographic), F.sqrt(pixel_area * per_lat * per_lon)).otherwise(F.sqrt(pixel_area))


def authalic_zone(lat) -> Column:
    """Ellipsoidal zone function q; area of a lat band is b^2/2 * dlon * (q2 - q1)."""
    s = F.sin(F.radians(_c(lat)))
    return s / (1 - WGS84_E2 * s * s) + F.atanh(WGS84_E * s) / WGS84_E


def cell_area_m2(lat_a, lat_b, lon_span_deg) -> Column:
    """Exact WGS84 area of a latitude-longitude cell."""
    return F.abs(F.radians(_c(lon_span_deg)) * (authalic_zone(lat_a) - authalic_zone(lat_b))) * (WGS84_B**2 / 2)


def ring_area_m2(ring) -> Column:
    """Unsigned WGS84 area of a closed ring ``array<array<double>>`` of [lon, lat].

    Edges are treated as straight in the equal-area (longitude, q) plane.
    """
    ring = _c(ring)
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    strips = F.zip_with(ring, nxt, lambda p, n: F.radians(n[0] - p[0]) * (authalic_zone(p[1]) + authalic_zone(n[1])) / 2)
    return F.abs(F.aggregate(strips, F.lit(0.0), lambda acc, s: acc + s)) * (WGS84_B**2 / 2)


def multipolygon_area_m2(geometry) -> Column:
    """Area of ``array<polygon>``, each polygon an outer ring followed by its holes."""

    def polygon(p):
        rings = F.transform(p, ring_area_m2)
        return F.aggregate(rings, F.lit(0.0), lambda acc, a: acc + a, lambda total: 2 * rings[0] - total)

    return F.aggregate(F.transform(_c(geometry), polygon), F.lit(0.0), lambda acc, a: acc + a)


def hectares(area_m2, floor: float = 0.0) -> Column:
    """Hectares at 4 decimals; feature records use ``floor=MIN_HECTARES``."""
    return F.greatest(F.lit(float(floor)), F.bround(_c(area_m2) / 10000.0, 4))
