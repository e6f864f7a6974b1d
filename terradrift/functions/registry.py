"""SQL surface: temporary SQL functions that Catalyst inlines into the calling query."""

from __future__ import annotations

from pyspark.sql import SparkSession

from terradrift.functions import gridref
from terradrift.functions.geo import EARTH_RADIUS_M, WGS84_B, WGS84_E, WGS84_E2


def _blocks(head: int) -> str:
    cuts = ((1, head), (head + 1, 2), (head + 3, 5), (head + 8, 5))
    return "concat_ws(' ', " + ", ".join(f"substring(replace(trim(ref), ' ', ''), {a}, {n})" for a, n in cuts) + ")"


def _series(outer: str, inner: str, start: str) -> str:
    """Krueger series of the projection about ``xi`` and ``eta``."""
    terms = [f"{a!r}D * {outer}({2 * j} * xi) * {inner}({2 * j} * eta)" for j, a in enumerate(gridref._ALPHA, start=1)]
    return f"{gridref.SCALE_FACTOR * gridref._RECTIFYING_RADIUS!r}D * ({start} + " + " + ".join(terms) + ")"


def _zone_q(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"({s} / (1 - {WGS84_E2}D * pow({s}, 2)) + atanh({WGS84_E}D * {s}) / {WGS84_E}D)"


_FUNCTIONS = {
    "haversine_m": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        f"{2 * EARTH_RADIUS_M}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "tangent_x": (
        "lon DOUBLE, lat0 DOUBLE, lon0 DOUBLE",
        "DOUBLE",
        f"radians(lon - lon0) * {EARTH_RADIUS_M}D * cos(radians(lat0))",
    ),
    "tangent_y": ("lat DOUBLE, lat0 DOUBLE", "DOUBLE", f"radians(lat - lat0) * {EARTH_RADIUS_M}D"),
    "zone_q": ("lat DOUBLE", "DOUBLE", _zone_q("lat")),
    "cell_area_m2": (
        "lat_a DOUBLE, lat_b DOUBLE, lon_span DOUBLE",
        "DOUBLE",
        f"abs(radians(lon_span) * (zone_q(lat_a) - zone_q(lat_b))) * {WGS84_B**2 / 2}D",
    ),
    "ring_area_m2": (
        "ring ARRAY<ARRAY<DOUBLE>>",
        "DOUBLE",
        "abs(aggregate(sequence(0, size(ring) - 1), 0D, (acc, i) -> acc + radians(ring[(i + 1) % size(ring)][0] - ring[i][0])"
        f" * ({_zone_q('ring[i][1]')} + {_zone_q('ring[(i + 1) % size(ring)][1]')}) / 2)) * {WGS84_B**2 / 2}D",  # no function calls in a lambda
    ),
    "format_grid_ref": (
        "ref STRING",
        "STRING",
        f"CASE length(replace(trim(ref), ' ', '')) WHEN 15 THEN {_blocks(3)} WHEN 14 THEN {_blocks(2)} ELSE ref END",
    ),
    "utm_zone": (
        "lat DOUBLE, lon DOUBLE",
        "INT",
        "CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32"
        " WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END"
        " ELSE CAST(floor((lon + 180) / 6) AS INT) % 60 + 1 END",
    ),
    "conformal_t": (
        "lat DOUBLE",
        "DOUBLE",
        f"sinh(atanh(sin(radians(lat))) - {WGS84_E}D * atanh({WGS84_E}D * sin(radians(lat))))",
    ),
    "utm_xi": ("lat DOUBLE, d_lon DOUBLE", "DOUBLE", "atan2(conformal_t(lat), cos(d_lon))"),
    "utm_eta": ("lat DOUBLE, d_lon DOUBLE", "DOUBLE", "atanh(sin(d_lon) / sqrt(1 + pow(conformal_t(lat), 2)))"),
    "utm_east": ("xi DOUBLE, eta DOUBLE", "DOUBLE", f"{_series('cos', 'sinh', 'eta')} + {float(gridref.FALSE_EASTING)}D"),
    "utm_north": ("xi DOUBLE, eta DOUBLE", "DOUBLE", _series("sin", "cosh", "xi")),
    "grid_square": (
        "zone INT, lat DOUBLE, e DOUBLE, n DOUBLE",
        "STRING",
        f"concat(lpad(CAST(zone AS STRING), 2, '0'), substring('{gridref.BAND_LETTERS}', CAST(floor((lat + 80) / 8) + 1 AS INT), 1),"
        f" substring('{gridref.COLUMN_LETTERS}', CAST((zone - 1) % 3 * 8 + floor(e / 100000) AS INT), 1),"
        f" substring('{gridref.ROW_LETTERS}', CAST((floor(n / 100000) + if(zone % 2 = 0, 5, 0)) % 20 + 1 AS INT), 1),"
        " lpad(CAST(floor(e % 100000) AS STRING), 5, '0'), lpad(CAST(floor(n % 100000) AS STRING), 5, '0'))",
    ),
    "grid_ref_at": (
        "zone INT, lat DOUBLE, xi DOUBLE, eta DOUBLE",
        "STRING",
        f"format_grid_ref(grid_square(zone, lat, utm_east(xi, eta), utm_north(xi, eta) + if(lat < 0, {float(gridref.FALSE_NORTHING)}D, 0D)))",
    ),
    "grid_ref": (
        "lat DOUBLE, lon DOUBLE",
        "STRING",
        f"CASE WHEN lat BETWEEN {gridref.MIN_LAT} AND {gridref.MAX_LAT} AND lon BETWEEN -180 AND 180 THEN grid_ref_at(utm_zone(lat, lon), lat,"
        " utm_xi(lat, radians(lon - (utm_zone(lat, lon) * 6 - 183))), utm_eta(lat, radians(lon - (utm_zone(lat, lon) * 6 - 183))))"
        " ELSE concat('GRID-', CAST(bround(lat, 4) AS STRING), 'N-', CAST(bround(lon, 4) AS STRING), 'E') END",
    ),
    "hectares": ("area_m2 DOUBLE", "DOUBLE", "bround(area_m2 / 10000D, 4)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the geometry functions for use in ``spark.sql``; returns their names."""
    for name, (args, returns, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return list(_FUNCTIONS)
