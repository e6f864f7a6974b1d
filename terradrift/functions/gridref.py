"""Military grid references from latitude/longitude as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.functions.geo import WGS84_A, WGS84_E, WGS84_F, _c

# Grid letters and projection constants of the public grid standard.
BAND_LETTERS = "CDEFGHJKLMNPQRSTUVWXX"
COLUMN_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUV"
SCALE_FACTOR = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0
MIN_LAT, MAX_LAT = -80.0, 84.0

_N = WGS84_F / (2 - WGS84_F)
_RECTIFYING_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)


def utm_zone(lat, lon) -> Column:
    """Zone number with the south-west Norway and Svalbard exceptions."""
    lat, lon = _c(lat), _c(lon)
    plain = F.floor((lon + 180) / 6).cast("int") % 60 + 1
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42)
    arctic = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when(norway, F.lit(32)).when(svalbard, arctic).otherwise(plain)


def _forward(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Transverse Mercator easting and northing (Krueger series, third order)."""
    s = F.sin(F.radians(lat))
    d_lon = F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - WGS84_E * F.atanh(WGS84_E * s))
    xi = F.atan2(t, F.cos(d_lon))
    eta = F.atanh(F.sin(d_lon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = SCALE_FACTOR * _RECTIFYING_RADIUS
    return scale * east + FALSE_EASTING, scale * north


def format_grid_ref(ref) -> Column:
    """Split a 15- or 14-character reference into blocks; leave others unchanged."""
    ref = F.regexp_replace(F.trim(_c(ref)), " ", "")

    def blocks(head: int) -> Column:
        cuts = ((1, head), (head + 1, 2), (head + 3, 5), (head + 8, 5))
        return F.concat_ws(" ", *[F.substring(ref, a, n) for a, n in cuts])

    return F.when(F.length(ref) == 15, blocks(3)).when(F.length(ref) == 14, blocks(2)).otherwise(_c(ref))


def with_grid_ref(df: DataFrame, lat: str, lon: str, out: str = "grid_ref") -> DataFrame:
    """Add the 10-figure grid reference of each point.

    Points outside the grid's latitude range get a plain ``GRID-..N-..E`` text.
    """
    zone = utm_zone(lat, lon)
    east, north = _forward(F.col(lat), F.col(lon), F.col("_zone"))
    plain = F.concat(
        F.lit("GRID-"), F.bround(F.col(lat), 4).cast("string"), F.lit("N-"),
        F.bround(F.col(lon), 4).cast("string"), F.lit("E"),
    )
    band = F.substring(F.lit(BAND_LETTERS), (F.floor((F.col(lat) + 80) / 8) + 1).cast("int"), 1)
    set_start = ((F.col("_zone") - 1) % 3) * 8
    col_letter = F.substring(F.lit(COLUMN_LETTERS), (set_start + F.floor(F.col("_e") / 100000)).cast("int"), 1)
    offset = F.when(F.col("_zone") % 2 == 0, 5).otherwise(0)
    row_letter = F.substring(F.lit(ROW_LETTERS), ((F.floor(F.col("_n") / 100000) + offset) % 20 + 1).cast("int"), 1)

    def digits(v):
        return F.lpad(F.floor(F.col(v) % 100000).cast("string"), 5, "0")

    packed = F.concat(
        F.lpad(F.col("_zone").cast("string"), 2, "0"), band, col_letter, row_letter, digits("_e"), digits("_n")
    )
    inside = F.col(lat).between(MIN_LAT, MAX_LAT) & F.col(lon).between(-180, 180)
    return (
        df.withColumn("_zone", zone)
        .withColumns({"_e": east, "_n": north})
        .withColumn("_n", F.when(F.col(lat) < 0, F.col("_n") + FALSE_NORTHING).otherwise(F.col("_n")))
        .withColumn(out, F.when(inside, format_grid_ref(packed)).otherwise(plain))
        .drop("_zone", "_e", "_n")
    )
