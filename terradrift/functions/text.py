"""Text helpers, digests and report formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradrift.functions.geo import _c


def words(text) -> Column:
    """Lower-cased whitespace tokens without empties."""
    return F.filter(F.split(F.lower(_c(text)), r"(?U)\s+"), lambda w: w != "")


def digest(value) -> Column:
    return F.sha2(_c(value), 256)


def canonical_json(*columns: str) -> Column:
    """Compact JSON of typed columns with keys in sorted order, so layout cannot change the digest."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def cache_key(aoi, t1, t2) -> Column:
    return digest(F.concat_ws("::", _c(aoi), _c(t1), _c(t2)))


def short_id(value) -> Column:
    return F.substring(_c(value), 1, 8)


def percent_text(share) -> Column:
    return F.concat(F.format_number(_c(share) * 100, 1), F.lit("%"))


def area_text(area_m2) -> Column:
    return F.format_number(_c(area_m2), 0)


def hectare_text(area_ha) -> Column:
    return F.format_number(_c(area_ha), 3)


def point_text(lat, lon) -> Column:
    return F.concat(F.format_number(_c(lat), 4), F.lit("°, "), F.format_number(_c(lon), 4), F.lit("°"))
