"""Per-pixel and per-vector expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradrift.functions.geo import _c

# Sensor nodata numbers and luminance weights.
NODATA = (0.0, 65535.0)
LUMA = (0.299, 0.587, 0.114)


def clip(value, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(value), F.lit(float(low))), F.lit(float(high)))


def luminance(red, green, blue, scale: float = 1.0) -> Column:
    """Weighted brightness, clipped to [0, scale]."""
    parts = [weight * _c(band) for weight, band in zip(LUMA, (red, green, blue))]
    return clip(reduce(lambda a, b: a + b, parts), 0.0, scale)


def to_byte(value) -> Column:
    """Scale [0, 1] to an integer 0..255, rounding half to even."""
    return clip(F.bround(_c(value) * 255.0), 0, 255).cast("int")


def valid_or_null(band, extra_nodata: float | None = None) -> Column:
    """The band value where it is finite and not a nodata number, else NULL."""
    value = _c(band).cast("double")
    blocked = list(NODATA) + ([float(extra_nodata)] if extra_nodata is not None else [])
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite & ~value.isin(*blocked), value)


def quality_bit(band, bit: int) -> Column:
    """1 when the given bit of a quality band is set."""
    return F.getbit(_c(band), F.lit(bit)).cast("int")


def opaque_or_cirrus(band) -> Column:
    """Cloud flag from bits 10 (opaque) and 11 (cirrus) of a quality band."""
    return F.greatest(quality_bit(band, 10), quality_bit(band, 11))


def dot(u, v) -> Column:
    terms = F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def norm(u) -> Column:
    return F.sqrt(dot(u, u))


def unit(u) -> Column:
    """L2-normalised vector; a zero vector is returned unchanged."""
    length = norm(u)
    # The length is paired with each element: inside the lambda it would be computed per element.
    lengths = F.array_repeat(F.when(length > 0, length).otherwise(1.0), F.size(_c(u)))
    return F.zip_with(_c(u), lengths, lambda x, n: x.cast("double") / n)
