"""Image chips around places, display stretch and overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.functions import geo
from terradrift.operators.tiling import PIXEL_KEYS, SCENE
from terradrift.session import save_table

ALPHA = 0.40
# Fixed value: red, green, blue of the overlay fill.
FILL_RGB = (239, 68, 68)


def centres_of(features: DataFrame, scene: DataFrame) -> DataFrame:
    """Chip centres ``(chip_id, scene_id, cr, cc)`` from feature centroids."""
    j = features.select(SCENE, F.col("feature_id").alias("chip_id"), "centroid").join(scene.select(SCENE, "affine"), SCENE)
    lon, lat = F.col("centroid.lon"), F.col("centroid.lat")
    return j.select(
        "chip_id", SCENE, F.floor(geo.geo_to_row("affine", lon, lat)).cast("int").alias("cr"),
        F.floor(geo.geo_to_col("affine", lon, lat)).cast("int").alias("cc"),
    )


def extract_chips(px: DataFrame, centres: DataFrame, bands: Sequence[str], size: int = 512) -> DataFrame:
    """Square chips ``(chip_id, row, col, bands)``; places outside the raster are 0."""
    half = size // 2
    span = F.sequence(F.lit(0), F.lit(size - 1))
    grid = centres.withColumn("y", F.explode(span)).withColumn("x", F.explode(span))
    grid = grid.select(
        "chip_id", SCENE, "y", "x", (F.col("cr") - half + F.col("y")).cast("int").alias("row"),
        (F.col("cc") - half + F.col("x")).cast("int").alias("col"),
    )
    joined = grid.join(px.select(*PIXEL_KEYS, *bands), PIXEL_KEYS, "left")
    return joined.select(
        "chip_id", F.col("y").cast("int").alias("row"), F.col("x").cast("int").alias("col"),
        *[F.coalesce(F.col(b), F.lit(0)).alias(b) for b in bands],
    )


def display_stretch(px: DataFrame, bands: Sequence[str], group: str = SCENE) -> DataFrame:
    """First three bands scaled to 0..255 between their joint extremes; constant images are 0."""
    shown = list(bands)[:3]
    shown = shown * 3 if len(shown) == 1 else shown
    ends = px.groupBy(group).agg(
        F.min(F.least(*shown)).cast("double").alias("_lo"), F.max(F.greatest(*shown)).cast("double").alias("_hi")
    )
    ends = save_table(ends, "stretch")
    span = F.col("_hi") - F.col("_lo")
    keys = [c for c in px.columns if c not in bands]
    scaled = [
        F.when(span > 0, F.floor((F.col(b) - F.col("_lo")) / span * 255.0)).otherwise(0).cast("int").alias(name)
        for b, name in zip(shown, ("red", "green", "blue"))
    ]
    return px.join(ends, group).select(*keys, *scaled)


def overlay(shown: DataFrame, labelled: DataFrame, alpha: float = ALPHA, fill: Sequence[int] = FILL_RGB) -> DataFrame:
    """Blend a fill colour over the pixels of labelled components."""
    marked = shown.join(labelled.select(*PIXEL_KEYS, F.lit(True).alias("_in")), PIXEL_KEYS, "left")
    mixed = [
        F.when(F.col("_in"), F.bround(alpha * colour + (1 - alpha) * F.col(name))).otherwise(F.col(name)).cast("int").alias(name)
        for name, colour in zip(("red", "green", "blue"), fill)
    ]
    return marked.select(*PIXEL_KEYS, *mixed)
