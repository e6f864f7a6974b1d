"""Overlapping tiles, blend weights and user-supplied scorers."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.operators.tiling import PIXEL_KEYS, SCENE

OVERLAP = 0.10
MAX_TILE = 1024
MOSAIC_KEYS = [SCENE, "tile_i", "tile_j"]


def tile_bounds(dims: DataFrame, overlap: float = OVERLAP, max_tile: int = MAX_TILE) -> DataFrame:
    """Half-open bounds ``r1, r2, c1, c2`` of the overlapping tiles of each scene.

    A scene is cut into 2 x 2 parts, or more where that would exceed ``max_tile`` pixels
    a side, each part widened by a share of its size towards its neighbours.
    """
    sized = dims.select(SCENE, "n_rows", "n_cols", _parts("n_rows", max_tile).alias("parts_i"), _parts("n_cols", max_tile).alias("parts_j"))
    tiles = sized.withColumn("tile_i", F.explode(F.sequence(F.lit(0), F.col("parts_i") - 1))).withColumn(
        "tile_j", F.explode(F.sequence(F.lit(0), F.col("parts_j") - 1))
    )
    r1, r2 = _span("tile_i", "n_rows", "parts_i", overlap)
    c1, c2 = _span("tile_j", "n_cols", "parts_j", overlap)
    return tiles.select(*MOSAIC_KEYS, "parts_i", "parts_j", r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), c2.alias("c2"))


def _parts(size: str, max_tile: int) -> Column:
    return F.greatest(F.lit(2), F.ceil(F.col(size) / max_tile).cast("int"))


def _span(index: str, size: str, parts: str, overlap: float) -> tuple[Column, Column]:
    step = F.floor(F.col(size) / F.col(parts)).cast("int")
    extra = F.rint(step * overlap).cast("int")
    i = F.col(index)
    start = F.greatest(i * step - extra, F.lit(0))
    end = F.when(i == F.col(parts) - 1, F.col(size)).otherwise(F.least((i + 1) * step + extra, F.col(size)))
    return start, end


def assign_tiles(px: DataFrame, dims: DataFrame, overlap: float = OVERLAP, max_tile: int = MAX_TILE) -> DataFrame:
    """One copy of each pixel per tile it lies in, with the tile bounds."""
    sized = px.join(
        dims.select(SCENE, "n_rows", "n_cols", _parts("n_rows", max_tile).alias("parts_i"), _parts("n_cols", max_tile).alias("parts_j")), SCENE
    )

    def near(axis: str, size: str, parts: str) -> Column:
        home = F.least(F.floor(F.col(axis) / F.floor(F.col(size) / F.col(parts))).cast("int"), F.col(parts) - 1)
        return F.sequence(F.greatest(home - 1, F.lit(0)), F.least(home + 1, F.col(parts) - 1))

    r1, r2 = _span("tile_i", "n_rows", "parts_i", overlap)
    c1, c2 = _span("tile_j", "n_cols", "parts_j", overlap)
    rows = (
        sized.withColumn("tile_i", F.explode(near("row", "n_rows", "parts_i")))
        .withColumns({"r1": r1, "r2": r2})
        .filter((F.col("row") >= F.col("r1")) & (F.col("row") < F.col("r2")))
    )
    return (
        rows.withColumn("tile_j", F.explode(near("col", "n_cols", "parts_j")))
        .withColumns({"c1": c1, "c2": c2})
        .filter((F.col("col") >= F.col("c1")) & (F.col("col") < F.col("c2")))
        .drop("n_rows", "n_cols")
    )


def blend_weight(overlap: float = OVERLAP, ref_border: bool = False) -> Column:
    """Raised-cosine weight of a pixel in its tile.

    The ramp covers interior seams; ``ref_border=True`` also ramps the outer border, where
    the weight, and with it the blended score, falls to 0.
    """

    def axis(pos: str, low: str, high: str, index: str, parts: str) -> Column:
        length = F.col(high) - F.col(low)
        ramp = F.rint(length / 2 * overlap).cast("int")
        ramp = F.when(2 * ramp <= length, ramp).otherwise(F.floor(length / 2).cast("int"))
        before, after = F.col(pos) - F.col(low), F.col(high) - 1 - F.col(pos)

        def rise(k: Column) -> Column:
            return 0.5 * (1 - F.cos(math.pi * k / F.greatest(ramp - 1, F.lit(1))))

        first, last = F.col(index) == 0, F.col(index) == F.col(parts) - 1
        low_side = (before < ramp) & (F.lit(ref_border) | ~first)
        high_side = (after < ramp) & (F.lit(ref_border) | ~last)
        return F.when(high_side, rise(after)).when(low_side, rise(before)).otherwise(1.0)

    return axis("row", "r1", "r2", "tile_i", "parts_i") * axis("col", "c1", "c2", "tile_j", "parts_j")


def blend(scored: DataFrame, prob: str = "prob", weight: str = "weight") -> DataFrame:
    """Weighted mean of overlapping tile scores per pixel, within [0, 1]."""
    total = F.greatest(F.sum(weight), F.lit(1e-6))
    mean = F.sum(F.col(prob) * F.col(weight)) / total
    return scored.groupBy(*PIXEL_KEYS).agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("prob"))


def score_tiles(tiles: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Run a user scorer on each tile: it gets the tile's pixels and returns one score per row.

    Tiles are bounded by ``max_tile`` and its overlap, so a group fits a Python worker.
    """
    keep = [*PIXEL_KEYS, "tile_i", "tile_j", "parts_i", "parts_j", "r1", "r2", "c1", "c2"]
    kinds = dict(tiles.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", prob double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keep].assign(prob=scorer(pdf).astype("float64"))

    return tiles.groupBy(*MOSAIC_KEYS).applyInPandas(run, schema)


def tiled_scores(
    px: DataFrame, dims: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], overlap: float = OVERLAP,
    max_tile: int = MAX_TILE, ref_border: bool = False,
) -> DataFrame:
    """Score overlapping tiles and blend them into one map ``(scene_id, row, col, prob)``."""
    scored = score_tiles(assign_tiles(px, dims, overlap, max_tile), scorer)
    return blend(scored.withColumn("weight", blend_weight(overlap, ref_border)))


def screen_windows(scene: DataFrame, boxes: DataFrame) -> DataFrame:
    """One window request per candidate box and scene it may meet: ``(request_id, scene_id, box)``.

    Boxes and scenes are matched on degree cells they cover; the window step then cuts exactly
    and drops boxes that miss the scene.
    """
    t = F.col("affine")
    right, bottom = t["c"] + F.col("n_cols") * t["a"], t["f"] + F.col("n_rows") * t["e"]

    def cells(df: DataFrame, lat0, lat1, lon0, lon1) -> DataFrame:
        def span(a, b):
            return F.sequence(F.floor(F.least(a, b) / 0.1), F.floor(F.greatest(a, b) / 0.1))

        return df.withColumn("_cy", F.explode(span(lat0, lat1))).withColumn("_cx", F.explode(span(lon0, lon1)))

    sides = ["min_lat", "min_lon", "max_lat", "max_lon"]
    placed = cells(scene.select(SCENE, "affine", "n_rows", "n_cols"), t["f"], bottom, t["c"], right)
    wanted = cells(boxes.select(*sides), F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
    met = placed.join(wanted, ["_cy", "_cx"]).select(SCENE, *sides).distinct()
    return met.withColumn("request_id", F.concat_ws("|", SCENE, *sides))
