"""Halo tiles: one shuffle puts every pixel next to all neighbours it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCENE = "scene_id"
PIXEL_KEYS = [SCENE, "row", "col"]
TILE_KEYS = [SCENE, "tile_r", "tile_c"]
DEFAULT_TILE = 256


def shuffled(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the pixels or nodes: written, they pack so well that the size of their files says little about them."""
    return rows.hint("merge")


def with_tile(px: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """Add the tile a pixel belongs to."""
    return px.withColumns(
        {"tile_r": F.floor(F.col("row") / tile).cast("int"), "tile_c": F.floor(F.col("col") / tile).cast("int")}
    )


def with_halo(px: DataFrame, radius: int, tile: int = DEFAULT_TILE) -> DataFrame:
    """Copy border pixels to the tiles that need them and place each tile in one partition.

    Groups are bounded by ``(tile + 2*radius)**2`` however large a scene is, and the
    copies add about ``4*radius/tile`` rows. Window steps partitioned by tile plus a
    row or column reuse this partitioning without another shuffle.
    """

    def reach(axis: str):
        low = F.greatest(F.floor((F.col(axis) - radius) / tile), F.lit(0)).cast("int")
        high = F.floor((F.col(axis) + radius) / tile).cast("int")
        return F.sequence(low, high)

    return (
        px.withColumn("tile_r", F.explode(reach("row")))
        .withColumn("tile_c", F.explode(reach("col")))
        .repartition(*TILE_KEYS)
    )


def drop_halo(px: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """Keep only pixels of the tile proper."""
    inside = (F.floor(F.col("row") / tile) == F.col("tile_r")) & (F.floor(F.col("col") / tile) == F.col("tile_c"))
    return px.filter(inside).drop("tile_r", "tile_c")


def along(axis: str, low: int, high: int):
    """Window over the pixels of the tile's line whose position on ``axis`` is ``low`` to ``high`` away; gaps stay gaps."""
    across = "row" if axis == "col" else "col"
    return W.partitionBy(*TILE_KEYS, across).orderBy(axis).rangeBetween(low, high)


def at_offset(value: str, axis: str, d: int) -> Column:
    """The value ``d`` positions away on ``axis``, NULL where that pixel is missing."""
    return F.col(value) if d == 0 else F.max(value).over(along(axis, d, d))
