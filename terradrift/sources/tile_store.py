"""Tiles at rest as a scan target: an area of interest becomes a tile list, and only the files of those tiles are opened.

Tiles are stored by scene and tile row, inside a file by tile column. A scan joins the stored tiles with its tile list on
(scene, tile row, tile column): the partition columns are pruned by the list itself while the query runs (scenes and tile rows each by themselves), the range of tile
rows and columns is a literal predicate that reaches partitions and row groups, and only the bands asked for are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE, TILE_KEYS, with_tile
from terradrift.session import save_table, work_dir
from terradrift.sources.tiles import AreaOfInterest, available_bands, pack_tiles, unpack_tiles, window_bounds

WINDOW = ["row0", "row1", "col0", "col1"]


def window_tiles(windows: DataFrame, tile: int) -> DataFrame:
    """One row per window and tile it meets: the window's columns with ``tile_r`` and ``tile_c``; half-open windows."""

    def span(low: str, high: str):
        return F.sequence(F.floor(F.col(low) / tile).cast("int"), F.floor((F.col(high) - 1) / tile).cast("int"))

    met = windows.filter("row1 > row0 AND col1 > col0")
    return met.withColumn("tile_r", F.explode(span("row0", "row1"))).withColumn("tile_c", F.explode(span("col0", "col1")))


@dataclass(frozen=True)
class TileStore:
    """A stored raster. Use :func:`store_pixels` to make one, or name the folder of one that exists."""

    spark: SparkSession
    path: str
    schema: T.StructType
    tile: int = DEFAULT_TILE

    @property
    def columns(self) -> list[str]:
        """Pixel columns of the stored raster."""
        return [*PIXEL_KEYS, *[f.name for f in self.schema if f.name not in (*TILE_KEYS, "rows", "cols")]]

    def tiles(self, wanted: DataFrame, bands: Sequence[str]) -> DataFrame:
        """Stored tiles (``rows``, ``cols`` and band arrays) joined with ``wanted``, a table that holds the tile keys.

        ``wanted`` may repeat a tile; its range of tile rows and columns is taken to the driver as four numbers.
        """
        low_r, high_r, low_c, high_c = wanted.agg(F.min("tile_r"), F.max("tile_r"), F.min("tile_c"), F.max("tile_c")).first()
        if low_r is None:
            low_r, high_r, low_c, high_c = 0, -1, 0, -1
        inside = F.col("tile_r").between(low_r, high_r) & F.col("tile_c").between(low_c, high_c)
        stored = self.spark.read.schema(self.schema).parquet(self.path).filter(inside)
        return stored.select(*TILE_KEYS, "rows", "cols", *bands).join(wanted.filter(inside), TILE_KEYS)

    def pixels(self, wanted: DataFrame, bands: Sequence[str]) -> DataFrame:
        """All pixels of the listed tiles, each once."""
        return unpack_tiles(self.tiles(wanted.select(*TILE_KEYS).distinct(), bands), bands)


def store_pixels(px: DataFrame, bands: Sequence[str], path: str | None = None, tile: int = DEFAULT_TILE) -> TileStore:
    """Write a pixel table as tiles by scene and tile row; a scene's tile row is one file, sorted by tile column."""
    path = path or f"{work_dir(px.sparkSession)}/tiles-{uuid.uuid4().hex}"
    packed = pack_tiles(px, bands, tile)
    dealt = packed.repartition(SCENE, "tile_r").sortWithinPartitions(*TILE_KEYS)
    dealt.write.mode("overwrite").partitionBy(SCENE, "tile_r").parquet(path)
    return TileStore(px.sparkSession, path, packed.schema, tile)


def cut_windows(px: DataFrame | TileStore, windows: DataFrame, bands: Sequence[str], tile: int = DEFAULT_TILE) -> DataFrame:
    """Pixels inside every window ``(request_id, scene_id, row0, row1, col0, col1)``, keyed by request as ``scene_id``.

    Rows and columns count from the window's corner. Tiles meet windows by an equi-join on the tile, so a scene that many
    windows ask for is spread over its tiles and only pixels of tiles that a window meets are compared with it.
    """
    stored = isinstance(px, TileStore)
    lists = window_tiles(windows.select("request_id", SCENE, *WINDOW), px.tile if stored else tile)
    lists = save_table(lists, "window-tiles")

    def inside(row, col):
        return (row >= F.col("row0")) & (row < F.col("row1")) & (col >= F.col("col0")) & (col < F.col("col1"))

    if stored:
        cells = F.filter(F.arrays_zip("rows", "cols", *bands), lambda x: inside(x["rows"], x["cols"]))
        met = px.tiles(lists, bands).select("request_id", *WINDOW, F.explode(cells).alias("x"))
        hits = met.select("request_id", *WINDOW, F.col("x.rows").alias("row"), F.col("x.cols").alias("col"), *[F.col(f"x.{b}").alias(b) for b in bands])
    else:
        hits = with_tile(px.select(*PIXEL_KEYS, *bands), tile).join(lists, TILE_KEYS).filter(inside(F.col("row"), F.col("col")))
    return hits.select(
        F.col("request_id").alias(SCENE), (F.col("row") - F.col("row0")).alias("row"), (F.col("col") - F.col("col0")).alias("col"), *bands
    )



def scan_window(px: DataFrame | TileStore, scene: DataFrame, aoi: AreaOfInterest, bands: Sequence[str]) -> DataFrame:
    """Pixels of the requested bands inside the box, re-indexed to the window corner, of every scene the box meets."""
    keep = available_bands(px, bands)
    bounds = window_bounds(scene.withColumns(aoi.columns())).filter("status = 'OK'")
    return cut_windows(px, bounds.select(F.col(SCENE).alias("request_id"), SCENE, *WINDOW), keep)
