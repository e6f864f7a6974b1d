"""Raster tables: tile layout at rest, area-of-interest scans and window digests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift.functions import geo
from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE, TILE_KEYS, with_tile


@dataclass(frozen=True)
class AreaOfInterest:
    """Longitude/latitude box; checked before any plan is built."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float

    def __post_init__(self):
        if not (-90 <= self.min_lat <= 90 and -90 <= self.max_lat <= 90):
            raise ValueError("latitude must lie in [-90, 90]")
        if not (-180 <= self.min_lon <= 180 and -180 <= self.max_lon <= 180):
            raise ValueError("longitude must lie in [-180, 180]")
        if self.max_lat <= self.min_lat or self.max_lon <= self.min_lon:
            raise ValueError("the upper bound must exceed the lower bound")

    def columns(self) -> dict:
        return {k: F.lit(float(getattr(self, k))) for k in ("min_lat", "max_lat", "min_lon", "max_lon")}


def available_bands(px, bands: Sequence[str]) -> list[str]:
    """Requested bands among ``px.columns``, in request order; an error when none exists."""
    found = [b for b in bands if b in px.columns]
    if not found:
        raise ValueError(f"none of the bands {list(bands)} exist; table has {px.columns}")
    return found


def window_bounds(scene: DataFrame) -> DataFrame:
    """Pixel window of a box for every scene row.

    Expects ``scene_id, n_rows, n_cols, affine, is_geographic`` and the box columns.
    Offsets and lengths are rounded, then clamped to the raster; scenes the box does
    not meet keep a row with status ``NO_COVERAGE``.
    """
    c_a = geo.geo_to_col("affine", "min_lon", "max_lat")
    r_a = geo.geo_to_row("affine", "min_lon", "max_lat")
    c_b = geo.geo_to_col("affine", "max_lon", "min_lat")
    r_b = geo.geo_to_row("affine", "max_lon", "min_lat")
    corners = scene.withColumns({"_c1": F.least(c_a, c_b), "_c2": F.greatest(c_a, c_b),
                                 "_r1": F.least(r_a, r_b), "_r2": F.greatest(r_a, r_b)})
    whole = corners.withColumns(
        {
            "_c0": F.rint("_c1"), "_w": F.rint(F.col("_c2") - F.col("_c1")),
            "_r0": F.rint("_r1"), "_h": F.rint(F.col("_r2") - F.col("_r1")),
        }
    )
    clamped = whole.withColumns(
        {
            "row0": F.greatest(F.col("_r0"), F.lit(0.0)).cast("int"),
            "col0": F.greatest(F.col("_c0"), F.lit(0.0)).cast("int"),
            "row1": F.least(F.col("_r0") + F.col("_h"), F.col("n_rows").cast("double")).cast("int"),
            "col1": F.least(F.col("_c0") + F.col("_w"), F.col("n_cols").cast("double")).cast("int"),
        }
    )
    t = F.col("affine")
    moved = F.struct(
        t["a"].alias("a"), t["b"].alias("b"),
        (t["c"] + F.col("col0") * t["a"] + F.col("row0") * t["b"]).alias("c"),
        t["d"].alias("d"), t["e"].alias("e"),
        (t["f"] + F.col("col0") * t["d"] + F.col("row0") * t["e"]).alias("f"),
    )
    met = (F.col("row1") > F.col("row0")) & (F.col("col1") > F.col("col0"))
    mean_lat = (F.col("min_lat") + F.col("max_lat")) / 2
    return clamped.withColumns(
        {
            "window_affine": moved,
            "gsd_m": geo.ground_sample_distance("affine", "is_geographic", mean_lat),
            "status": F.when(met, "OK").otherwise("NO_COVERAGE"),
        }
    ).drop("_c1", "_c2", "_r1", "_r2", "_c0", "_w", "_r0", "_h")


def pack_tiles(px: DataFrame, bands: Sequence[str], tile: int = DEFAULT_TILE) -> DataFrame:
    """Tile rows with one row-major array per band; absent pixels keep their place as NULL."""
    cell = F.struct("row", "col", *bands)
    packed = with_tile(px, tile).groupBy(*TILE_KEYS).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return packed.select(
        *TILE_KEYS,
        F.col("cells.row").alias("rows"),
        F.col("cells.col").alias("cols"),
        *[F.col("cells").getField(b).alias(b) for b in bands],
    )


def unpack_tiles(tiles: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Inverse of :func:`pack_tiles`."""
    zipped = F.arrays_zip("rows", "cols", *bands)
    return tiles.select(SCENE, F.explode(zipped).alias("x")).select(
        SCENE, F.col("x.rows").alias("row"), F.col("x.cols").alias("col"), *[F.col(f"x.{b}").alias(b) for b in bands]
    )


def write_tiles(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store tiles by scene, sorted by tile so that box predicates skip row groups."""
    (
        tiles.repartition(*TILE_KEYS)
        .sortWithinPartitions(*TILE_KEYS)
        .write.mode(mode)
        .partitionBy(SCENE)
        .parquet(path)
    )


def read_tiles(
    spark: SparkSession, path: str, bands: Sequence[str], rows: tuple[int, int] | None = None,
    cols: tuple[int, int] | None = None, tile: int = DEFAULT_TILE,
) -> DataFrame:
    """Scan tiles that meet the half-open pixel ranges; the tile predicate reaches the files."""
    tiles = spark.read.parquet(path)
    for span, key in ((rows, "tile_r"), (cols, "tile_c")):
        if span:
            tiles = tiles.filter(F.col(key).between(span[0] // tile, (span[1] - 1) // tile))
    px = unpack_tiles(tiles.select(*TILE_KEYS, "rows", "cols", *bands), bands)
    for span, key in ((rows, "row"), (cols, "col")):
        if span:
            px = px.filter((F.col(key) >= span[0]) & (F.col(key) < span[1]))
    return px


def window_digest(px: DataFrame, bands: Sequence[str], tile: int = DEFAULT_TILE) -> DataFrame:
    """SHA-256 of a scene, built as pixels -> tile -> tile row -> scene.

    Every level hashes an ordered list of bounded length, so no group grows with the
    scene. The value depends on tile size, not on partitioning.
    """
    text = F.concat_ws(",", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in bands])
    cell = F.struct("row", "col", text.alias("t"))

    def fold(df: DataFrame, keys: list[str], order) -> DataFrame:
        ordered = F.array_sort(F.collect_list(order))
        return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), ";"), 256).alias("t"))

    by_tile = fold(with_tile(px, tile), TILE_KEYS, cell)
    by_row = fold(by_tile, [SCENE, "tile_r"], F.struct("tile_c", "t"))
    return fold(by_row, [SCENE], F.struct("tile_r", "t")).withColumnRenamed("t", "sha256")
