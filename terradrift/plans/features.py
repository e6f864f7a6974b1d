"""From score maps to change features, and the differencing pipelines built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradrift.functions import geo
from terradrift.functions.classify import BOX_LABELS, box_confidence, classify_box, classify_geometry
from terradrift.functions.gridref import with_grid_ref
from terradrift.operators import raster
from terradrift.operators.components import component_stats, label_components
from terradrift.operators.tile_arrays import change_components, change_pixels
from terradrift.operators.polygons import multipolygons, ring_vertices
from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE
from terradrift.session import save_table

MIN_FEATURE_M2 = 50.0
DEFAULT_TAU = 0.70
FILL_FACTOR = 0.72


def min_area(features: DataFrame, limit: float = MIN_FEATURE_M2, area: str = "area_sq_m") -> DataFrame:
    """Drop records smaller than ``limit`` (the limit itself is kept)."""
    return features.filter(F.col(area) >= limit)


def area_totals(features: DataFrame) -> DataFrame:
    """Feature count and altered area per scene."""
    total = F.sum("area_sq_m")
    return features.groupBy(SCENE).agg(
        F.count("*").alias("n_features"),
        F.round(total, 2).alias("total_area_sq_m"),
        F.round(total / 10000.0, 4).alias("total_area_ha"),
    )


def change_mask(score: DataFrame, tau: float = DEFAULT_TAU, kernel: int = 3, tile: int = DEFAULT_TILE) -> DataFrame:
    """Score pixels that reach ``tau`` and survive the opening."""
    flagged = score.select(*PIXEL_KEYS, "prob", (F.col("prob") >= tau).cast("int").alias("flag"))
    return raster.opening(flagged, "flag", kernel, tile).filter("flag = 1").drop("flag")


def measure_components(labelled: DataFrame, scene: DataFrame) -> DataFrame:
    """Area, centroid, mean score and pixel count per component on a north-up grid.

    The area sums exact ellipsoidal cell areas, so holes and corner contacts need no care.
    """
    t = F.col("affine")
    top, bottom = geo.pixel_to_lat("affine", 0, "row"), geo.pixel_to_lat("affine", 0, F.col("row") + 1)
    cells = labelled.join(scene.select(SCENE, "affine"), SCENE)
    totals = (
        cells.groupBy(SCENE, "label")
        .agg(
            F.sum(geo.cell_area_m2(top, bottom, t["a"])).alias("area"),
            F.avg("prob").alias("mean_prob"),
            F.avg(F.col("row") + 0.5).alias("mr"),
            F.avg(F.col("col") + 0.5).alias("mc"),
            F.count("*").alias("n_pixels"),
        )
    )
    return _placed(totals, scene)


def component_features(
    mask: DataFrame,
    scene: DataFrame,
    class_name: str = "Tactical Change Detection",
    min_area_sq_m: float = MIN_FEATURE_M2,
    tile: int = DEFAULT_TILE,
    geometry: bool = False,
) -> DataFrame:
    """Feature records of a cleaned mask ``(scene_id, row, col, prob)``; an empty mask gives no rows.

    Feature ids are digests of scene and component, so a rerun gives the same ids.
    """
    labelled = label_components(mask, tile)
    if geometry:
        labelled = save_table(labelled, "labelled")
    return _records(measure_components(labelled, scene), scene, class_name, min_area_sq_m, tile, labelled if geometry else None)


def _placed(totals: DataFrame, scene: DataFrame) -> DataFrame:
    """Component totals with the centroid of their mean pixel position (``mr``, ``mc``)."""
    lat, lon = geo.pixel_to_lat("affine", "mc", "mr"), geo.pixel_to_lon("affine", "mc", "mr")
    return totals.join(scene.select(SCENE, "affine"), SCENE).withColumns({"lat": F.bround(lat, 6), "lon": F.bround(lon, 6)})


def _records(
    measured: DataFrame, scene: DataFrame, class_name: str, min_area_sq_m: float, tile: int, outlined: DataFrame | None
) -> DataFrame:
    """Feature records of measured components, with the rings of ``outlined`` pixels if given."""
    records = with_grid_ref(measured, "lat", "lon").select(
        SCENE,
        "label",
        F.sha2(F.concat_ws(":", SCENE, "label"), 256).alias("feature_id"),
        F.lit(class_name).alias("class"),
        F.least(F.greatest(F.bround("mean_prob", 4), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.col("area").alias("_area"),
        F.bround("area", 2).alias("area_sq_m"),
        geo.hectares("area", geo.MIN_HECTARES).alias("area_hectares"),
        F.struct("lat", "lon").alias("centroid"),
        "grid_ref",
        "n_pixels",
    )
    kept = min_area(records, min_area_sq_m, "_area").drop("_area")
    if outlined is not None:
        kept = kept.join(multipolygons(ring_vertices(outlined), outlined, scene, tile), [SCENE, "label"], "left")
    return kept


def extract_features(
    score: DataFrame,
    scene: DataFrame,
    tau: float = DEFAULT_TAU,
    class_name: str = "Tactical Change Detection",
    min_area_sq_m: float = MIN_FEATURE_M2,
    tile: int = DEFAULT_TILE,
    geometry: bool = False,
) -> DataFrame:
    """Threshold, clean, label, measure and filter a score map ``(scene_id, row, col, prob)``."""
    return component_features(change_mask(score, tau, tile=tile), scene, class_name, min_area_sq_m, tile, geometry)


def spectral_score(
    t1: DataFrame, t2: DataFrame, bands: Sequence[str], ksize: int = 5, tile: int = DEFAULT_TILE, dims: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Otsu-weighted change score per pixel and the threshold bin per scene.

    ``dims`` is a scene table with sizes; without it they are found by one more pass over t1.

    The smoothed difference is read three times (range, histogram, score) and costs a join
    and a halo shuffle, so it is written once.
    """
    diff = raster.band_difference(raster.bitemporal(t1, t2, bands), bands)
    dims = save_table(raster.scene_dims(t1), "dims") if dims is None else dims
    smooth = save_table(raster.gaussian_blur(diff, "diff", dims, ksize, tile), "difference")
    scaled = raster.min_max_normalise(smooth, "diff", "norm")
    thresholds = save_table(raster.otsu_threshold(scaled, "norm"), "otsu")
    score = raster.otsu_score(scaled, "norm", thresholds).select(*PIXEL_KEYS, "prob")
    return score, thresholds


def difference_features(
    t1: DataFrame,
    t2: DataFrame,
    scene: DataFrame,
    bands: Sequence[str] = ("b1", "b2", "b3"),
    tau: float = DEFAULT_TAU,
    query_text: str = "Change Detection",
    tile: int = DEFAULT_TILE,
    geometry: bool = False,
) -> DataFrame:
    """End-to-end differencing of two epochs into feature records, on tile arrays."""
    name = f"Detected Surface Anomaly ({query_text})"
    if geometry:
        labelled = save_table(change_pixels(t1, t2, scene, bands, tau, tile=tile), "labelled")
        return _records(measure_components(labelled, scene), scene, name, MIN_FEATURE_M2, tile, labelled)
    return _records(_placed(change_components(t1, t2, scene, bands, tau, tile=tile), scene), scene, name, MIN_FEATURE_M2, tile, None)


def grid_clusters(pixels: DataFrame, cell: int = 16, density: float = 0.22, min_cells: int = 2) -> DataFrame:
    """Touching groups of dense grid cells; ``row``/``col`` index cells, ``label`` names the group."""
    dense = raster.grid_density(pixels, cell).filter(F.col("density") >= density)
    labelled = save_table(label_components(dense), "cells")
    sizes = labelled.groupBy(SCENE, "label").agg(F.count("*").alias("n_cells"))
    return labelled.join(sizes.filter(F.col("n_cells") >= min_cells), [SCENE, "label"])


def grid_change_boxes(
    t1: DataFrame,
    t2: DataFrame,
    bands: Sequence[str] = ("b1", "b2", "b3"),
    gsd_m: float = 10.0,
    min_blob_m2: float = 150.0,
    cell: int = 16,
    top: int = 12,
    box: tuple[float, float, float, float] = (25.0, 25.1, 75.0, 75.1),
    labels: Sequence[str] = BOX_LABELS,
) -> DataFrame:
    """Largest clusters of brightness change per scene as labelled boxes (a top-k report).

    Equal cluster sizes are ordered by label. ``box`` is the lat/lon extent of the image.
    """
    active = raster.luminance_change(raster.bitemporal(t1, t2, bands), bands)
    clusters = grid_clusters(active, cell)
    boxes = (
        clusters.groupBy(SCENE, "label")
        .agg(
            F.count("*").alias("n_cells"),
            (F.min("col") * cell).alias("x0"), ((F.max("col") + 1) * cell).alias("x1"),
            (F.min("row") * cell).alias("y0"), ((F.max("row") + 1) * cell).alias("y1"),
        )
        .withColumn("rank", F.row_number().over(W.partitionBy(SCENE).orderBy(F.desc("n_cells"), "label")))
        .filter(F.col("rank") <= top)
        .join(raster.scene_dims(t1), SCENE)
        .withColumns({"x1": F.least("x1", "n_cols"), "y1": F.least("y1", "n_rows")})
    )
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    lat0, lat1, lon0, lon1 = box
    lon_a, lon_b = (F.lit(lon0) + F.col(x) / F.col("n_cols") * (lon1 - lon0) for x in ("x0", "x1"))
    lat_a, lat_b = (F.lit(lat1) - F.col(y) / F.col("n_rows") * (lat1 - lat0) for y in ("y1", "y0"))
    sized = boxes.withColumns(
        {
            "area_sq_m": F.round(w * h * FILL_FACTOR * gsd_m**2, 0),
            "aspect": F.greatest(w / F.greatest(h, F.lit(1)), h / F.greatest(w, F.lit(1))),
            "centroid_lat": F.round((lat_a + lat_b) / 2, 5),
            "centroid_lon": F.round((lon_a + lon_b) / 2, 5),
        }
    )
    return min_area(sized, min_blob_m2).select(
        SCENE, "rank", "n_cells", "x0", "y0", "x1", "y1", "area_sq_m",
        F.round(F.col("area_sq_m") / 10000.0, 4).alias("area_hectares"),
        classify_box("area_sq_m", "aspect", "rank", labels).alias("class"),
        F.round(box_confidence("n_cells"), 3).alias("confidence"),
        "centroid_lat", "centroid_lon",
    )


def nodes_from_mask(
    labelled: DataFrame, scene: DataFrame, epoch: str, gsd_m: float = 10.0, min_area_m2: float = 25.0
) -> DataFrame:
    """Scene-graph nodes of labelled mask components, classified by shape."""
    s = component_stats(labelled).join(scene.select(SCENE, "affine"), SCENE)
    w, h = F.col("width"), F.col("height")
    right, below = F.col("left") + w, F.col("top") + h
    lats = [geo.pixel_to_lat("affine", "left", "top"), geo.pixel_to_lat("affine", right, below)]
    lons = [geo.pixel_to_lon("affine", "left", "top"), geo.pixel_to_lon("affine", right, below)]
    shaped = s.withColumns(
        {
            "area": F.col("n_pixels") * float(gsd_m**2),
            "aspect": F.greatest(w / h, h / w),
            "perimeter": 2.0 * (w + h) * gsd_m,
        }
    ).filter(F.col("area") >= min_area_m2)
    return shaped.select(
        F.concat_ws("_", F.lit("prim"), F.lit(epoch), SCENE, "label").alias("node_id"),
        classify_geometry("area", "aspect", "perimeter").alias("class"),
        F.bround(geo.pixel_to_lat("affine", "mean_col", "mean_row"), 6).alias("lat"),
        F.bround(geo.pixel_to_lon("affine", "mean_col", "mean_row"), 6).alias("lon"),
        F.bround("area", 2).alias("area_m2"),
        F.bround("perimeter", 2).alias("perimeter_m"),
        F.bround("aspect", 2).alias("aspect_ratio"),
        F.bround(F.least(*lats), 6).alias("min_lat"),
        F.bround(F.least(*lons), 6).alias("min_lon"),
        F.bround(F.greatest(*lats), 6).alias("max_lat"),
        F.bround(F.greatest(*lons), 6).alias("max_lon"),
        F.lit(epoch).cast("date").alias("epoch"),
        F.lit(0.92).alias("confidence"),
        F.create_map(F.lit("pixel_count"), F.col("n_pixels").cast("string")).alias("properties"),
    )
