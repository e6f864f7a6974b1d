"""Many analysis requests as one job, re-queries on saved scores, and screening."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift.functions.pixel import luminance
from terradrift.functions.text import cache_key
from terradrift.operators import align, guards, raster
from terradrift.operators.graph import candidate_boxes
from terradrift.operators.mosaic import screen_windows
from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE, TILE_KEYS, shuffled, with_tile
from terradrift.plans import features
from terradrift.session import save_table
from terradrift.sources.tile_store import WINDOW, TileStore, cut_windows, window_tiles
from terradrift.sources.tiles import window_bounds

REQUEST_BOX = ["min_lat", "max_lat", "min_lon", "max_lon"]


@dataclass
class Analysis:
    """Results of a batch of requests. ``scores`` is the reusable intermediate."""

    status: DataFrame
    windows: DataFrame
    scores: DataFrame
    alignment: DataFrame
    detections: DataFrame
    summary: DataFrame


def request_windows(requests: DataFrame, scene: DataFrame) -> DataFrame:
    """Pixel window of each request on its scene. The request id becomes the scene id of its window."""
    placed = requests.select("request_id", SCENE, *REQUEST_BOX).join(scene, SCENE)
    return window_bounds(placed)


def analyze(
    requests: DataFrame,
    t1: DataFrame | TileStore,
    t2: DataFrame | TileStore,
    scene: DataFrame,
    terms: DataFrame,
    bands: Sequence[str] = ("b1", "b2", "b3"),
    cloud_mask: DataFrame | TileStore | None = None,
    tile: int = DEFAULT_TILE,
    max_shift: int = 32,
) -> Analysis:
    """Guards, windows, normalisation, alignment, scoring, vectorising and totals for all requests.

    Rejected requests stop at their guard and only show up in the status table. ``requests``
    has ``request_id, scene_id, query_text``, the box, ``tau`` and ``cloud_percent``. Of stored tiles
    only those that a window meets are read.
    """
    valid = guards.validate_requests(requests)
    form = valid.select("request_id", F.when(F.col("problem").isNull(), "OK").otherwise("REJECTED_INVALID_REQUEST").alias("status"))
    bounds = request_windows(valid.filter("problem IS NULL"), scene)
    bounds = save_table(bounds.withColumnRenamed("status", "coverage"), "request-windows")
    gsd = bounds.select("request_id", "gsd_m")
    resolution = guards.resolution_status(valid.join(gsd, "request_id", "left"), terms, F.coalesce("gsd_m", F.lit(guards.DEFAULT_GSD_M)))
    cover = bounds.select(
        "request_id", F.when(F.col("coverage") == "OK", "OK").otherwise("REJECTED_NO_COVERAGE").alias("status")
    )
    verdicts = [form, resolution.select("request_id", "status"), cover]
    if cloud_mask is not None:
        masked = cut_windows(cloud_mask, bounds.filter("coverage = 'OK'"), ["mask"])
        share = masked.groupBy(F.col(SCENE).alias("request_id")).agg(F.avg((F.col("mask") != 0).cast("double")).alias("ratio"))
        clouds = valid.join(share, "request_id", "left").select(
            "request_id",
            F.when(F.coalesce("ratio", F.lit(0.0)) > F.col("cloud_percent") / 100.0, "REJECTED_CLOUD_COVER").otherwise("OK").alias("status"),
        )
        verdicts.append(clouds)
    feasible = save_table(guards.overall_status(requests, *verdicts), "feasible")
    go = bounds.join(feasible.filter("status = 'COMPLETED'").select("request_id"), "request_id", "left_semi")
    go = save_table(go.withColumnRenamed("coverage", "status"), "go")

    n1 = raster.percentile_normalise(cut_windows(t1, go, bands), bands)
    n2 = raster.percentile_normalise(cut_windows(t2, go, bands), bands)
    n1, n2 = save_table(n1, "normal-t1"), save_table(n2, "normal-t2")
    # Epochs whose windows differ in extent or pixels are not compared; a request without imagery has no row here.
    shapes = save_table(raster.shape_check(n1, n2).select(SCENE, "same_shape"), "shapes")
    alike = shapes.filter("same_shape").select(SCENE)
    n1, n2 = n1.join(alike, SCENE, "left_semi"), n2.join(alike, SCENE, "left_semi")
    dims = save_table(raster.scene_dims(n1), "dims")
    planes = (
        n1.select(*PIXEL_KEYS, luminance(*bands[:3]).alias("l1"))
        .join(shuffled(n2.select(*PIXEL_KEYS, luminance(*bands[:3]).alias("l2"))), PIXEL_KEYS)
    )
    planes = save_table(planes, "planes")
    shifts = save_table(align.pyramid_shift(planes, max_shift, tile=tile), "alignment")
    aligned = shifts.filter("status = 'OK'").select(SCENE)
    moved = align.warp(n2.join(aligned, SCENE, "left_semi"), dims, align.shift_warp(shifts), bands)
    score, _ = features.spectral_score(n1.join(aligned, SCENE, "left_semi"), moved, bands, tile=tile)
    score = save_table(score, "scores")

    grid = go.select(F.col("request_id").alias(SCENE), F.col("window_affine").alias("affine"))
    wanted = valid.select(F.col("request_id").alias(SCENE), "tau", "query_text")
    detections = save_table(vectorise(score, grid, wanted, tile), "detections")
    align_verdict = shifts.select(F.col(SCENE).alias("request_id"), "status")
    shape_verdict = shapes.select(
        F.col(SCENE).alias("request_id"), F.when(F.col("same_shape"), "OK").otherwise("REJECTED_SHAPE_MISMATCH").alias("status"))
    status = guards.overall_status(requests, feasible.withColumn("status", F.when(F.col("status") == "COMPLETED", "OK").otherwise(F.col("status"))), shape_verdict, align_verdict)
    summary = (
        status.join(raster.score_stats(score).withColumnRenamed(SCENE, "request_id"), "request_id", "left")
        .join(features.area_totals(detections).withColumnRenamed(SCENE, "request_id"), "request_id", "left")
        .fillna({"n_features": 0, "total_area_sq_m": 0.0, "total_area_ha": 0.0})
    )
    return Analysis(status, go, score, shifts, detections, summary)


def vectorise(score: DataFrame, grid: DataFrame, wanted: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """Features of many score maps, each with its own threshold and class text.

    ``wanted`` has ``scene_id, tau, query_text`` per map.
    """
    mine = score.join(wanted.select(SCENE, "tau"), SCENE)
    flagged = mine.select(*PIXEL_KEYS, "prob", (F.col("prob") >= F.col("tau")).cast("int").alias("flag"))
    mask = raster.opening(flagged, "flag", 3, tile).filter("flag = 1").drop("flag")
    records = features.component_features(mask, grid, tile=tile)
    return records.drop("class").join(wanted.select(SCENE, F.col("query_text").alias("class")), SCENE)


def save_scores(analysis: Analysis, requests: DataFrame, path: str) -> None:
    """Store score maps by request key, a digest of box and dates; a key stored before is replaced.

    Requests with equal keys have equal maps, of which the one of the smallest request id is stored.
    """
    box = F.concat_ws(",", *REQUEST_BOX)
    done = analysis.status.filter("status = 'COMPLETED'").select("request_id")
    keys = requests.join(done, "request_id", "left_semi").groupBy(cache_key(box, "t1", "t2").alias("cache_key")).agg(F.min("request_id").alias(SCENE))
    grid = analysis.windows.select(F.col("request_id").alias(SCENE), F.col("window_affine").alias("affine"))
    stored = analysis.scores.join(keys, SCENE).join(grid, SCENE)
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path)


def requery(spark: SparkSession, path: str, key: str, tau: float, class_name: str, tile: int = DEFAULT_TILE) -> DataFrame:
    """New features from a stored score map; reads one partition. A missing key is an error."""
    stored = spark.read.parquet(path).filter(F.col("cache_key") == key)
    if stored.isEmpty():
        raise KeyError(f"no stored scores under {key}")
    grid = stored.groupBy(SCENE).agg(F.first("affine").alias("affine"))
    return features.extract_features(stored.select(*PIXEL_KEYS, "prob"), grid, tau, class_name, tile=tile)


def sweep(score: DataFrame, scene: DataFrame, taus: Sequence[float], tile: int = DEFAULT_TILE) -> DataFrame:
    """Feature count and area per scene and threshold, all thresholds in one pass.

    Each threshold is its own layer of the score map, keyed as ``scene@tau``.
    """
    layers = F.explode(F.array(*[F.lit(float(t)) for t in taus]))
    keyed = score.withColumn("tau", layers)
    keyed = keyed.withColumn(SCENE, F.concat_ws("@", SCENE, F.col("tau").cast("string")))
    grid = scene.select(F.col(SCENE).alias("base"), "affine").withColumn("tau", layers)
    names = grid.select(F.concat_ws("@", "base", F.col("tau").cast("string")).alias(SCENE), "base", "tau", "affine")
    wanted = names.select(SCENE, "tau", F.lit("sweep").alias("query_text"))
    found = vectorise(keyed.select(*PIXEL_KEYS, "prob"), names.select(SCENE, "affine"), wanted, tile)
    totals = features.area_totals(found)
    return names.select(SCENE, F.col("base"), "tau").join(totals, SCENE, "left").select(
        F.col("base").alias(SCENE), "tau", F.coalesce("n_features", F.lit(0)).alias("n_features"),
        F.coalesce("total_area_sq_m", F.lit(0.0)).alias("total_area_sq_m"),
    )


def screened_tiles(windows: DataFrame, screen_tile: int) -> DataFrame:
    """Distinct ``(scene_id, tile_r, tile_c)`` that any window touches, however many windows overlap there."""
    return window_tiles(windows.select(SCENE, *WINDOW), screen_tile).select(*TILE_KEYS).distinct()


def screened_features(
    hits: DataFrame, t1: DataFrame | TileStore, t2: DataFrame | TileStore, scene: DataFrame, ref_lat: float, bands: Sequence[str] = ("b1", "b2", "b3"),
    padding_m: float = 2500.0, tau: float = features.DEFAULT_TAU, tile: int = DEFAULT_TILE, screen_tile: int = 64,
    class_name: str = "Tactical Change Detection",
) -> DataFrame:
    """Score only the imagery in tiles touched by padded boxes around structural-query hits.

    Every pixel is scored once, in its scene's own grid, so a change under several boxes is one feature.
    """
    boxes = save_table(candidate_boxes(hits.select("lat", "lon"), ref_lat, padding_m), "screen")
    windows = request_windows(screen_windows(scene, boxes), scene).filter("status = 'OK'")
    wanted = save_table(screened_tiles(windows, screen_tile), "screen-tiles")

    def inside(px: DataFrame | TileStore) -> DataFrame:
        if isinstance(px, TileStore):
            ends = {f"{k}{i}": (F.col(f"tile_{k[0]}") + i) * screen_tile for k in ("row", "col") for i in (0, 1)}
            px = px.pixels(save_table(screened_tiles(wanted.withColumns(ends), px.tile), "stored-tiles"), bands)
        return with_tile(px.select(*PIXEL_KEYS, *bands), screen_tile).join(wanted, TILE_KEYS, "left_semi").drop("tile_r", "tile_c")

    found = features.difference_features(inside(t1), inside(t2), scene, bands, tau, tile=tile)
    return found.withColumn("class", F.lit(class_name))
