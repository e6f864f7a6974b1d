"""Report tables, run metadata and evidence manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradrift.functions.text import area_text, canonical_json, digest, hectare_text, percent_text, point_text, short_id

REPORT_ROWS = 15
EMPTY_TEXT = "No target changes detected above threshold"
_COLUMNS = ("id", "class", "confidence", "area_m2", "area_ha", "centroid", "grid_ref")


def target_table(features: DataFrame, runs: DataFrame, top: int = REPORT_ROWS) -> DataFrame:
    """Formatted rows of the largest features per task (a top-k report); a dash row when a task has none."""
    order = W.partitionBy("task_id").orderBy(F.desc("area_sq_m"), "feature_id")
    shown = (
        features.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= top)
        .select(
            "task_id", "position", short_id("feature_id").alias("id"), "class",
            percent_text("confidence").alias("confidence"), area_text("area_sq_m").alias("area_m2"),
            hectare_text("area_hectares").alias("area_ha"), point_text("centroid.lat", "centroid.lon").alias("centroid"),
            F.coalesce("grid_ref", F.lit("N/A")).alias("grid_ref"),
        )
    )
    blank = ("-", EMPTY_TEXT, "-", "0", "0.000", "-", "-")
    filled = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zip(_COLUMNS, blank)]
    return runs.select("task_id").join(shown, "task_id", "left").select(
        "task_id", F.coalesce("position", F.lit(1)).alias("position"), *filled
    )


def run_metadata(runs: DataFrame, features: DataFrame, alignment: DataFrame) -> DataFrame:
    """One row per task: area, dates, query texts, alignment score and totals as report text.

    ``runs`` has ``task_id, scene_id, analyst, query_text, negative_query, t1, t2`` and the box columns.
    """
    # Areas of few decimals often add up to a tie of the last shown digit, so they are added exactly, whatever their order.
    area = F.sum(F.col("area_sq_m").cast("decimal(28,6)")).cast("double").alias("area")
    totals = features.groupBy("task_id").agg(F.count("*").alias("n_features"), area)
    joined = runs.join(totals, "task_id", "left").join(alignment.select("scene_id", "score"), "scene_id", "left")
    area = F.coalesce("area", F.lit(0.0))

    def corner(lat: str, lon: str) -> Column:
        return F.concat(F.lit("["), F.format_number(lat, 4), F.lit(", "), F.format_number(lon, 4), F.lit("]"))

    return joined.select(
        "task_id", "analyst", F.date_format("t1", "yyyy-MM-dd").alias("t1"), F.date_format("t2", "yyyy-MM-dd").alias("t2"),
        "query_text", F.coalesce("negative_query", F.lit("None")).alias("negative_query"),
        F.concat(corner("min_lat", "min_lon"), F.lit(" to "), corner("max_lat", "max_lon")).alias("aoi"),
        F.format_number("score", 4).alias("alignment"),
        F.concat(F.format_number(area, 1), F.lit(" m² ("), F.format_number(area / 10000.0, 3), F.lit(" ha)")).alias("altered_area"),
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
    )


def feature_digests(features: DataFrame) -> DataFrame:
    """Digest of each feature's canonical JSON."""
    flat = features.select(
        "task_id", "feature_id", "class", "confidence", "area_sq_m", "area_hectares",
        F.col("centroid.lat").alias("lat"), F.col("centroid.lon").alias("lon"),
    )
    text = canonical_json("feature_id", "class", "confidence", "area_sq_m", "area_hectares", "lat", "lon")
    return flat.select("task_id", digest(text).alias("sha256"))


def vector_digest(features: DataFrame) -> DataFrame:
    """Order-free digest of all features per task.

    Feature digests are combined in groups by their first three hex digits and the group
    digests are combined again, so no list holds a whole task.
    """
    keyed = feature_digests(features).withColumn("g", F.substring("sha256", 1, 3))

    def fold(df: DataFrame, keys: list[str], value: str) -> DataFrame:
        return df.groupBy(*keys).agg(digest(F.array_join(F.array_sort(F.collect_list(value)), "")).alias("h"))

    inner = fold(keyed, ["task_id", "g"], "sha256").withColumn("h", F.concat("g", "h"))
    return fold(inner, ["task_id"], "h").withColumnRenamed("h", "vector_sha256")


def evidence_manifest(runs: DataFrame, features: DataFrame, sealed_at: str) -> DataFrame:
    """Manifest per task: source digests, feature digest and a seal over all of them.

    ``runs`` has ``task_id, analyst, t1_sha256, t2_sha256``. The time is an argument so that a
    manifest can be recomputed.
    """
    none = digest(F.lit(""))
    joined = runs.join(vector_digest(features), "task_id", "left").withColumn("vector_sha256", F.coalesce("vector_sha256", none))
    payload = F.concat_ws(":", "task_id", "t1_sha256", "t2_sha256", "vector_sha256", "analyst", F.lit(sealed_at))
    return joined.select(
        "task_id", "analyst", F.lit(sealed_at).alias("timestamp_utc"), F.lit("SHA-256").alias("hashing_algorithm"),
        "t1_sha256", "t2_sha256", "vector_sha256", digest(payload).alias("evidence_root_seal"),
    )


def verify_manifest(manifest: DataFrame, runs: DataFrame, features: DataFrame) -> DataFrame:
    """Recompute each stored manifest from the data and say whether it still holds."""
    now = runs.join(vector_digest(features), "task_id", "left").select(
        "task_id", F.col("t1_sha256").alias("_t1"), F.col("t2_sha256").alias("_t2"),
        F.coalesce("vector_sha256", digest(F.lit(""))).alias("_v"),
    )
    payload = F.concat_ws(":", "task_id", "_t1", "_t2", "_v", "analyst", "timestamp_utc")
    return manifest.join(now, "task_id", "left").select(
        "task_id", F.coalesce(digest(payload) == F.col("evidence_root_seal"), F.lit(False)).alias("verified")
    )


def file_digests(spark, path: str) -> DataFrame:
    """SHA-256 of whole files, one row each."""
    return spark.read.format("binaryFile").load(path).select("path", "length", digest("content").alias("sha256"))
