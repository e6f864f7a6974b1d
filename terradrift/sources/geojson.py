"""GeoJSON features as a source of scene-graph nodes, and feature-collection sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terradrift.functions.classify import CLASSES, classify_geometry
from terradrift.functions.geo import METRES_PER_DEGREE
from terradrift.session import save_table

_FEATURE = "struct<geometry: struct<type: string, coordinates: string>, properties: string>"
DEFAULT_CONFIDENCE = 0.95


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection files: ``(idx, geometry_type, coordinates, properties)`` as JSON text.

    A collection file is one JSON value; for large inputs use one feature per line.
    """
    files = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path)
    return _columns(files.select(F.posexplode("features").alias("idx", "f")).select(F.col("idx").cast("long"), "f"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features from files with one feature per line; splittable, so any size is fine."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return parse_features(lines.select(F.xxhash64("value").alias("idx"), "value"), "value")


def parse_features(df: DataFrame, text: str, idx: str = "idx") -> DataFrame:
    """Features from a column of JSON text."""
    return _columns(df.select(F.col(idx).alias("idx"), F.from_json(text, _FEATURE).alias("f")))


def _columns(df: DataFrame) -> DataFrame:
    return df.select(
        "idx", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"),
        F.col("f.properties").alias("properties"),
    )


def vertices(geometry_type: str = "geometry_type", coordinates: str = "coordinates") -> Column:
    """All vertices ``array<array<double>>`` of a Polygon, MultiPolygon, LineString or Point."""
    point = "array<double>"
    line, polygon = f"array<{point}>", f"array<array<{point}>>"
    kind, text = F.col(geometry_type), F.col(coordinates)
    flat = (
        F.when(kind == "Polygon", F.flatten(F.from_json(text, polygon)))
        .when(kind == "MultiPolygon", F.flatten(F.flatten(F.from_json(text, f"array<{polygon}>"))))
        .when(kind == "LineString", F.from_json(text, line))
        .when(kind == "Point", F.array(F.from_json(text, point)))
    )
    return F.filter(flat, lambda p: F.size(p) >= 2)


def _first_number(props: Column, *names: str) -> Column:
    """First property that is present and not zero, else 0."""
    found = [F.nullif(props.getItem(n).try_cast("double"), F.lit(0.0)) for n in names]
    return F.coalesce(*found, F.lit(0.0))


def _first_text(props: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(props.getItem(n), F.lit("")) for n in names])


def nodes_from_features(
    features: DataFrame, epoch: str, min_area_m2: float = 25.0, classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Scene-graph nodes: box, mid-point, area, perimeter, elongation and class per feature.

    Missing areas and perimeters are estimated from the box; features without vertices or
    below the minimum area are dropped.
    """
    xs, ys = F.transform("pts", lambda p: p[0]), F.transform("pts", lambda p: p[1])
    shaped = (
        features.withColumn("pts", vertices())
        .filter(F.size("pts") > 0)
        .withColumn("props", F.coalesce(F.from_json("properties", "map<string,string>"), F.create_map().cast("map<string,string>")))
        .withColumns(
            {"min_lon": F.array_min(xs), "max_lon": F.array_max(xs), "min_lat": F.array_min(ys), "max_lat": F.array_max(ys)}
        )
        .withColumns(
            {"lat": (F.col("min_lat") + F.col("max_lat")) / 2, "lon": (F.col("min_lon") + F.col("max_lon")) / 2}
        )
        .withColumns(
            {
                "lat_m": (F.col("max_lat") - F.col("min_lat")) * METRES_PER_DEGREE,
                "lon_m": (F.col("max_lon") - F.col("min_lon")) * METRES_PER_DEGREE * F.cos(F.radians("lat")),
            }
        )
    )
    props = F.col("props")
    given_area, given_rim = _first_number(props, "area_sq_m", "area_m2"), _first_number(props, "perimeter_m")
    h, w = F.greatest("lat_m", F.lit(1.0)), F.greatest("lon_m", F.lit(1.0))
    measured = shaped.withColumns(
        {
            "area": F.when(given_area > 0, given_area).otherwise(
                F.greatest(F.col("lat_m") * F.col("lon_m") * 0.7, F.lit(50.0))
            ),
            "rim": F.when(given_rim > 0, given_rim).otherwise(2.0 * (F.col("lat_m") + F.col("lon_m"))),
            "aspect": F.greatest(h / w, w / h),
            "hint": _first_text(props, "tactical_class", "class", "type"),
        }
    ).filter(F.col("area") >= min_area_m2)
    made_id = F.concat(F.lit(f"node_{epoch}_"), F.format_string("%05d", F.col("idx")))
    return measured.select(
        F.coalesce(_first_text(props, "feature_id", "id"), made_id).alias("node_id"),
        classify_geometry("area", "aspect", "rim", F.col("hint"), classes).alias("class"),
        "lat",
        "lon",
        F.bround("area", 2).alias("area_m2"),
        F.bround("rim", 2).alias("perimeter_m"),
        F.bround("aspect", 2).alias("aspect_ratio"),
        *[F.bround(c, 6).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")],
        F.lit(epoch).cast("date").alias("epoch"),
        F.coalesce(props.getItem("confidence").try_cast("double"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        props.alias("properties"),
    )


def feature_record(task_id: str | None = None) -> Column:
    """GeoJSON feature of a record, a struct.

    Without a task id the centroid is split into two properties; with one it is a pair and
    the task id is a property, as in a task export.
    """
    head = [F.col("feature_id"), F.col("class").alias("tactical_class"), F.col("confidence"),
            F.col("area_sq_m").alias("area_sq_meters"), F.col("area_hectares")]
    if task_id is None:
        place = [F.col("centroid.lat").alias("centroid_lat"), F.col("centroid.lon").alias("centroid_lon")]
        tail = []
    else:
        place = [F.array("centroid.lat", "centroid.lon").alias("centroid_wgs84")]
        tail = [F.lit(task_id).alias("task_id")]
    props = F.struct(*head, *place, F.col("grid_ref").alias("centroid_mgrs"), *tail)
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometry").alias("coordinates"))
    ident = [F.col("feature_id").alias("id")] if task_id is None else []
    return F.struct(F.lit("Feature").alias("type"), *ident, geometry.alias("geometry"), props.alias("properties"))


def feature_json(features: DataFrame, task_id: str | None = None) -> DataFrame:
    """One GeoJSON feature text per record, ready to be written as feature lines."""
    return features.select("feature_id", F.to_json(feature_record(task_id)).alias("feature"))


def collection_header(task_id: str) -> str:
    """Members of a task export that precede its features (name and CRS84 block)."""
    return (
        f'"type":"FeatureCollection","name":"changes_{task_id}",'
        '"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}}'
    )


def write_feature_lines(features: DataFrame, path: str, task_id: str | None = None, mode: str = "overwrite") -> None:
    """Distributed export, one feature per line; any number of features."""
    feature_json(features, task_id).select("feature").write.mode(mode).text(path)


def write_collections(features: DataFrame, path: str, key: str, task_id: str | None = None) -> DataFrame:
    """One FeatureCollection per value of ``key``, each a folder ``key=value`` of part files that follow each other by name.

    The lines of all parts of a folder, read in the order of their names, are one JSON document: a header, the features by
    ``feature_id``, a footer. Rows are dealt by range, so a collection of any size is spread over tasks and no string or
    group holds one. Parts appear only when the job commits, and the manifest, ``path/_manifest``, is written after them: an export without
    a manifest is not complete, a failed or repeated task leaves no part of its own. An existing export is replaced.
    Rows that are equal throughout are written once; a key without features has no collection, a null or empty key is refused. Returns the manifest
    ``(key, part_no, file, n_features)``.
    """
    spark = features.sparkSession
    keyed = features.withColumn("_key", F.col(key))
    record = feature_record(task_id).alias("line")
    lines = save_table(keyed.select(F.col("_key").alias(key), "feature_id", F.to_json(record).alias("line")).distinct(), "collection-lines")
    if lines.filter(F.col(key).isNull() | (F.col(key).cast("string") == "")).limit(1).count():
        raise ValueError(f"{key}: null and empty keys have no folder name of their own")
    # A comma stands before every feature but the first of its collection.
    first = lines.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("feature_id", "line")).alias("first"))
    first = save_table(first, "collection-first")
    head = collection_header(task_id) if task_id else '"type":"FeatureCollection"'
    at_first = F.struct("feature_id", "line").eqNullSafe(F.col("first"))
    body = lines.join(first, F.col(key) == F.col("_key")).select(
        key, F.lit(1).alias("_at"), "feature_id", F.col("line").alias("_record"), F.when(at_first, F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))
    frame = [first.select(F.col("_key").alias(key), F.lit(at).alias("_at"), F.lit(None).cast(lines.schema["feature_id"].dataType).alias("feature_id"),
                          F.lit(text).alias("_record"), F.lit(text).alias("line")) for at, text in ((0, "{" + head + ',"features":['), (2, "]}"))]
    order = [F.col(c) for c in (key, "_at", "feature_id", "_record")]
    document = body.unionByName(frame[0]).unionByName(frame[1]).repartitionByRange(*order).sortWithinPartitions(*order)
    document.select(key, "line").write.mode("overwrite").partitionBy(key).text(path)

    folder = F.element_at(F.split("file", "/"), -2)
    parts = read_collections_lines(spark, path, lines.schema[key].dataType.simpleString(), key).groupBy(key, "file").agg(
        F.count_if(F.endswith("value", F.lit("}")) & (F.col("value") != "]}")).alias("n_features"))
    # Numbered within a collection; one row per file.
    number = F.row_number().over(Window.partitionBy(folder).orderBy("file"))
    manifest = parts.withColumn("part_no", number).select(key, "part_no", "file", "n_features")
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/_manifest")


def read_collections_lines(spark: SparkSession, path: str, key_type: str, key: str) -> DataFrame:
    """Lines of an export of ``write_collections``: ``(key, value, file)``."""
    lines = spark.read.text(path)
    if key in lines.columns:  # with the key's own type: an inferred one would read 007 as 7
        lines = spark.read.schema(f"value string, `{key}` {key_type}").text(path)
    else:  # an export without any collection has no folders
        lines = lines.withColumn(key, F.lit(None).cast(key_type))
    return lines.select(key, "value", F.col("_metadata.file_path").alias("file"))
