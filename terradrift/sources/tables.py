"""Persisting detections, audit rows and scene graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def persist_run(features: DataFrame, audit: DataFrame, root: str) -> None:
    """Append detections (by epoch) and the audit row of a run."""
    append_table(features, f"{root}/detected_changes", "epoch")
    append_table(audit, f"{root}/audit_logs")


def audit_row(features: DataFrame, runs: DataFrame) -> DataFrame:
    """Audit record per task: run facts plus feature count and altered area."""
    totals = features.groupBy("task_id").agg(
        F.count("*").alias("polygons_detected"), F.round(F.sum("area_sq_m"), 2).alias("total_area_sq_m")
    )
    return runs.join(totals, "task_id", "left").fillna({"polygons_detected": 0, "total_area_sq_m": 0.0})


def insert_absent(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key is not stored yet; of equal new keys one row is kept. Returns rows added."""
    fresh = df.dropDuplicates([key])
    stored = _stored(df.sparkSession, path)
    if stored is not None:
        fresh = fresh.join(stored.select(key), key, "left_anti")
    before = 0 if stored is None else stored.count()
    fresh.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path).count() - before


def graph_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Insert-if-absent statement text per node and edge, nodes first (``part`` 0, then 1)."""
    node = F.format_string(
        "MERGE (n:SpatialEntity:%s {id: '%s'}) ON CREATE SET n.class = '%s', n.epoch = '%s', n.area_m2 = %s, "
        "n.perimeter_m = %s, n.aspect_ratio = %s, n.confidence = %s, "
        "n.location = point({latitude: %s, longitude: %s}), n.bbox = [%s, %s, %s, %s];",
        "class", "node_id", "class", *_text("epoch", "area_m2", "perimeter_m", "aspect_ratio", "confidence", "lat", "lon",
                                            "min_lat", "min_lon", "max_lat", "max_lon"),
    )
    edge = F.format_string(
        "MATCH (a:SpatialEntity {id: '%s'}), (b:SpatialEntity {id: '%s'}) MERGE (a)-[r:%s {id: '%s'}]->(b) "
        "ON CREATE SET r.distance_m = %s, r.epoch = '%s';",
        "source_id", "target_id", "relation_type", "edge_id", *_text("distance_m", "epoch"),
    )
    return nodes.select(F.lit(0).alias("part"), node.alias("statement")).unionByName(
        edges.select(F.lit(1).alias("part"), edge.alias("statement"))
    )


def _text(*names: str):
    return [F.col(n).cast("string") for n in names]


def delta_statements(delta_rows: DataFrame) -> DataFrame:
    """Statement text of emerged and modified nodes of a tagged delta."""
    emerged = F.format_string(
        "MERGE (n:SpatialEntity:%s:NewTacticalDelta {id: '%s'}) ON CREATE SET n.class = '%s', n.epoch = '%s', "
        "n.area_m2 = %s, n.location = point({latitude: %s, longitude: %s}), n.delta_status = 'EMERGED';",
        "class", "node_id", "class", *_text("epoch", "area_m2", "lat", "lon"),
    )
    modified = F.format_string(
        "MATCH (n:SpatialEntity {id: '%s'}) SET n:ModifiedDelta, n.area_delta_m2 = %s, n.area_t2_m2 = %s, "
        "n.delta_status = 'MODIFIED';",
        "node_id", *_text("area_delta_m2", "area_m2"),
    )
    text = F.when(F.col("status") == "EMERGED", emerged).when(F.col("status") == "MODIFIED", modified)
    return delta_rows.select("status", text.alias("statement")).filter(F.col("statement").isNotNull())


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per epoch entry: a header with counts, then nodes, then edges."""
    counts = nodes.groupBy("epoch").agg(F.count("*").alias("node_count")).join(
        edges.groupBy("epoch").agg(F.count("*").alias("edge_count")), "epoch", "left"
    ).fillna(0)

    def lines(df: DataFrame, kind: str, order: int) -> DataFrame:
        return df.select("epoch", F.lit(order).alias("part"), F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("json"))

    return lines(counts, "header", 0).unionByName(lines(nodes, "node", 1)).unionByName(lines(edges, "edge", 2))
