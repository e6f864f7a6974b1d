"""Structural and change queries over node, edge and zone tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.operators.graph import traverse
from terradrift.operators.spatial_join import count_within, distance_join, has_within, nearest_join, zone_join
from terradrift.session import save_table

BOX = ["min_lat", "min_lon", "max_lat", "max_lon"]


def existed_by_match(matches: DataFrame, epoch: str) -> DataFrame:
    """``(node_id, epoch)`` of later nodes that had a counterpart in ``epoch``."""
    return matches.select(F.col("new_id").alias("node_id"), F.lit(epoch).cast("date").alias("epoch"))


def existed_by_id(baseline: DataFrame) -> DataFrame:
    return baseline.select("node_id", "epoch")


def emerged(nodes: DataFrame, existed: DataFrame, target_epoch: str, baseline_epoch: str) -> DataFrame:
    """Nodes of the target epoch that did not exist in the baseline epoch."""
    before = existed.filter(F.col("epoch") == F.lit(baseline_epoch).cast("date")).select("node_id")
    return nodes.filter(F.col("epoch") == F.lit(target_epoch).cast("date")).join(before, "node_id", "left_anti")


def is_delta() -> Column:
    """Id marked as a delta or a delta status among the properties."""
    status = F.col("properties").getItem("delta_status")
    return F.col("node_id").startswith("delta_") | F.coalesce(status != "", F.lit(False))


def structural_query(
    nodes: DataFrame, target_class: str, near_class: str | None = None, max_distance_m: float = 800.0,
    min_area_m2: float = 10000.0, delta_only: bool = False, baseline: DataFrame | None = None, metric=None,
) -> DataFrame:
    """Nodes of a class and size, optionally new, optionally near a node of another class.

    Filters run before the spatial step, which only decides existence and lists no pairs.
    """
    hits = nodes.filter((F.col("class") == target_class) & (F.col("area_m2") >= min_area_m2))
    if delta_only:
        hits = hits.filter(is_delta())
    if baseline is not None:
        hits = hits.join(baseline.select("node_id"), "node_id", "left_anti")
    if near_class is not None:
        near = nodes.filter(F.col("class") == near_class).select(F.col("node_id").alias("near_id"), "lat", "lon")
        extra = {} if metric is None else {"metric": metric}
        hits = has_within(hits, near, max_distance_m, "node_id", "near_id", **extra)
    return hits.select("node_id", "class", "area_m2", "lat", "lon", *BOX)


def match_count(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("matched_count"))


def _roads(nodes: DataFrame, target_epoch: str, road_class: str) -> DataFrame:
    here = nodes.filter((F.col("class") == road_class) & (F.col("epoch") == F.lit(target_epoch).cast("date")))
    return here.select(F.col("node_id").alias("road_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))


def large_sites_near_roads(
    nodes: DataFrame, existed: DataFrame, target_epoch: str, baseline_epoch: str, site_class: str = "Airstrip",
    road_class: str = "Road", min_area_m2: float = 15000.0, within_m: float = 800.0, nearest_only: bool = False,
) -> DataFrame:
    """New large sites with every road in reach (or only the nearest), largest first."""
    sites = emerged(nodes, existed, target_epoch, baseline_epoch)
    sites = sites.filter((F.col("class") == site_class) & (F.col("area_m2") >= min_area_m2))
    sites = sites.select(F.col("node_id").alias("site_id"), "area_m2", "lat", "lon", *BOX)
    roads = _roads(nodes, target_epoch, road_class)
    if nearest_only:
        plain = roads.select("road_id", F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"))
        pairs = sites.join(nearest_join(sites, plain, within_m, "site_id", "road_id"), "site_id")
    else:
        pairs = distance_join(sites, roads, within_m).drop("r_lat", "r_lon")
    return pairs.withColumnRenamed("distance_m", "road_distance_m").orderBy(F.desc("area_m2"), "site_id", "road_id")


def structure_clusters(
    nodes: DataFrame, existed: DataFrame, target_epoch: str, baseline_epoch: str, core_class: str = "Structure",
    road_class: str = "Road", road_m: float = 500.0, neighbour_m: float = 300.0, min_density: int = 3,
    nearest_road_only: bool = False,
) -> DataFrame:
    """New structures near roads with enough structures around them, densest first.

    Rows are one per core and distinct road distance; roads at exactly the same distance
    share a row and multiply its density. Neighbours are counted, not listed.
    """
    cores = emerged(nodes, existed, target_epoch, baseline_epoch).filter(F.col("class") == core_class)
    cores = cores.select(F.col("node_id").alias("core_id"), "lat", "lon", *BOX)
    peers = nodes.filter((F.col("class") == core_class) & (F.col("epoch") == F.lit(target_epoch).cast("date")))
    density = count_within(cores, peers, neighbour_m, "core_id", "node_id").withColumnRenamed("n", "n_peers")
    roads = _roads(nodes, target_epoch, road_class)
    if nearest_road_only:
        plain = roads.select("road_id", F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"))
        reach = nearest_join(cores, plain, road_m, "core_id", "road_id")
    else:
        reach = distance_join(cores.select("core_id", "lat", "lon"), roads, road_m)
    per_distance = reach.groupBy("core_id", "distance_m").agg(F.count("*").alias("n_roads"))
    rows = per_distance.join(density, "core_id").withColumn("cluster_density", F.col("n_peers") * F.col("n_roads"))
    return (
        rows.filter(F.col("cluster_density") >= min_density)
        .join(cores, "core_id")
        .select("core_id", "lat", "lon", *BOX, "cluster_density", F.col("distance_m").alias("road_distance_m"))
        .orderBy(F.desc("cluster_density"), "core_id", "road_distance_m")
    )


def earthworks_with_targets(
    nodes: DataFrame, edges: DataFrame, existed: DataFrame, target_epoch: str, baseline_epoch: str,
    work_class: str = "Revetment", relation: str = "DEFENDS",
) -> DataFrame:
    """New earthworks and, where linked, what they protect."""
    works = emerged(nodes, existed, target_epoch, baseline_epoch).filter(F.col("class") == work_class)
    hops = edges.filter(F.col("relation_type") == relation).select(F.col("source_id").alias("node_id"), "target_id")
    info = nodes.select(F.col("node_id").alias("target_id"), F.col("class").alias("target_class"))
    linked = hops.join(info, "target_id")
    return works.join(linked, "node_id", "left").select(
        "node_id", "area_m2", "aspect_ratio", "lat", "lon", *BOX, "target_id", "target_class"
    )


def new_roads_to_class(
    nodes: DataFrame, edges: DataFrame, existed: DataFrame, target_epoch: str, baseline_epoch: str,
    post_class: str, road_class: str = "Road",
) -> DataFrame:
    """New road segments joined by a road edge to a node of a class."""
    hops = traverse(edges, nodes, "CONNECTED_BY_ROAD").filter(F.col("target_class") == post_class)
    fresh = emerged(hops, existed, target_epoch, baseline_epoch).filter(F.col("class") == road_class)
    return fresh.select(
        F.col("node_id").alias("road_id"), "area_m2", F.col("target_id").alias("post_id"),
        F.col("target_lat").alias("post_lat"), F.col("target_lon").alias("post_lon"), *BOX,
    )


def largest_new_boxes(
    nodes: DataFrame, existed: DataFrame, target_epoch: str, baseline_epoch: str,
    classes: Sequence[str] = ("Airstrip", "Revetment", "Structure", "GradedArea", "MilitaryPost"), top: int = 50,
) -> DataFrame:
    """Boxes of the largest new nodes of some classes (a top-k report; equal areas by id)."""
    fresh = emerged(nodes, existed, target_epoch, baseline_epoch).filter(F.col("class").isin(*classes))
    return fresh.select("node_id", *BOX, "class", "area_m2").orderBy(F.desc("area_m2"), "node_id").limit(top)


def new_in_zone(
    nodes: DataFrame, zones: DataFrame, existed: DataFrame, target_epoch: str, baseline_epoch: str,
    zone_name: str | None = None,
) -> DataFrame:
    """New nodes inside one zone, or inside each zone when none is named; largest first."""
    if zone_name is not None:
        zones = zones.filter(F.col("zone_name") == zone_name)
    # The join reads its nodes once per level of radius; they are few against the nodes that emerged is found among.
    fresh = emerged(nodes, existed, target_epoch, baseline_epoch).select("node_id", "class", "area_m2", "lat", "lon", *BOX)
    inside = zone_join(save_table(fresh, "fresh"), zones)
    return inside.select("zone_name", "node_id", "class", "area_m2", "distance_m", *BOX).orderBy(
        F.desc("area_m2"), "zone_name", "node_id"
    )


def change_by_class(nodes: DataFrame, existed: DataFrame, target_epoch: str, baseline_epoch: str) -> DataFrame:
    """Count, area and mean confidence of new nodes per class, largest area first."""
    total = F.sum("area_m2")
    return (
        emerged(nodes, existed, target_epoch, baseline_epoch)
        .groupBy("class")
        .agg(
            F.count("*").alias("entity_count"), F.round(total, 2).alias("total_area_m2"),
            F.round(total / 10000.0, 4).alias("total_area_ha"), F.round(F.avg("confidence"), 3).alias("mean_confidence"),
        )
        .orderBy(F.desc("total_area_m2"), "class")
    )
