"""Scene graphs: proximity edges, neighbours, and the difference of two epochs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradrift.functions.classify import relation_type
from terradrift.functions.geo import METRES_PER_DEGREE
from terradrift.operators.spatial_join import GLOBE, Plane, distance_join, nearest_join, nearest_k
from terradrift.operators.tiling import shuffled
from terradrift.operators.triangulate import delaunay_pairs
from terradrift.session import save_table

MATCH_RADIUS_M = 35.0
AREA_CHANGE = 0.20
CLUSTER_DEG = 0.05
PADDING_M = 2500.0
PROXIMITY_M = 1200.0


# --- edges ------------------------------------------------------------------------------------


def _ends(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = nodes.select(
        F.col("node_id").alias("source_id"), F.col("class").alias("source_class"), "lat", "lon", "epoch"
    )
    right = nodes.select(
        F.col("node_id").alias("target_id"), F.col("class").alias("target_class"),
        F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
    )
    return left, right


def close_pairs(nodes: DataFrame, max_distance_m: float) -> DataFrame:
    """Unordered node pairs within reach, smaller id first."""
    left, right = _ends(nodes)
    return distance_join(left, right, max_distance_m).filter("source_id < target_id")


def _edge_id() -> Column:
    return F.concat_ws("_", F.lit("edge"), F.col("epoch").cast("string"), "source_id", "target_id").alias("edge_id")


def as_edges(pairs: DataFrame, connect_roads: bool = True) -> DataFrame:
    """Edge records of close pairs; the edge id names epoch and both ends."""
    rel = relation_type("distance_m", "source_class", "target_class", connect_roads=connect_roads)
    return pairs.select(
        _edge_id(), "source_id", "target_id", rel.alias("relation_type"), F.bround("distance_m", 2).alias("distance_m"), "epoch",
    )


def radius_network(nodes: DataFrame, max_distance_m: float = PROXIMITY_M, connect_roads: bool = True) -> DataFrame:
    """Edges between all nodes within reach of each other."""
    return as_edges(close_pairs(nodes, max_distance_m), connect_roads)


def _with_ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``(source_id, target_id)`` with class, place and epoch of their nodes."""
    left, right = _ends(nodes)
    return pairs.join(left, "source_id").join(right, "target_id")


def knn_network(nodes: DataFrame, k: int, max_distance_m: float = PROXIMITY_M, connect_roads: bool = True) -> DataFrame:
    """Edges from each node to its k nearest within reach, each unordered pair once."""
    near = nearest_k(nodes, "node_id", k, max_distance_m)
    pairs = near.select(F.least("node_id", "other").alias("source_id"), F.greatest("node_id", "other").alias("target_id"), "distance_m")
    return as_edges(_with_ends(pairs.dropDuplicates(["source_id", "target_id"]), nodes), connect_roads)


def _plane(nodes: DataFrame, lat0: float | None, lon0: float | None) -> tuple[float, float] | None:
    """The place where the plane touches: as given, else the middle of the nodes' box; None without nodes."""
    if lat0 is not None and lon0 is not None:
        return lat0, lon0
    box = nodes.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    return None if box[0] is None else ((box[0] + box[1]) / 2, (box[2] + box[3]) / 2)


def _triangulation_edges(
    nodes: DataFrame, touch: tuple[float, float], max_distance_m: float, connect_roads: bool, **how
) -> DataFrame:
    """Edge records of triangulation edges within reach; the few columns that tell them are written, ids follow from them."""

    def keep(pairs: DataFrame) -> DataFrame:
        far = pairs.withColumn("_metres", GLOBE.distance("a_lat", "a_lon", "b_lat", "b_lon"))
        return far.withColumns({
            "near": F.col("_metres") <= max_distance_m, "source_id": F.col("a_node_id"), "target_id": F.col("b_node_id"), "epoch": F.col("a_epoch"),
            "relation_type": relation_type("_metres", "a_class", "b_class", connect_roads=connect_roads), "distance_m": F.bround("_metres", 2),
        })

    kept = ["source_id", "target_id", "relation_type", "distance_m", "epoch"]
    found = delaunay_pairs(nodes, *touch, keep, kept, ["class", "epoch"], **how)
    return found.select(_edge_id(), *kept)


def gabriel_network(
    nodes: DataFrame, max_distance_m: float = PROXIMITY_M, lat0: float | None = None, lon0: float | None = None,
    connect_roads: bool = True,
) -> DataFrame:
    """Edges within reach whose diameter circle holds no other node; a part of the triangulation.

    The triangulation's edges within reach are the candidates; a node inside the circle about an edge's middle, by more than a micrometre, rules it out.
    """
    touch = _plane(nodes, lat0, lon0)
    if touch is None:
        return radius_network(nodes, max_distance_m, connect_roads)
    return _triangulation_edges(nodes, touch, max_distance_m, connect_roads, within_m=max_distance_m, free_only=True)


def triangulated_network(
    nodes: DataFrame, max_distance_m: float = PROXIMITY_M, lat0: float | None = None, lon0: float | None = None,
    connect_roads: bool = True,
) -> DataFrame:
    """Edges of the Delaunay triangulation within reach. The plane touches at the given place, else mid-box."""
    touch = _plane(nodes, lat0, lon0)
    if touch is None:
        return radius_network(nodes, max_distance_m, connect_roads)
    return _triangulation_edges(nodes, touch, max_distance_m, connect_roads)


def ordered_network(nodes: DataFrame, max_distance_m: float = PROXIMITY_M, follow: int = 5) -> DataFrame:
    """Fallback for collinear nodes: each joined to the next few in id order, per epoch.

    Order is established by a distributed sort; blocks of consecutive ranks keep windows small.
    """
    ranked = _global_rank(nodes.select("node_id", "class", "lat", "lon", "epoch"), "epoch", "node_id")
    left, right = _ends(ranked)
    left = left.join(ranked.select(F.col("node_id").alias("source_id"), "rank"), "source_id")
    right = right.join(ranked.select(F.col("node_id").alias("target_id"), F.col("epoch"), "rank"), "target_id")
    steps = left.withColumn("rank", F.explode(F.array(*[F.col("rank") + i for i in range(1, follow + 1)])))
    pairs = steps.join(right, ["epoch", "rank"])
    dist = GLOBE.distance("lat", "lon", "r_lat", "r_lon")
    return as_edges(pairs.withColumn("distance_m", dist).filter(F.col("distance_m") <= max_distance_m))


def _global_rank(df: DataFrame, group: str, order: str) -> DataFrame:
    """Dense position of each row in (group, order) without sorting a group in one task.

    Range-partitioned rows are numbered inside their partition and shifted by the sizes of
    the partitions before; only one count per partition is windowed.
    """
    rows = save_table(
        df.repartitionByRange(group, order)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(group, order))),
        "ranked",
    )
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_p", F.coalesce(start, F.lit(0)).alias("_s"))
    return rows.join(starts, "_p").withColumn("rank", F.col("_i") + F.col("_s")).drop("_p", "_i", "_s")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected adjacency with the neighbour's record: ``(node_id, neighbour_id, neighbour_class, ...)``."""
    ways = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour_id")).unionByName(
        edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour_id"))
    )
    info = nodes.select(F.col("node_id").alias("neighbour_id"), F.col("class").alias("neighbour_class"))
    return ways.distinct().join(info, "neighbour_id")


def traverse(edges: DataFrame, nodes: DataFrame, relation: str, how: str = "inner") -> DataFrame:
    """Follow edges of one relation from source to target; ``how='left'`` keeps sources without any.

    ``nodes`` is the set of source candidates on the left and looked-up targets on the right.
    """
    hops = edges.filter(F.col("relation_type") == relation).select(F.col("source_id").alias("node_id"), "target_id")
    info = nodes.select(
        F.col("node_id").alias("target_id"), F.col("class").alias("target_class"),
        F.col("lat").alias("target_lat"), F.col("lon").alias("target_lon"),
    )
    return nodes.join(hops.join(info, "target_id"), "node_id", how)


# --- differences ------------------------------------------------------------------------------


@dataclass
class GraphDelta:
    matches: DataFrame
    added: DataFrame
    removed: DataFrame
    modified: DataFrame
    added_edges: DataFrame
    removed_edges: DataFrame
    boxes: DataFrame
    summary: DataFrame


def match_nodes(n1: DataFrame, n2: DataFrame, lat0: float, lon0: float, radius_m: float = MATCH_RADIUS_M) -> DataFrame:
    """Nearest earlier node of each later node within the match radius: ``(new_id, old_id, shift_m)``.

    Several later nodes may share one earlier node.
    """
    later = n2.select(F.col("node_id").alias("new_id"), "lat", "lon")
    earlier = n1.select(F.col("node_id").alias("old_id"), "lat", "lon")
    found = nearest_join(later, earlier, radius_m, "new_id", "old_id", Plane(lat0, lon0))
    return found.withColumnRenamed("distance_m", "shift_m")


def added_nodes(n2: DataFrame, matches: DataFrame) -> DataFrame:
    return n2.join(shuffled(matches.select(F.col("new_id").alias("node_id"))), "node_id", "left_anti")


def removed_nodes(n1: DataFrame, matches: DataFrame) -> DataFrame:
    return n1.join(shuffled(matches.select(F.col("old_id").alias("node_id"))), "node_id", "left_anti")


def modified_nodes(n1: DataFrame, n2: DataFrame, matches: DataFrame, area_change: float = AREA_CHANGE) -> DataFrame:
    """Matched nodes whose area moved by at least the given share or whose class differs."""
    old = n1.select(F.col("node_id").alias("old_id"), F.col("class").alias("class_t1"), F.col("area_m2").alias("area_t1_m2"))
    new = n2.select(
        F.col("node_id").alias("new_id"), F.col("class").alias("class_t2"), F.col("area_m2").alias("area_t2_m2"),
        F.col("lat").alias("lat_t2"), F.col("lon").alias("lon_t2"), "min_lat", "min_lon", "max_lat", "max_lon",
    )
    gap = F.abs(F.col("area_t2_m2") - F.col("area_t1_m2"))
    share = gap / F.greatest("area_t1_m2", F.lit(1e-3))
    changed = (share >= area_change) | (F.col("class_t1") != F.col("class_t2"))
    return (
        shuffled(matches).join(new, "new_id").join(shuffled(old), "old_id").filter(changed)
        .withColumns(
            {
                "_gap": gap, "area_delta_m2": F.bround(gap, 2), "relative_change": F.bround(share, 3),
                "centroid_shift_m": F.bround("shift_m", 2),
            }
        )
        .drop("shift_m")
    )


def undirected_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair; of several the largest edge id stays."""
    pair = F.array_sort(F.array("source_id", "target_id"))
    last = F.max_by(F.struct(*edges.columns), F.col("edge_id"))
    return edges.groupBy(pair.alias("pair")).agg(last.alias("e")).select("pair", "e.*")


def edge_difference(e1: DataFrame, e2: DataFrame, matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges only in the later and only in the earlier epoch, compared by unordered end ids.

    With ``matches`` the later ids are first replaced by the ids they matched.
    """
    if matches is not None:
        for end in ("source_id", "target_id"):
            names = matches.select(F.col("new_id").alias(end), F.col("old_id").alias("_old"))
            e2 = e2.join(names, end, "left").withColumn(end, F.coalesce("_old", end)).drop("_old")
        e2 = e2.select(*e1.columns)
    cols = e1.columns
    pair = F.array_sort(F.array("source_id", "target_id")).alias("pair")
    rows = e1.select(pair, F.lit(1).alias("t"), F.struct(*cols).alias("e")).unionByName(
        e2.select(pair, F.lit(2).alias("t"), F.struct(*cols).alias("e"))
    )
    # One aggregate for both directions: the last edge of each epoch per pair.
    sides = [F.max_by(F.when(F.col("t") == t, F.col("e")), F.when(F.col("t") == t, F.col("e.edge_id"))).alias(f"e{t}") for t in (1, 2)]
    met = rows.groupBy("pair").agg(*sides)
    return met.filter("e1 IS NULL").select("e2.*"), met.filter("e2 IS NULL").select("e1.*")


def change_points(added: DataFrame, modified: DataFrame) -> DataFrame:
    """Places of added and modified nodes."""
    return added.select("lat", "lon").unionByName(
        modified.select(F.col("lat_t2").alias("lat"), F.col("lon_t2").alias("lon"))
    )


def candidate_boxes(points: DataFrame, ref_lat: float, padding_m: float = PADDING_M, cell_deg: float = CLUSTER_DEG) -> DataFrame:
    """Padded boxes around change points that share a degree cell (cells truncate towards zero).

    ``ref_lat`` sets the longitude padding.
    """
    pad_lat = padding_m / METRES_PER_DEGREE
    pad_lon = F.lit(padding_m) / (METRES_PER_DEGREE * F.cos(F.radians(F.lit(float(ref_lat)))))

    def cell(axis: str) -> Column:
        return (F.col(axis) / cell_deg).cast("int")

    return points.groupBy(cell("lat").alias("cell_lat"), cell("lon").alias("cell_lon")).agg(
        F.bround(F.greatest(F.min("lat") - pad_lat, F.lit(-90.0)), 6).alias("min_lat"),
        F.bround(F.greatest(F.min("lon") - pad_lon, F.lit(-180.0)), 6).alias("min_lon"),
        F.bround(F.least(F.max("lat") + pad_lat, F.lit(90.0)), 6).alias("max_lat"),
        F.bround(F.least(F.max("lon") + pad_lon, F.lit(180.0)), 6).alias("max_lon"),
        F.count("*").alias("n_points"),
    )


def tagged_delta(added: DataFrame, removed: DataFrame, modified: DataFrame) -> DataFrame:
    """One table of changed nodes with ``status`` EMERGED, REMOVED or MODIFIED and the area each alters."""
    cols = ["node_id", "class", "lat", "lon", "area_m2", "epoch"]
    no_gap = F.lit(None).cast("double").alias("area_delta_m2")

    def tag(df: DataFrame, status: str) -> DataFrame:
        return df.select(F.lit(status).alias("status"), *cols, no_gap, F.col("area_m2").alias("altered_m2"))

    changed = modified.select(
        F.lit("MODIFIED").alias("status"), F.col("old_id").alias("node_id"), F.col("class_t2").alias("class"),
        F.col("lat_t2").alias("lat"), F.col("lon_t2").alias("lon"), F.col("area_t2_m2").alias("area_m2"),
        F.lit(None).cast("date").alias("epoch"), "area_delta_m2", F.col("_gap").alias("altered_m2"),
    )
    return tag(added, "EMERGED").unionByName(tag(removed, "REMOVED")).unionByName(changed)


def delta_summary(
    n1: DataFrame, n2: DataFrame, tagged: DataFrame, added_edges: DataFrame, removed_edges: DataFrame, boxes: DataFrame
) -> DataFrame:
    """Counters and altered area as one row, from one pass over a union of tagged keys."""

    def mark(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("k"), F.lit(0.0).alias("m2"))

    changes = tagged.select(F.col("status").alias("k"), F.col("altered_m2").alias("m2"))
    rows = changes
    for df, kind in ((n1, "n1"), (n2, "n2"), (added_edges, "e+"), (removed_edges, "e-"), (boxes, "box")):
        rows = rows.unionByName(mark(df, kind))

    def n(kind: str, name: str) -> Column:
        return F.count_if(F.col("k") == kind).alias(name)

    return rows.agg(
        n("n1", "baseline_node_count"), n("n2", "target_node_count"), n("EMERGED", "added_node_count"),
        n("REMOVED", "removed_node_count"), n("MODIFIED", "modified_node_count"), n("e+", "added_edge_count"),
        n("e-", "removed_edge_count"), n("box", "candidate_bbox_count"),
        F.bround(F.sum("m2"), 2).alias("total_altered_area_m2"),
        F.bround(F.sum("m2") / 10000.0, 4).alias("total_altered_area_ha"),
    )


def compile_delta(
    n1: DataFrame, n2: DataFrame, e1: DataFrame, e2: DataFrame, lat0: float, lon0: float,
    radius_m: float = MATCH_RADIUS_M, area_change: float = AREA_CHANGE, padding_m: float = PADDING_M,
    match_edge_ids: bool = False,
) -> GraphDelta:
    """Difference of two scene graphs. The node match is the costly part and is written once."""
    matches = save_table(match_nodes(n1, n2, lat0, lon0, radius_m), "matches")
    added, removed = added_nodes(n2, matches), removed_nodes(n1, matches)
    modified = modified_nodes(n1, n2, matches, area_change)
    plus, minus = edge_difference(e1, e2, matches if match_edge_ids else None)
    tagged = save_table(tagged_delta(added, removed, modified), "delta")
    boxes = candidate_boxes(tagged.filter("status <> 'REMOVED'"), lat0, padding_m)
    summary = delta_summary(n1, n2, tagged, plus, minus, boxes)
    return GraphDelta(matches, added, removed, modified, plus, minus, boxes, summary)
