"""Node, edge, zone and delta queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, with_ctes
from checks.views import (
    LAT0, LON0, NODE_SQL, T1_EPOCH, T2_EPOCH, ZONE_SQL, hav_sql, near_sql, nodes_t1, nodes_t2, plane_sql, zones,
)
from terradrift.functions import classify, geo, gridref
from terradrift.operators import footprint, graph
from terradrift.operators.spatial_join import Plane, bbox_query, distance_join, has_within, nearest_join, radius_query, zone_join
from terradrift.plans import structural
from terradrift.session import save_table
from terradrift.sources import geojson, tables

PLANE = Plane(LAT0, LON0)
EDGE_M = 250.0
BOX = "min_lat, min_lon, max_lat, max_lon"


def r6(*cols):
    return {c: F.round(c, 6) for c in cols}


def _round_box(df):
    return df.withColumns({c: F.round(c, 6) for c in ("lat", "lon", "min_lat", "min_lon", "max_lat", "max_lon") if c in df.columns})


BOX_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in ("min_lat", "min_lon", "max_lat", "max_lon"))
POS_SQL = "round(lat, 6) AS lat, round(lon, 6) AS lon"

# --- shared SQL -------------------------------------------------------------------------------

_D = plane_sql("n", "o")
MATCH = (
    f"cand AS (SELECT n.node_id AS new_id, o.node_id AS old_id, {_D} AS d FROM node2 n JOIN node1 o ON {near_sql('n', 'o', 35.0)} "
    f"WHERE {_D} <= 35), "
    "matches AS (SELECT new_id, old_id, d AS shift_m FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY d, old_id) AS k "
    "FROM cand) WHERE k = 1)"
)
ADDED = "added AS (SELECT * FROM node2 WHERE node_id NOT IN (SELECT new_id FROM matches))"
REMOVED = "removed AS (SELECT * FROM node1 WHERE node_id NOT IN (SELECT old_id FROM matches))"
_GAP = "abs(n.area_m2 - o.area_m2)"
MODIFIED = (
    "modified AS (SELECT new_id, old_id, shift_m, o.class AS class_t1, n.class AS class_t2, o.area_m2 AS area_t1_m2, "
    f"n.area_m2 AS area_t2_m2, {_GAP} AS gap, {_GAP} / greatest(o.area_m2, 1e-3) AS share, n.lat, n.lon, "
    "n.min_lat, n.min_lon, n.max_lat, n.max_lon FROM matches m JOIN node2 n ON n.node_id = new_id "
    f"JOIN node1 o ON o.node_id = old_id WHERE {_GAP} / greatest(o.area_m2, 1e-3) >= 0.20 OR o.class <> n.class)"
)
DELTA = (NODE_SQL, MATCH, ADDED, REMOVED, MODIFIED)


def _relation(a, b, d):
    return (
        f"CASE WHEN {a}.class IN ('Road', 'Airstrip') OR {b}.class IN ('Road', 'Airstrip') THEN 'CONNECTED_BY_ROAD' "
        f"WHEN {d} <= 150 THEN 'ADJACENT_TO' WHEN {a}.class = 'Revetment' OR {b}.class = 'Revetment' THEN 'DEFENDS' ELSE 'NEAR' END"
    )


def edge_sql(i: int, metres: float = EDGE_M) -> str:
    d = hav_sql("a", "b")
    return (
        f"edge{i} AS MATERIALIZED (SELECT 'edge_' || a.epoch || '_' || a.node_id || '_' || b.node_id AS edge_id, a.node_id AS source_id, "
        f"b.node_id AS target_id, {_relation('a', 'b', d)} AS relation_type, round_even({d}, 2) AS distance_m, a.epoch AS epoch, "
        f"{d} AS d FROM node{i} a JOIN node{i} b ON {near_sql('a', 'b', metres)} AND a.node_id < b.node_id WHERE {d} <= {metres})"
    )


EXISTED = "existed AS (SELECT new_id AS node_id FROM matches)"
NEW = "fresh AS (SELECT * FROM node2 WHERE node_id NOT IN (SELECT node_id FROM existed))"
TO_NEW = (NODE_SQL, MATCH, EXISTED, NEW)


def _matches(spark, d):
    return graph.match_nodes(nodes_t1(spark, d), nodes_t2(spark, d), LAT0, LON0)


def _existed(spark, d):
    return structural.existed_by_match(save_table(_matches(spark, d), "matches"), T1_EPOCH)


def _edges(spark, d, i):
    return graph.radius_network(nodes_t1(spark, d) if i == 1 else nodes_t2(spark, d), EDGE_M)


def _delta(spark, d):
    m = save_table(_matches(spark, d), "matches")
    n1, n2 = nodes_t1(spark, d), nodes_t2(spark, d)
    return n1, n2, m, graph.added_nodes(n2, m), graph.removed_nodes(n1, m), graph.modified_nodes(n1, n2, m)


# --- node expressions -------------------------------------------------------------------------


@check("p1_haversine", with_ctes(NODE_SQL, select=(
    f"SELECT a.node_id, round({hav_sql('a', 'b')}, 3) AS metres FROM node1 a JOIN node1 b "
    "ON b.node_id = 'n' || (CAST(substr(a.node_id, 2) AS BIGINT) + 1)")))
def _(spark, d):
    a = nodes_t1(spark, d).select("node_id", "lat", "lon")
    nxt = F.concat(F.lit("n"), (F.substring("node_id", 2, 20).cast("long") - 1).cast("string"))
    b = a.select(nxt.alias("node_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "node_id").select("node_id", F.round(geo.haversine_m("lat", "lon", "lat2", "lon2"), 3).alias("metres"))


@check("p2_tangent_plane", with_ctes(NODE_SQL, select=(
    f"SELECT node_id, round(radians(lon - {LON0}) * 6371000.0::DOUBLE * cos(radians({LAT0}::DOUBLE)), 3) AS x, "
    f"round(radians(lat - {LAT0}) * 6371000.0::DOUBLE, 3) AS y FROM node1")))
def _(spark, d):
    return nodes_t1(spark, d).select(
        "node_id", F.round(geo.tangent_x("lon", LAT0, LON0), 3).alias("x"), F.round(geo.tangent_y("lat", LAT0), 3).alias("y")
    )


@check("p7_hectares", with_ctes(NODE_SQL, select=(
    "SELECT node_id, greatest(0.005::DOUBLE, round_even(area_m2 * 1.000037::DOUBLE / 10000.0::DOUBLE, 4)) AS ha FROM node2")))
def _(spark, d):
    return nodes_t2(spark, d).select("node_id", geo.hectares(F.col("area_m2") * 1.000037, geo.MIN_HECTARES).alias("ha"))


def _zone_q(lat):
    s = f"sin(radians({lat}))"
    return f"({s} / (1 - {geo.WGS84_E2!r} * {s} * {s}) + atanh({geo.WGS84_E!r} * {s}) / {geo.WGS84_E!r})"


@check("p8_geodesic_area", with_ctes(NODE_SQL, select=(
    f"SELECT node_id, round(abs(radians(max_lon - min_lon) * ({_zone_q('max_lat')} - {_zone_q('min_lat')})) "
    f"* {geo.WGS84_B**2 / 2!r}, 2) AS area FROM node1")))
def _(spark, d):
    corners = [("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat")]
    ring = F.array(*[F.array(x, y) for x, y in corners])
    return nodes_t1(spark, d).withColumn("ring", ring).select("node_id", F.round(geo.ring_area_m2("ring"), 2).alias("area"))


_SHAPE = "CAST(substr(node_id, 2) AS BIGINT) % 3"


def _box_ring(a, b, lo, hi):
    """Corners at fractions of the node's box, as columns; a ring of four sides."""
    x = {f: F.col("min_lon") + (F.col("max_lon") - F.col("min_lon")) * f for f in (a, b)}
    y = {f: F.col("min_lat") + (F.col("max_lat") - F.col("min_lat")) * f for f in (lo, hi)}
    return F.array(*[F.array(x[i], y[j]) for i, j in ((a, lo), (b, lo), (b, hi), (a, hi), (a, lo))])


def _part_q(a, b):
    at = "(min_lat + (max_lat - min_lat) * {}::DOUBLE)"
    return f"({_zone_q(at.format(b))} - {_zone_q(at.format(a))})"


@check("p8_footprint", with_ctes(NODE_SQL, select=(
    f"SELECT node_id, round(radians(max_lon - min_lon) * {geo.WGS84_B**2 / 2!r} * CASE {_SHAPE} WHEN 0 THEN {_part_q(0, 1)} / 2 "
    f"WHEN 1 THEN {_part_q(0, 1)} - {_part_q(0.25, 0.75)} / 2 ELSE {_part_q(0, 1)} - {_part_q(0.25, 0.75)} / 2 + {_part_q(0.375, 0.625)} / 4 END, 2) AS area_sq_m, "
    f"round(CASE {_SHAPE} WHEN 1 THEN min_lon + (max_lon - min_lon) * 7 / 12.0::DOUBLE ELSE (min_lon + max_lon) / 2 END, 6) AS lon, "
    "round((min_lat + max_lat) / 2, 6) AS lat FROM node1")))
def _(spark, d):
    """Bow-ties, rectangles with a hole at their edge, and islands in holes, one shape per node."""
    nodes = nodes_t1(spark, d)
    bow = F.array(*[F.array(x, y) for x, y in (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "max_lat"))])
    full, edge = _box_ring(0.0, 1.0, 0.0, 1.0), _box_ring(0.0, 0.5, 0.25, 0.75)
    ring, isle = _box_ring(0.25, 0.75, 0.25, 0.75), _box_ring(0.375, 0.625, 0.375, 0.625)
    shape = F.expr(_SHAPE)
    geometry = F.when(shape == 0, F.array(F.array(bow))).when(shape == 1, F.array(F.array(full, edge))).otherwise(F.array(F.array(full, ring), F.array(isle)))
    found = footprint.footprints(nodes.select("node_id", geometry.alias("geometry")), "node_id")
    return found.select("node_id", F.round("area_sq_m", 2).alias("area_sq_m"), "lon", "lat")


_GRID_POINTS = [
    "node_id", "-83.0 + (area_m2 * 7.31) % 168.0 AS lat", "-180.0 + area_m2 * 0.0119 AS lon",
]
_A = gridref._ALPHA
_MGRS_CTE = (
    "pt AS (SELECT node_id, -83.0::DOUBLE + (area_m2 * 7.31::DOUBLE) % 168.0::DOUBLE AS lat, "
    "-180.0::DOUBLE + area_m2 * 0.0119::DOUBLE AS lon FROM node1)",
    "z AS (SELECT *, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat <= 84 AND lon >= 0 "
    "AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END "
    "ELSE CAST(floor((lon + 180) / 6) AS INT) % 60 + 1 END AS zn FROM pt)",
    f"t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {geo.WGS84_E!r} * atanh({geo.WGS84_E!r} * sin(radians(lat)))) AS t, "
    "radians(lon - (zn * 6 - 183)) AS dl FROM z)",
    "xe AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)",
    "en AS (SELECT *, "
    f"500000.0::DOUBLE + {gridref.SCALE_FACTOR * gridref._RECTIFYING_RADIUS!r} * (eta + "
    + " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_A, 1))
    + f") AS e, {gridref.SCALE_FACTOR * gridref._RECTIFYING_RADIUS!r} * (xi + "
    + " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_A, 1))
    + ") + CASE WHEN lat < 0 THEN 10000000.0::DOUBLE ELSE 0 END AS n FROM xe)",
)


@check("p9_grid_reference", with_ctes(*_MGRS_CTE, select=(
    "SELECT node_id, CASE WHEN lat NOT BETWEEN -80 AND 84 THEN 'GRID-' || round_even(lat, 4) || 'N-' || round_even(lon, 4) || 'E' ELSE "
    "lpad(zn::VARCHAR, 2, '0') || substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat + 80) / 8) AS INT) + 1, 1) || ' ' || "
    "substr('ABCDEFGHJKLMNPQRSTUVWXYZ', CAST(((zn - 1) % 3) * 8 + floor(e / 100000) AS INT), 1) || "
    "substr('ABCDEFGHJKLMNPQRSTUV', CAST((floor(n / 100000) + CASE WHEN zn % 2 = 0 THEN 5 ELSE 0 END) % 20 AS INT) + 1, 1) || ' ' || "
    "lpad(CAST(floor(e % 100000) AS INT)::VARCHAR, 5, '0') || ' ' || lpad(CAST(floor(n % 100000) AS INT)::VARCHAR, 5, '0') END AS grid_ref "
    "FROM en")).replace("WITH pt", f"WITH {NODE_SQL}, pt"))
def _(spark, d):
    import re

    pts = nodes_t1(spark, d).selectExpr(*[re.sub(r"(\d+\.\d+)", r"\1D", c) for c in _GRID_POINTS])
    return gridref.with_grid_ref(pts, "lat", "lon").select("node_id", "grid_ref")


_ROUND = "(4 * pi() * area_m2 / greatest(perimeter_m * perimeter_m, 1e-4))"


@check("p10_grid_ref_format", (
    "SELECT o_orderkey, CASE length(t) WHEN 15 THEN substr(t, 1, 3) || ' ' || substr(t, 4, 2) || ' ' || substr(t, 6, 5) || ' ' || substr(t, 11, 5) "
    "WHEN 14 THEN substr(t, 1, 2) || ' ' || substr(t, 3, 2) || ' ' || substr(t, 5, 5) || ' ' || substr(t, 10, 5) ELSE t END AS ref FROM "
    "(SELECT o_orderkey, (o_orderkey % 60) || 'RBK' || lpad((o_orderkey * 7919 % 10000000000)::VARCHAR, CAST(9 + o_custkey % 3 AS INT), '0') AS t FROM orders)"))
def _(spark, d):
    from checks.views import table

    digits = F.lpad((F.col("o_orderkey") * 7919 % 10000000000).cast("string"), F.lit(9) + (F.col("o_custkey") % 3).cast("int"), F.lit("0"))
    t = F.concat((F.col("o_orderkey") % 60).cast("string"), F.lit("RBK"), digits)
    return table(spark, d, "orders").select("o_orderkey", gridref.format_grid_ref(t).alias("ref"))


@check("p11_geometry_class", with_ctes(NODE_SQL, select=(
    "SELECT node_id, CASE WHEN class IN ('WaterBody', 'MilitaryPost') THEN class "
    "WHEN aspect_ratio >= 8 AND area_m2 >= 5000 THEN 'Airstrip' WHEN aspect_ratio >= 4.5 THEN 'Road' "
    f"WHEN area_m2 < 150 AND {_ROUND} >= 0.70 THEN 'Tower' WHEN area_m2 >= 15000 AND aspect_ratio < 2.5 THEN 'GradedArea' "
    f"WHEN area_m2 BETWEEN 300 AND 4000 AND {_ROUND} < 0.40 THEN 'Revetment' WHEN area_m2 >= 50 THEN 'Structure' "
    "ELSE 'Unknown' END AS class FROM node2")))
def _(spark, d):
    hint = F.when(F.col("class").isin("WaterBody", "MilitaryPost"), F.concat(F.lit("  seen: "), F.upper("class")))
    return nodes_t2(spark, d).select(
        "node_id", classify.classify_geometry("area_m2", "aspect_ratio", "perimeter_m", hint).alias("class")
    )


@check("f2_node_min_area", with_ctes(NODE_SQL, select="SELECT node_id, area_m2 FROM node1 WHERE area_m2 >= 15000"))
def _(spark, d):
    return nodes_t1(spark, d).filter("area_m2 >= 15000").select("node_id", "area_m2")


@check("f4_bbox_query", with_ctes(NODE_SQL, select=(
    "SELECT node_id FROM node1 WHERE lat BETWEEN 24.05 AND 24.11 AND lon BETWEEN 75.03 AND 75.21")))
def _(spark, d):
    return bbox_query(nodes_t1(spark, d), 24.05, 75.03, 24.11, 75.21).select("node_id")


@check("f5_class_query", with_ctes(NODE_SQL, select="SELECT node_id FROM node2 WHERE class = 'Road'"))
def _(spark, d):
    return nodes_t2(spark, d).filter("class = 'Road'").select("node_id")


@check("f11_delta_only", with_ctes(NODE_SQL, select=(
    "SELECT node_id FROM node2 WHERE node_id LIKE 'delta\\_%' ESCAPE '\\' OR delta_status <> ''")))
def _(spark, d):
    return nodes_t2(spark, d).filter(structural.is_delta()).select("node_id")


# --- joins ------------------------------------------------------------------------------------


@check("j2_nearest", with_ctes(NODE_SQL, MATCH, select="SELECT new_id, old_id, round(shift_m, 4) AS shift_m FROM matches"))
def _(spark, d):
    return _matches(spark, d).withColumn("shift_m", F.round("shift_m", 4))


@check("j2_nearest_road", with_ctes(NODE_SQL, select=(
    f"SELECT node_id, road_id, round(d, 3) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY d, road_id) AS k "
    f"FROM (SELECT n.node_id, o.node_id AS road_id, {hav_sql('n', 'o')} AS d FROM node2 n JOIN node2 o ON o.class = 'Road' "
    f"AND {near_sql('n', 'o', 600.0)}) WHERE d <= 600) WHERE k = 1")))
def _(spark, d):
    n = nodes_t2(spark, d)
    roads = n.filter("class = 'Road'").select(F.col("node_id").alias("road_id"), "lat", "lon")
    return nearest_join(n, roads, 600.0, "node_id", "road_id").withColumn("distance_m", F.round("distance_m", 3))


_CENTRE = "(SELECT 24.07::DOUBLE AS lat, 75.11::DOUBLE AS lon)"


@check("j3_radius_query", with_ctes(NODE_SQL, select=(
    f"SELECT o.node_id, round({plane_sql('n', 'o')}, 3) AS distance_m FROM node1 o, {_CENTRE} n WHERE {plane_sql('n', 'o')} <= 5000")))
def _(spark, d):
    hits = radius_query(nodes_t1(spark, d), 24.07, 75.11, 5000.0, PLANE)
    return hits.select("node_id", F.round("distance_m", 3).alias("distance_m"))


@check("j4_distance_join", with_ctes(NODE_SQL, select=(
    f"SELECT n.node_id AS site_id, o.node_id AS near_id, round({hav_sql('n', 'o')}, 3) AS distance_m FROM node1 n JOIN node1 o "
    f"ON n.node_id <> o.node_id AND {near_sql('n', 'o', 300.0)} WHERE {hav_sql('n', 'o')} <= 300")))
def _(spark, d):
    n = nodes_t1(spark, d)
    left = n.select(F.col("node_id").alias("site_id"), "lat", "lon")
    right = n.select(F.col("node_id").alias("near_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    pairs = distance_join(left, right, 300.0).filter("site_id <> near_id")
    return pairs.select("site_id", "near_id", F.round("distance_m", 3).alias("distance_m"))


@check("j5_spatial_semi_join", with_ctes(NODE_SQL, select=(
    f"SELECT DISTINCT n.node_id FROM node1 n JOIN node1 o ON n.class = 'Airstrip' AND o.class = 'Road' AND n.node_id <> o.node_id "
    f"AND {near_sql('n', 'o', 200.0)} WHERE {plane_sql('n', 'o')} <= 200")))
def _(spark, d):
    n = nodes_t1(spark, d)
    roads = n.filter("class = 'Road'").select(F.col("node_id").alias("near_id"), "lat", "lon")
    return has_within(n.filter("class = 'Airstrip'"), roads, 200.0, "node_id", "near_id", PLANE).select("node_id")


@check("j6_baseline_anti_join", with_ctes(NODE_SQL, select=(
    "SELECT node_id, class FROM node2 WHERE node_id NOT IN (SELECT node_id FROM node1)")))
def _(spark, d):
    return nodes_t2(spark, d).join(nodes_t1(spark, d).select("node_id"), "node_id", "left_anti").select("node_id", "class")


@check("j7_existed_in", with_ctes(*TO_NEW, select="SELECT node_id, class FROM fresh"))
def _(spark, d):
    return structural.emerged(nodes_t2(spark, d), _existed(spark, d), T2_EPOCH, T1_EPOCH).select("node_id", "class")


@check("j9_edge_traversal", with_ctes(NODE_SQL, edge_sql(2), select=(
    "SELECT source_id AS node_id, target_id, b.class AS target_class FROM edge2 e JOIN node2 a ON a.node_id = source_id "
    "JOIN node2 b ON b.node_id = target_id WHERE relation_type = 'CONNECTED_BY_ROAD'")))
def _(spark, d):
    hops = graph.traverse(_edges(spark, d, 2), nodes_t2(spark, d), "CONNECTED_BY_ROAD")
    return hops.select("node_id", "target_id", "target_class")


@check("j10_neighbours", with_ctes(NODE_SQL, edge_sql(1), select=(
    "SELECT e.node_id, neighbour_id, n.class AS neighbour_class FROM (SELECT source_id AS node_id, target_id AS neighbour_id FROM edge1 "
    "UNION SELECT target_id, source_id FROM edge1) e JOIN node1 n ON n.node_id = neighbour_id")))
def _(spark, d):
    return graph.neighbours(_edges(spark, d, 1), nodes_t1(spark, d))


@check("j11_zone_join", with_ctes(NODE_SQL, ZONE_SQL, select=(
    f"SELECT zone_name, n.node_id, round({hav_sql('n', 'z')}, 3) AS distance_m FROM node1 n JOIN zone z ON {hav_sql('n', 'z')} <= radius_m")))
def _(spark, d):
    inside = zone_join(nodes_t1(spark, d), zones(spark, d))
    return inside.select("zone_name", "node_id", F.round("distance_m", 3).alias("distance_m"))


# --- graph building and deltas ----------------------------------------------------------------

EDGE_COLS = "edge_id, source_id, target_id, relation_type, distance_m, epoch"


@check("g1_radius_network", with_ctes(NODE_SQL, edge_sql(1), select=f"SELECT {EDGE_COLS} FROM edge1"))
def _(spark, d):
    return _edges(spark, d, 1)


@check("g1_knn_network", with_ctes(NODE_SQL, edge_sql(2), select=(
    f"SELECT {EDGE_COLS} FROM edge2 WHERE edge_id IN (SELECT edge_id FROM (SELECT edge_id, row_number() OVER (PARTITION BY me ORDER BY d, you) "
    "AS k FROM (SELECT edge_id, d, source_id AS me, target_id AS you FROM edge2 UNION ALL SELECT edge_id, d, target_id, source_id FROM edge2)) "
    "WHERE k <= 3)")))
def _(spark, d):
    return graph.knn_network(nodes_t2(spark, d), 3, EDGE_M)


_HAB = hav_sql("a", "b")


@check("g1_gabriel_network", with_ctes(
    NODE_SQL, edge_sql(1),
    f"ge AS (SELECT e.*, (a.lat + b.lat) / 2 AS mlat, (a.lon + b.lon) / 2 AS mlon, {plane_sql('a', 'b')} / 2 AS half FROM edge1 e "
    "JOIN node1 a ON a.node_id = source_id JOIN node1 b ON b.node_id = target_id), "
    "near_mid AS (SELECT g.*, CAST(floor(mlat / 0.002::DOUBLE) AS BIGINT) + dy AS cy, CAST(floor(mlon / 0.0025::DOUBLE) AS BIGINT) + dx AS cx FROM ge g, "
    "(SELECT unnest([-1, 0, 1]) AS dy) y, (SELECT unnest([-1, 0, 1]) AS dx) x), "
    "m AS (SELECT m.*, c.lat AS lat, c.lon AS lon FROM near_mid m JOIN node1 c ON CAST(floor(c.lat / 0.002::DOUBLE) AS BIGINT) = cy "
    "AND CAST(floor(c.lon / 0.0025::DOUBLE) AS BIGINT) = cx), "
    "mm AS (SELECT edge_id, half, mlat AS lat, mlon AS lon, struct_pack(lat := lat, lon := lon) AS c FROM m), "
    f"blocked AS (SELECT edge_id FROM (SELECT edge_id, half, {plane_sql('mm', 'mm.c')} AS d FROM mm) WHERE d < half * (1 - 1e-9) - 1e-6::DOUBLE)",
    select=f"SELECT {EDGE_COLS} FROM edge1 WHERE edge_id NOT IN (SELECT edge_id FROM blocked)"))
def _(spark, d):
    return graph.gabriel_network(nodes_t1(spark, d), EDGE_M, LAT0, LON0)


@check("g1_triangulated_network")
def _(spark, d):
    return graph.triangulated_network(nodes_t1(spark, d), 1200.0, LAT0, LON0)


@check("w4_ordered_network", with_ctes(NODE_SQL, "rk AS (SELECT *, row_number() OVER (ORDER BY node_id) AS k FROM node1)", select=(
    f"SELECT a.node_id AS source_id, b.node_id AS target_id, {_relation('a', 'b', _HAB)} AS relation_type, "
    f"round_even({_HAB}, 2) AS distance_m FROM rk a JOIN rk b ON b.k BETWEEN a.k + 1 AND a.k + 5 WHERE {_HAB} <= 1200")))
def _(spark, d):
    return graph.ordered_network(nodes_t1(spark, d)).select("source_id", "target_id", "relation_type", "distance_m")


@check("w5_undirected_edges", with_ctes(NODE_SQL, edge_sql(1), select=(
    "SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(edge_id) AS edge_id FROM "
    "(SELECT edge_id, source_id, target_id FROM edge1 UNION ALL SELECT edge_id || 'r', target_id, source_id FROM edge1) GROUP BY 1, 2")))
def _(spark, d):
    e = _edges(spark, d, 1)
    back = e.withColumns({"edge_id": F.concat("edge_id", F.lit("r")), "source_id": F.col("target_id"), "target_id": F.col("source_id")})
    return graph.undirected_edges(e.unionByName(back)).select(F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"), "edge_id")


@check("d1_added_nodes", with_ctes(*DELTA, select="SELECT node_id, class, area_m2 FROM added"))
def _(spark, d):
    return _delta(spark, d)[3].select("node_id", "class", "area_m2")


@check("d2_removed_nodes", with_ctes(*DELTA, select="SELECT node_id, class, area_m2 FROM removed"))
def _(spark, d):
    return _delta(spark, d)[4].select("node_id", "class", "area_m2")


@check("d3_modified_nodes", with_ctes(*DELTA, select=(
    "SELECT old_id, new_id, class_t1, class_t2, area_t1_m2, round(area_t2_m2, 4) AS area_t2_m2, round_even(gap, 2) AS area_delta_m2, "
    "round_even(share, 3) AS relative_change, round_even(shift_m, 2) AS centroid_shift_m, round(lat, 6) AS lat_t2, "
    f"round(lon, 6) AS lon_t2, {BOX_SQL} FROM modified")))
def _(spark, d):
    m = _delta(spark, d)[5].drop("_gap")
    rounded = {c: F.round(c, 6) for c in ("lat_t2", "lon_t2", "min_lat", "min_lon", "max_lat", "max_lon")}
    return m.withColumns(rounded).withColumn("area_t2_m2", F.round("area_t2_m2", 4))


@check("d4_altered_area", with_ctes(*DELTA, select=(
    "SELECT 'EMERGED' AS status, count(*) AS n, round(sum(area_m2), 2) AS altered_m2 FROM added UNION ALL "
    "SELECT 'REMOVED', count(*), round(sum(area_m2), 2) FROM removed UNION ALL "
    "SELECT 'MODIFIED', count(*), round(sum(gap), 2) FROM modified")))
def _(spark, d):
    _, _, _, added, removed, modified = _delta(spark, d)
    tagged = graph.tagged_delta(added, removed, modified)
    return tagged.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("altered_m2"), 2).alias("altered_m2"))


_EDGE_DIFF = (
    "plus AS (SELECT * FROM edge2 WHERE (least(source_id, target_id), greatest(source_id, target_id)) NOT IN "
    "(SELECT (least(source_id, target_id), greatest(source_id, target_id)) FROM edge1))",
    "minus AS (SELECT * FROM edge1 WHERE (least(source_id, target_id), greatest(source_id, target_id)) NOT IN "
    "(SELECT (least(source_id, target_id), greatest(source_id, target_id)) FROM edge2))",
)


@check("d5_edge_difference", with_ctes(NODE_SQL, edge_sql(1), edge_sql(2), *_EDGE_DIFF, select=(
    "SELECT 'ADDED' AS status, edge_id FROM plus UNION ALL SELECT 'REMOVED', edge_id FROM minus")))
def _(spark, d):
    plus, minus = graph.edge_difference(save_table(_edges(spark, d, 1), "e1"), save_table(_edges(spark, d, 2), "e2"))
    return plus.select(F.lit("ADDED").alias("status"), "edge_id").unionByName(minus.select(F.lit("REMOVED").alias("status"), "edge_id"))


_POINTS = "points AS (SELECT lat, lon FROM added UNION ALL SELECT lat, lon FROM modified)"
_PAD_LAT = f"{2500.0 / 111320.0!r}"
_PAD_LON = f"(2500.0::DOUBLE / (111320.0::DOUBLE * cos(radians({LAT0}::DOUBLE))))"
_BOXES = (
    "boxes AS (SELECT CAST(trunc(lat / 0.05::DOUBLE) AS INT) AS cell_lat, CAST(trunc(lon / 0.05::DOUBLE) AS INT) AS cell_lon, "
    f"round_even(greatest(min(lat) - {_PAD_LAT}, -90), 6) AS min_lat, round_even(greatest(min(lon) - {_PAD_LON}, -180), 6) AS min_lon, "
    f"round_even(least(max(lat) + {_PAD_LAT}, 90), 6) AS max_lat, round_even(least(max(lon) + {_PAD_LON}, 180), 6) AS max_lon, "
    "count(*) AS n_points FROM points GROUP BY 1, 2)"
)


@check("d6_change_points", with_ctes(*DELTA, _POINTS, select="SELECT round(lat, 6) AS lat, round(lon, 6) AS lon FROM points"))
def _(spark, d):
    _, _, _, added, _, modified = _delta(spark, d)
    return graph.change_points(added, modified).withColumns(r6("lat", "lon"))


@check("d7_unique_pairs", with_ctes(NODE_SQL, edge_sql(2), select="SELECT source_id, target_id FROM edge2"))
def _(spark, d):
    return graph.close_pairs(nodes_t2(spark, d), EDGE_M).select("source_id", "target_id")


@check("a14_candidate_boxes", with_ctes(*DELTA, _POINTS, _BOXES, select="SELECT * FROM boxes"))
def _(spark, d):
    _, _, _, added, _, modified = _delta(spark, d)
    return graph.candidate_boxes(graph.change_points(added, modified), LAT0)


@check("g4_delta_summary", with_ctes(*DELTA, _POINTS, _BOXES, edge_sql(1), edge_sql(2), *_EDGE_DIFF, select=(
    "SELECT (SELECT count(*) FROM node1) AS baseline_node_count, (SELECT count(*) FROM node2) AS target_node_count, "
    "(SELECT count(*) FROM added) AS added_node_count, (SELECT count(*) FROM removed) AS removed_node_count, "
    "(SELECT count(*) FROM modified) AS modified_node_count, (SELECT count(*) FROM plus) AS added_edge_count, "
    "(SELECT count(*) FROM minus) AS removed_edge_count, (SELECT count(*) FROM boxes) AS candidate_bbox_count, "
    "round_even(t.m2, 2) AS total_altered_area_m2, round_even(t.m2 / 10000.0::DOUBLE, 4) AS total_altered_area_ha FROM "
    "(SELECT (SELECT sum(area_m2) FROM added) + (SELECT sum(area_m2) FROM removed) + (SELECT sum(gap) FROM modified) AS m2) t")))
def _(spark, d):
    e1, e2 = save_table(_edges(spark, d, 1), "e1"), save_table(_edges(spark, d, 2), "e2")
    return graph.compile_delta(nodes_t1(spark, d), nodes_t2(spark, d), e1, e2, LAT0, LON0).summary


# --- structural queries -----------------------------------------------------------------------


@check("g5_structural_query", with_ctes(NODE_SQL, select=(
    f"SELECT node_id, class, area_m2, {POS_SQL}, {BOX_SQL} FROM node2 s WHERE class = 'Airstrip' AND area_m2 >= 10000 "
    "AND node_id NOT IN (SELECT node_id FROM node1) AND (node_id LIKE 'delta%' OR delta_status <> '') "
    f"AND EXISTS (SELECT 1 FROM node2 o WHERE o.class = 'Road' AND o.node_id <> s.node_id AND {hav_sql('s', 'o')} <= 800)")))
def _(spark, d):
    hits = structural.structural_query(
        nodes_t2(spark, d), "Airstrip", "Road", delta_only=True, baseline=nodes_t1(spark, d)
    )
    return _round_box(hits)


@check("g5_match_count", with_ctes(NODE_SQL, select="SELECT count(*) AS matched_count FROM node2 WHERE class = 'Structure' AND area_m2 >= 10000"))
def _(spark, d):
    return structural.match_count(structural.structural_query(nodes_t2(spark, d), "Structure"))


_Q1 = (
    f"q1 AS (SELECT s.node_id AS site_id, s.area_m2, s.lat, s.lon, s.min_lat, s.min_lon, s.max_lat, s.max_lon, o.node_id AS road_id, "
    f"{hav_sql('s', 'o')} AS d FROM fresh s JOIN node2 o ON o.class = 'Road' AND {near_sql('s', 'o', 800.0)} "
    f"WHERE s.class = 'Airstrip' AND s.area_m2 >= 15000 AND {hav_sql('s', 'o')} <= 800)"
)
_Q1_SELECT = f"SELECT site_id, area_m2, {POS_SQL}, {BOX_SQL}, road_id, round(d, 3) AS road_distance_m FROM "


@check("q1_sites_near_roads", with_ctes(*TO_NEW, _Q1, select=_Q1_SELECT + "q1"))
def _(spark, d):
    q = structural.large_sites_near_roads(nodes_t2(spark, d), _existed(spark, d), T2_EPOCH, T1_EPOCH)
    return _round_box(q).withColumn("road_distance_m", F.round("road_distance_m", 3))


@check("q1_nearest_only", with_ctes(*TO_NEW, _Q1, select=_Q1_SELECT + (
    "(SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY d, road_id) AS k FROM q1) WHERE k = 1")))
def _(spark, d):
    q = structural.large_sites_near_roads(nodes_t2(spark, d), _existed(spark, d), T2_EPOCH, T1_EPOCH, nearest_only=True)
    return _round_box(q).withColumn("road_distance_m", F.round("road_distance_m", 3))


@check("q2_structure_clusters", with_ctes(
    *TO_NEW,
    f"sr AS (SELECT s.node_id AS core_id, {hav_sql('s', 'o')} AS d FROM fresh s JOIN node2 o ON o.class = 'Road' "
    f"AND {near_sql('s', 'o', 500.0)} WHERE s.class = 'Structure' AND {hav_sql('s', 'o')} <= 500)",
    f"pe AS (SELECT s.node_id AS core_id, o.node_id AS peer FROM fresh s JOIN node2 o ON o.class = 'Structure' AND o.node_id <> s.node_id "
    f"AND {near_sql('s', 'o', 300.0)} WHERE s.class = 'Structure' AND {hav_sql('s', 'o')} <= 300)",
    "dens AS (SELECT core_id, d, count(*) AS cluster_density FROM sr JOIN pe USING (core_id) GROUP BY 1, 2 HAVING count(*) >= 3)",
    select=(f"SELECT core_id, {POS_SQL}, {BOX_SQL}, cluster_density, round(d, 3) AS road_distance_m FROM dens "
            "JOIN fresh ON node_id = core_id")))
def _(spark, d):
    q = structural.structure_clusters(nodes_t2(spark, d), _existed(spark, d), T2_EPOCH, T1_EPOCH)
    return _round_box(q).withColumn("road_distance_m", F.round("road_distance_m", 3))


_F_BOX = ", ".join(f"round(f.{c}, 6) AS {c}" for c in ("lat", "lon", "min_lat", "min_lon", "max_lat", "max_lon"))


@check("q3_earthworks", with_ctes(*TO_NEW, edge_sql(2), select=(
    f"SELECT f.node_id, f.area_m2, f.aspect_ratio, {_F_BOX}, t.node_id AS target_id, t.class AS target_class FROM fresh f "
    "LEFT JOIN (edge2 e JOIN node2 t ON t.node_id = e.target_id) "
    "ON e.source_id = f.node_id AND e.relation_type = 'DEFENDS' WHERE f.class = 'Revetment'")))
def _(spark, d):
    return _round_box(structural.earthworks_with_targets(
        nodes_t2(spark, d), _edges(spark, d, 2), _existed(spark, d), T2_EPOCH, T1_EPOCH))


@check("q4_new_roads", with_ctes(*TO_NEW, edge_sql(2), select=(
    "SELECT f.node_id AS road_id, f.area_m2, p.node_id AS post_id, round(p.lat, 6) AS post_lat, round(p.lon, 6) AS post_lon, "
    + ", ".join(f"round(f.{c}, 6) AS {c}" for c in ("min_lat", "min_lon", "max_lat", "max_lon"))
    + " FROM fresh f JOIN edge2 e ON e.source_id = f.node_id AND e.relation_type = 'CONNECTED_BY_ROAD' "
    "JOIN node2 p ON p.node_id = e.target_id WHERE f.class = 'Road' AND p.class = 'MilitaryPost'")))
def _(spark, d):
    q = structural.new_roads_to_class(
        nodes_t2(spark, d), _edges(spark, d, 2), _existed(spark, d), T2_EPOCH, T1_EPOCH, "MilitaryPost")
    return _round_box(q).withColumns(r6("post_lat", "post_lon"))


@check("q5_largest_new_boxes", with_ctes(*TO_NEW, select=(
    f"SELECT node_id, {BOX_SQL}, class, area_m2 FROM fresh WHERE class IN ('Airstrip', 'Revetment', 'Structure', 'GradedArea', 'MilitaryPost') "
    "ORDER BY fresh.area_m2 DESC, node_id LIMIT 50")))
def _(spark, d):
    return _round_box(structural.largest_new_boxes(nodes_t2(spark, d), _existed(spark, d), T2_EPOCH, T1_EPOCH))


@check("q6_new_in_zone", with_ctes(*TO_NEW, ZONE_SQL, select=(
    "SELECT zone_name, node_id, class, area_m2, round(d, 3) AS distance_m, " + BOX_SQL + " FROM "
    f"(SELECT z.zone_name, radius_m, n.*, {hav_sql('n', 'z')} AS d FROM fresh n, zone z) WHERE d <= radius_m")))
def _(spark, d):
    q = structural.new_in_zone(nodes_t2(spark, d), zones(spark, d), _existed(spark, d), T2_EPOCH, T1_EPOCH)
    return _round_box(q).withColumn("distance_m", F.round("distance_m", 3))


@check("q7_change_by_class", with_ctes(*TO_NEW, select=(
    "SELECT class, count(*) AS entity_count, round(sum(area_m2), 2) AS total_area_m2, round(sum(area_m2) / 10000.0::DOUBLE, 4) AS total_area_ha, "
    "round(avg(confidence), 3) AS mean_confidence FROM fresh GROUP BY 1")))
def _(spark, d):
    return structural.change_by_class(nodes_t2(spark, d), _existed(spark, d), T2_EPOCH, T1_EPOCH)


# --- sources and sinks ------------------------------------------------------------------------

_FEATURE_TEXT = (
    "concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[[', min_lon, ',', min_lat, '],[', max_lon, ',', min_lat,"
    " '],[', max_lon, ',', max_lat, '],[', min_lon, ',', max_lat, '],[', min_lon, ',', min_lat, ']]]},\"properties\":{\"id\":\"', node_id,"
    " '\",\"area_m2\":', CASE WHEN area_m2 > 15000 THEN area_m2 ELSE 0 END, ',\"type\":\"', CASE WHEN area_m2 > 10000 THEN class ELSE '' END,"
    " '\"}}')"
)
_H, _W = "((max_lat - min_lat) * 111320.0::DOUBLE)", "((max_lon - min_lon) * 111320.0::DOUBLE * cos(radians((min_lat + max_lat) / 2)))"
_PARSED = (
    f"pm AS (SELECT *, (min_lat + max_lat) / 2 AS clat, (min_lon + max_lon) / 2 AS clon, CASE WHEN area_m2 > 15000 THEN area_m2 "
    f"ELSE greatest({_H} * {_W} * 0.7::DOUBLE, 50) END AS ar, 2.0::DOUBLE * ({_H} + {_W}) AS rim, "
    f"greatest(greatest({_H}, 1) / greatest({_W}, 1), greatest({_W}, 1) / greatest({_H}, 1)) AS asp FROM node1)"
)


@check("s6_geojson_nodes", with_ctes(NODE_SQL, _PARSED, select=(
    "SELECT node_id, round(clat, 6) AS lat, round(clon, 6) AS lon, round_even(ar, 2) AS area_m2, round_even(rim, 2) AS perimeter_m, "
    "round_even(asp, 2) AS aspect_ratio, 0.95::DOUBLE AS confidence, CASE WHEN area_m2 > 10000 THEN class "
    "WHEN ar >= 15000 AND asp < 2.5 THEN 'GradedArea' "
    "WHEN ar BETWEEN 300 AND 4000 AND 4 * pi() * ar / greatest(rim * rim, 1e-4) < 0.4 THEN 'Revetment' "
    "WHEN ar >= 50 THEN 'Structure' ELSE 'Unknown' END AS class FROM pm WHERE ar >= 25")))
def _(spark, d):
    text = nodes_t1(spark, d).select(F.xxhash64("node_id").alias("idx"), F.expr(_FEATURE_TEXT).alias("feature"))
    nodes = geojson.nodes_from_features(geojson.parse_features(text, "feature"), T1_EPOCH)
    return nodes.select(
        "node_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "area_m2", "perimeter_m", "aspect_ratio",
        "confidence", "class",
    )


@check("s10_graph_statements", with_ctes(NODE_SQL, edge_sql(1), select=(
    "SELECT 0 AS part, class AS kind, node_id AS ids, area_m2 AS value FROM node1 UNION ALL "
    "SELECT 1, relation_type, source_id || ' ' || target_id || ' ' || edge_id, distance_m FROM edge1")))
def _(spark, d):
    s = tables.graph_statements(nodes_t1(spark, d), _edges(spark, d, 1))
    return s.select(
        "part", F.regexp_extract("statement", r"(?:n:SpatialEntity:|\[r:)(\w+)", 1).alias("kind"),
        F.array_join(F.regexp_extract_all("statement", F.lit(r"\{id: '([^']*)'\}")), " ").alias("ids"),
        F.regexp_extract("statement", r"(?:area_m2|distance_m) = ([^,]+),", 1).cast("double").alias("value"))


@check("s11_delta_statements", with_ctes(*DELTA, select=(
    "SELECT 'EMERGED' AS status, node_id, area_m2 AS value FROM added UNION ALL SELECT 'MODIFIED', old_id, area_t2_m2 FROM modified")))
def _(spark, d):
    _, _, _, added, removed, modified = _delta(spark, d)
    s = tables.delta_statements(graph.tagged_delta(added, removed, modified))
    return s.filter(F.col("statement").contains("delta_status")).select(
        "status", F.regexp_extract("statement", r"\{id: '([^']*)'\}", 1).alias("node_id"),
        F.regexp_extract("statement", r"n\.area_(?:t2_)?m2 = ([^,]+),", 1).cast("double").alias("value"))


@check("s12_graph_document", with_ctes(NODE_SQL, edge_sql(1), select=(
    "SELECT 'header' AS kind, (SELECT count(*) FROM node1) || ' ' || (SELECT count(*) FROM edge1) AS id, NULL AS class, NULL::DOUBLE AS value "
    "UNION ALL SELECT 'node', node_id, class, area_m2 FROM node1 UNION ALL SELECT 'edge', edge_id, relation_type, distance_m FROM edge1")))
def _(spark, d):
    doc = tables.graph_document(nodes_t1(spark, d), _edges(spark, d, 1))
    get = lambda p: F.get_json_object("json", p)
    counts = F.when(F.col("kind") == "header", F.concat_ws(" ", get("$.node_count"), get("$.edge_count")))
    return doc.select(
        "kind", F.coalesce(counts, get("$.node_id"), get("$.edge_id")).alias("id"), F.coalesce(get("$.class"), get("$.relation_type")).alias("class"),
        F.coalesce(get("$.area_m2"), get("$.distance_m")).cast("double").alias("value"))


