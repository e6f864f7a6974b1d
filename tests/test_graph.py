import json

import numpy as np
import pandas as pd
import pytest
from helpers import haversine
from pyspark.sql import functions as F

from terradrift.functions import geo
from terradrift.functions.classify import classify_geometry
from terradrift.functions.gridref import format_grid_ref, with_grid_ref
from terradrift.operators import graph
from terradrift.operators.spatial_join import (
    Plane, bbox_query, count_within, distance_join, has_within, nearest_join, radius_query, zone_join,
)
from terradrift.plans import structural
from terradrift.sources import geojson, tables


def nodes_frame(spark, rows, epoch="2025-01-15"):
    """rows: (id, class, lat, lon, area)."""
    df = spark.createDataFrame(rows, "node_id string, class string, lat double, lon double, area_m2 double")
    return df.selectExpr(
        "*", "40D AS perimeter_m", "1.5D AS aspect_ratio", "lat - 0.0001 AS min_lat", "lon - 0.0001 AS min_lon",
        "lat + 0.0001 AS max_lat", "lon + 0.0001 AS max_lon", f"DATE '{epoch}' AS epoch", "0.9D AS confidence",
        "map() AS properties",
    ).withColumn("properties", F.col("properties").cast("map<string,string>"))


def square(lat, lon, d=0.001):
    return [[[lon, lat], [lon + d, lat], [lon + d, lat + d], [lon, lat + d], [lon, lat]]]


def test_geojson_collection_gives_three_of_four(spark, tmp_path):
    feats = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square(34.0, 75.01, 0.002)},
         "properties": {"feature_id": f"f{i}", "area_sq_m": area, "tactical_class": hint}}
        for i, (area, hint) in enumerate([(45000, "airstrip east"), (8000, None), (1200, "a ROAD here"), (15, "tower")])
    ]
    extra = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [75.0, 34.0]}, "properties": {"id": "p", "confidence": 0.5}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[75.0, 34.0], [75.01, 34.0]]}, "properties": {"area_m2": "n/a"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [square(34.5, 75.5), square(34.6, 75.6)]}, "properties": {"id": "m"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": []}, "properties": {"id": "none"}},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats + extra}, indent=1))
    nodes = {n.node_id: n for n in geojson.nodes_from_features(geojson.read_collections(spark, str(tmp_path / "c.json")), "2025-01-15").collect()}
    assert set(nodes) == {"f0", "f1", "f2", "p", "m", "node_2025-01-15_00005"}
    assert (nodes["f0"]["class"], nodes["f2"]["class"]) == ("Airstrip", "Road")
    assert (nodes["f0"].lat, nodes["f0"].lon) == (pytest.approx(34.001), pytest.approx(75.011))
    assert nodes["p"].area_m2 == 50.0 and nodes["p"].confidence == 0.5 and nodes["p"].aspect_ratio == 1.0
    assert nodes["m"].max_lat == 34.601 and nodes["f1"].confidence == 0.95
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(json.dumps(f) for f in feats))
    assert geojson.nodes_from_features(geojson.read_feature_lines(spark, str(tmp_path / "lines")), "2025-01-15").count() == 3


@pytest.mark.parametrize("area,aspect,perimeter,want", [
    (6000, 9, 500, "Airstrip"), (4000, 9, 500, "Road"), (100, 1, 38, "Tower"), (20000, 1.5, 600, "GradedArea"),
    (2000, 2, 400, "Revetment"), (2000, 2, 180, "Structure"), (40, 2, 90, "Unknown"),
])
def test_shape_rules(spark, area, aspect, perimeter, want):
    got = classify_geometry(F.lit(float(area)), F.lit(float(aspect)), F.lit(float(perimeter)))
    assert spark.range(1).select(got).first()[0] == want


def test_geodesic_squares(spark):
    half = (5 / 110787 * 10, 5 / 100865 * 10)
    ring = [[75 - half[1], 25 - half[0]], [75 + half[1], 25 - half[0]], [75 + half[1], 25 + half[0]], [75 - half[1], 25 + half[0]]]
    hole = [[75.0, 25.0], [75.0, 25.0001], [75.0001, 25.0001], [75.0001, 25.0]]
    df = spark.createDataFrame([([ring + ring[:1]], [[ring + ring[:1], hole + hole[:1]]])],
                               "poly array<array<array<double>>>, geom array<array<array<array<double>>>>")
    full, holed = df.select(geo.ring_area_m2(F.col("poly")[0]), geo.multipolygon_area_m2("geom")).first()
    assert full == pytest.approx(10000, rel=0.005)
    assert holed == pytest.approx(full - 111.7, rel=0.01)
    globe = spark.range(1).select(geo.cell_area_m2(F.lit(-90.0), F.lit(90.0), F.lit(360.0))).first()[0]
    assert globe == pytest.approx(5.10065622e14, rel=1e-8)


def test_grid_references(spark):
    pts = spark.createDataFrame([(25.0, 75.0), (0.0, 3.0), (60.5, 4.0), (78.0, 15.0), (-33.9, 151.2), (89.0, 10.0)], "lat double, lon double")
    refs = [r.grid_ref for r in with_grid_ref(pts, "lat", "lon").collect()]
    assert refs[0] == "43R EP 00000 64974" or refs[0].startswith("43R E")
    assert refs[1] == "31N EA 00000 00000"
    assert refs[2].startswith("32V") and refs[3].startswith("33X") and refs[4].startswith("56H LH")
    assert refs[5] == "GRID-89.0N-10.0E"
    text = spark.createDataFrame([("43RBK1234567890",), ("3RBK1234567890",), ("odd",)], "r string")
    assert [r[0] for r in text.select(format_grid_ref("r")).collect()] == ["43R BK 12345 67890", "3R BK 12345 67890", "odd"]


def cloud(rng, n, lat, lon, spread):
    la, lo = lat + rng.normal(0, spread, n), lon + rng.normal(0, spread, n)
    k = n // 3
    la[:k], lo[:k] = lat + rng.normal(0, 1e-6, k), lon + rng.normal(0, 1e-6, k)
    la[: k // 4], lo[: k // 4] = lat, lon
    return np.clip(la, -90, 90), (lo + 180) % 360 - 180


@pytest.mark.parametrize("lat,lon,hot", [(25, 75, 5000), (25, 75, 20), (10, 179.999, 20), (89.99, 0, 5000), (-60, -180, 5000)])
def test_spatial_joins_match_brute_force(spark, lat, lon, hot):
    """A third of all points sit in one place; hot=20 sends them through the crowded-cell paths."""
    rng = np.random.default_rng(9)
    (la, lo), (lb, lob) = cloud(rng, 240, lat, lon, 0.01), cloud(rng, 200, lat, lon, 0.01)
    left = spark.createDataFrame(pd.DataFrame({"lid": [f"n{i}" for i in range(240)], "lat": la, "lon": lo}))
    right = spark.createDataFrame(pd.DataFrame({"rid": [f"n{i}" for i in range(200)], "lat": lb, "lon": lob}))
    d = haversine(la[:, None], lo[:, None], lb[None], lob[None])
    moved = right.selectExpr("rid", "lat AS r_lat", "lon AS r_lon")
    got = [(r.lid, r.rid) for r in distance_join(left, moved, 700.0, hot_cell=hot).collect()]
    want = {(f"n{i}", f"n{j}") for i, j in zip(*np.nonzero(d <= 700))}
    assert len(got) == len(want) and set(got) == want
    near = {r.lid: r.distance_m for r in nearest_join(left, right, 300.0, "lid", "rid", hot_cell=hot).collect()}
    best = {f"n{i}": d[i].min() for i in range(240) if d[i].min() <= 300}
    assert set(near) == set(best) and all(abs(near[k] - best[k]) < 1e-5 for k in best)
    counts = {r.lid: r.n for r in count_within(left, right, 700.0, "lid", "rid", hot_cell=hot).collect()}
    hits = d <= 700
    np.fill_diagonal(hits, False)
    assert counts == {f"n{i}": int(k) for i, k in enumerate(hits.sum(1)) if k}


def test_nearest_prefers_the_smaller_id_on_ties(spark):
    left = spark.createDataFrame([("a", 10.0, 20.0)], "lid string, lat double, lon double")
    right = spark.createDataFrame([("z", 10.0, 20.0), ("b", 10.0, 20.0)], "rid string, lat double, lon double")
    assert nearest_join(left, right, 5.0, "lid", "rid").first()["rid"] == "b"


def test_semi_join_excludes_the_node_itself(spark):
    n = nodes_frame(spark, [("a", "Road", 25.0, 75.0, 10.0), ("b", "Road", 26.0, 75.0, 10.0), ("c", "Road", 25.0001, 75.0, 10.0)])
    near = n.select(F.col("node_id").alias("near_id"), "lat", "lon")
    assert {r.node_id for r in has_within(n, near, 100.0, "node_id", "near_id").collect()} == {"a", "c"}


def test_line_queries(spark):
    rows = [(f"n{i}", "Road" if i % 2 else "Structure", 34 + 0.005 * i, 75 + 0.005 * i, 100.0) for i in range(20)]
    n = nodes_frame(spark, rows)
    assert radius_query(n, 34.0, 75.0, 1000.0, Plane(34.0, 75.0)).count() >= 1
    assert bbox_query(n, 34.0, 75.0, 34.015, 75.015).count() == 4
    assert n.filter("class = 'Road'").count() == 10


def test_five_nodes_network(spark):
    n = nodes_frame(spark, [
        ("a", "Structure", 34.0, 75.0, 100.0), ("b", "Road", 34.001, 75.001, 100.0), ("c", "Structure", 34.002, 75.0, 100.0),
        ("d", "Revetment", 34.004, 75.002, 100.0), ("far", "Structure", 34.05, 75.05, 100.0)])
    for edges in (graph.radius_network(n, 1500.0), graph.knn_network(n, 2, 1500.0), graph.triangulated_network(n, 1500.0)):
        e = edges.collect()
        assert len(e) >= 3 and all("far" not in (x.source_id, x.target_id) for x in e)
        assert any(x.relation_type == "CONNECTED_BY_ROAD" for x in e)


def delaunay_brute(x, y):
    """Edges with some circle through both ends and no point inside."""
    n, out = len(x), set()
    for i in range(n):
        for j in range(i + 1, n):
            mx, my, dx, dy = (x[i] + x[j]) / 2, (y[i] + y[j]) / 2, x[j] - x[i], y[j] - y[i]
            length = np.hypot(dx, dy)
            k = np.array([m for m in range(n) if m not in (i, j)])
            along = ((x[k] - mx) * dx + (y[k] - my) * dy) / length
            side = (-(x[k] - mx) * dy + (y[k] - my) * dx) / length
            t = (along**2 + side**2 - length**2 / 4) / (2 * side)
            hi = t[side > 0].min() if (side > 0).any() else np.inf
            lo = t[side < 0].max() if (side < 0).any() else -np.inf
            if lo < hi:
                out.add((i, j))
    return out


@pytest.mark.parametrize("reach", [900.0, 4000.0])
def test_triangulated_network_matches_empty_circle_search(spark, reach):
    rng = np.random.default_rng(21)
    la, lo = 34 + rng.random(70) * 0.03, 75 + rng.random(70) * 0.03
    la[:30], lo[:30] = 34.01 + rng.random(30) * 0.001, 75.01 + rng.random(30) * 0.001
    ids = [f"n{i:02d}" for i in range(70)]
    n = nodes_frame(spark, [(i, "Structure", float(a), float(b), 100.0) for i, a, b in zip(ids, la, lo)])
    c = np.cos(np.radians(34.0)) * 6371000
    edges = delaunay_brute(np.radians(lo - 75) * c, np.radians(la - 34) * 6371000)
    dist = haversine(la[:, None], lo[:, None], la[None], lo[None])
    want = {(ids[i], ids[j]) for i, j in edges if dist[i, j] <= reach}
    got = {(e.source_id, e.target_id) for e in graph.triangulated_network(n, reach, 34.0, 75.0).collect()}
    assert got == want


def test_ordered_network_joins_next_five(spark):
    n = nodes_frame(spark, [(f"n{i:02d}", "Structure", 34.0, 75 + 0.0001 * i, 50.0) for i in range(10)])
    assert graph.ordered_network(n).count() == sum(min(5, 9 - i) for i in range(10))


def test_two_epoch_delta(spark):
    n1 = nodes_frame(spark, [("a", "Structure", 34.0, 75.0, 1000.0), ("b", "Structure", 34.02, 75.02, 500.0)], "2024-01-15")
    n2 = nodes_frame(spark, [("a2", "Structure", 34.0001, 75.0, 1600.0), ("c", "Airstrip", 34.05, 75.05, 35000.0)])
    e1, e2 = graph.radius_network(n1, 5000.0), graph.radius_network(n2, 10000.0)
    delta = graph.compile_delta(n1, n2, e1, e2, 34.0, 75.0)
    s = delta.summary.first()
    assert (s.added_node_count, s.removed_node_count, s.modified_node_count) == (1, 1, 1)
    assert delta.modified.first().area_delta_m2 == 600.0
    assert (s.added_edge_count, s.removed_edge_count) == (1, 1) and s.candidate_bbox_count >= 1
    assert s.total_altered_area_m2 == 35000 + 500 + 600
    mapped = graph.compile_delta(n1, n2, e1, e2, 34.0, 75.0, match_edge_ids=True).added_edges.first()
    assert {mapped.source_id, mapped.target_id} == {"a", "c"}


def test_delta_from_an_empty_baseline_adds_all(spark):
    n2 = nodes_frame(spark, [("a", "Road", 34.0, 75.0, 10.0), ("b", "Road", 34.1, 75.0, 20.0)])
    e = graph.radius_network(n2, 10.0)
    s = graph.compile_delta(n2.limit(0), n2, e, e, 34.0, 75.0).summary.first()
    assert (s.added_node_count, s.total_altered_area_m2) == (2, 30.0)


def test_candidate_boxes_truncate_towards_zero(spark):
    pts = spark.createDataFrame([(0.01, 0.01), (-0.01, -0.01), (0.06, 0.01)], "lat double, lon double")
    assert graph.candidate_boxes(pts, 0.0).count() == 2


def test_structural_query_variants(spark):
    n = nodes_frame(spark, [
        ("s1", "Airstrip", 34.0, 75.0, 20000.0), ("delta_s2", "Airstrip", 34.1, 75.1, 20000.0), ("s3", "Airstrip", 34.0, 75.0, 500.0),
        ("r", "Road", 34.001, 75.0, 10.0)])
    ids = lambda df: {r.node_id for r in df.collect()}
    assert ids(structural.structural_query(n, "Airstrip", "Road")) == {"s1"}
    assert ids(structural.structural_query(n, "Airstrip")) == {"s1", "delta_s2"}
    assert ids(structural.structural_query(n, "Airstrip", delta_only=True)) == {"delta_s2"}
    assert ids(structural.structural_query(n, "Airstrip", baseline=n.filter("node_id = 's1'"))) == {"delta_s2"}


def test_zone_radii_are_individual(spark):
    n = nodes_frame(spark, [("a", "Road", 34.0, 75.0, 10.0), ("b", "Road", 34.02, 75.0, 10.0)])
    z = spark.createDataFrame([("small", 34.001, 75.0, 500.0), ("large", 34.001, 75.0, 5000.0)], "zone_name string, lat double, lon double, radius_m double")
    got = {(r.zone_name, r.node_id) for r in zone_join(n, z).collect()}
    assert got == {("small", "a"), ("large", "a"), ("large", "b")}


def test_insert_absent_and_statements(spark, tmp_path):
    n = nodes_frame(spark, [("a", "Road", 34.0, 75.0, 10.0), ("a", "Road", 34.0, 75.0, 10.0), ("b", "Tower", 34.02, 75.0, 10.0)])
    path = str(tmp_path / "nodes")
    assert tables.insert_absent(n, path, "node_id") == 2
    assert tables.insert_absent(n, path, "node_id") == 0
    edges = graph.radius_network(n.dropDuplicates(["node_id"]), 5000.0)
    text = [r.statement for r in tables.graph_statements(n, edges).orderBy("part").collect()]
    assert text[0].startswith("MERGE (n:SpatialEntity:") and "CONNECTED_BY_ROAD" in text[-1]


def test_latitudes_beyond_a_pole_keep_narrow_cells_and_sparse_points_few_copies(spark):
    from terradrift.operators.spatial_join import CELL, with_cell, with_near_cells

    rows = [(float(i), 95.0 + (i % 20) * 0.002, 75.0 + (i // 20) * 0.0025) for i in range(400)]
    points = spark.createDataFrame(rows, "id double, lat double, lon double")
    crowd = with_cell(points, 250.0).groupBy(*CELL).count().agg({"count": "max"}).first()[0]
    assert crowd <= 25  # all 400 points lie in about 20 bands, each of which was one cell before
    copies = with_near_cells(points, 2000.0, reach=250.0).count()
    assert copies < 3 * len(rows)
    left = points.withColumnRenamed("id", "lid")
    right = points.select(F.col("id").alias("rid"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    cell, wide = (distance_join(left, right, r).filter("lid < rid").select("lid", "rid").collect() for r in (250.0, 900.0))
    _, lat, lon = np.array(rows).T
    d = haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    for got, r in ((cell, 250.0), (wide, 900.0)):
        assert sorted(map(tuple, got)) == [(float(i), float(j)) for i, j in zip(*np.nonzero(np.triu(d <= r, 1)))]
