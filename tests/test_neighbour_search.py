"""Rank selection, k nearest neighbours, Gabriel edges and zones of mixed radius against brute force."""

import numpy as np
import pandas as pd
import pytest
from helpers import haversine
from pyspark.sql import functions as F

from terradrift.functions.geo import EARTH_RADIUS_M
from terradrift.operators import graph, raster
from terradrift.operators.spatial_join import nearest_k, zone_join


def test_percentiles_of_real_valued_bands(spark):
    rng = np.random.default_rng(1)
    n = 200_000
    table = pd.DataFrame({"scene_id": np.where(np.arange(n) % 3, "hot", "b"), "row": np.arange(n), "col": 0})
    table["even"], table["heavy"] = rng.random(n), np.exp(rng.normal(size=n) * 12) * rng.choice([-1, 1], n)
    table["ties"], table["one"] = np.where(rng.random(n) < 0.97, 5.0, rng.normal(size=n)), 7.25
    table.loc[table.index % 11 == 0, "even"] = np.nan
    bands = ["even", "heavy", "ties", "one"]
    px = spark.createDataFrame(table).withColumn("even", F.nanvl("even", F.lit(None).cast("double"))).repartition(7)
    got = {(r["scene_id"], r["band"]): (r["p_low"], r["p_high"]) for r in raster.band_percentiles(px, bands, 1.7, 99.1).collect()}
    for scene, part in table.groupby("scene_id"):
        for b in bands:
            v = part[b].dropna()
            v = v[v != 0]
            assert got[scene, b] == pytest.approx(tuple(np.percentile(v, [1.7, 99.1])), rel=1e-12), (scene, b)


def test_rank_selection_shuffles_bins_only(spark):
    values = spark.range(300_000).select(F.lit("k").alias("k"), (F.rand(3) * 1e6).alias("v")).repartition(8)
    values = spark.createDataFrame(values.toPandas())
    plain = np.sort(values.toPandas()["v"].to_numpy())
    ranks = spark.createDataFrame([("k", r, float(plain[0]), float(plain[-1])) for r in (0, 1, 777, 150_000, 299_999)], "k string, rank long, lo double, hi double")
    got = {r["rank"]: r["v"] for r in raster.select_ranks(values, ranks, ["k"], bins=64).collect()}
    assert got == {r: plain[r] for r in got} and len(got) == 5
    assert raster.select_ranks(values.limit(0), ranks.limit(0), ["k"]).count() == 0


def places(kind):
    rng = np.random.default_rng(4)
    if kind == "cluster":  # dense spots of very different density, and a few far nodes
        centre = rng.normal(size=(6, 2)) * 0.02
        spread = np.repeat(10.0 ** -np.arange(1, 7), 60)[:, None] * 0.02
        p = np.repeat(centre, 60, 0) + rng.normal(size=(360, 2)) * spread
        p = np.vstack([p, rng.normal(size=(20, 2)) * 0.05])
    elif kind == "grid":  # ties everywhere
        p = np.array([(i, j) for i in range(14) for j in range(14)]) * 0.001
    else:  # many nodes at one place
        p = np.vstack([np.zeros((300, 2)), rng.normal(size=(40, 2)) * 0.003])
    return p + [34.0, 75.0]


@pytest.mark.parametrize("kind", ["cluster", "grid", "place"])
def test_k_nearest_equal_brute_force(spark, kind):
    p = np.round(places(kind), 9)
    ids = [f"n{(i * 7919) % 10_007:05d}" for i in range(len(p))]
    nodes = spark.createDataFrame(list(zip(ids, *p.T.tolist())), "node_id string, lat double, lon double")
    k, reach = 4, 1500.0
    d = haversine(p[:, None, 0], p[:, None, 1], p[None, :, 0], p[None, :, 1])
    want = {}
    for i, me in enumerate(ids):
        rest = sorted((round(float(d[i, j]), 6), ids[j]) for j in range(len(ids)) if j != i and d[i, j] <= reach)
        want[me] = [x for x, _ in rest[:k]], rest
    got = {}
    for r in nearest_k(nodes, "node_id", k, reach).collect():
        got.setdefault(r["node_id"], []).append((round(r["distance_m"], 6), r["other"]))
    for me, (best, rest) in want.items():
        mine = sorted(got.get(me, []))
        assert [x for x, _ in mine] == pytest.approx(best, abs=2e-6), me
        assert {o for _, o in mine} <= {o for x, o in rest if x <= (best[-1] if best else 0) + 2e-6}
    if kind == "place":  # equal distances go to the smaller ids
        first = sorted(i for i, q in zip(ids, p.tolist()) if q == [34.0, 75.0])
        assert sorted(o for _, o in got[first[-1]]) == first[:k] and sorted(o for _, o in got[first[0]]) == first[1 : k + 1]


def test_knn_plan_lists_no_pairs_within_reach(spark):
    """Candidates stay near n * k although every node is within reach of every other."""
    rng = np.random.default_rng(5)
    p = rng.random((3_000, 2)) * 0.01
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "node_id long, lat double, lon double")
    from terradrift.operators import spatial_join

    sizes, join = [], spatial_join.distance_join

    def counted(*a, **b):
        out = join(*a, **b)
        sizes.append(out.count())
        return out

    spatial_join.distance_join = counted
    try:
        assert nearest_k(nodes, "node_id", 3, 5_000.0).count() == 9_000
    finally:
        spatial_join.distance_join = join
    assert sum(sizes) < 3_000 * 500 < 3_000 * 2_999


def test_gabriel_edges_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    p = np.vstack([rng.random((120, 2)) * 0.02, [[0.03, 0.03], [0.03, 0.031]], np.array([(i, j) for i in range(4) for j in range(4)]) * 0.0005 + 0.04]) + [34.0, 75.0]
    rows = [(f"n{i:03d}", "Structure", float(a), float(b), "2024-01-15") for i, (a, b) in enumerate(p)]
    nodes = spark.createDataFrame(rows, "node_id string, class string, lat double, lon double, epoch string")
    x, y = np.radians(p[:, 1] - 75.0) * EARTH_RADIUS_M * np.cos(np.radians(34.0)), np.radians(p[:, 0] - 34.0) * EARTH_RADIUS_M
    want = set()
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            r = np.hypot(x[i] - x[j], y[i] - y[j]) / 2
            d = np.hypot(x - (x[i] + x[j]) / 2, y - (y[i] + y[j]) / 2)
            d[[i, j]] = np.inf
            if haversine(*p[i], *p[j]) <= 1500 and not (d < r * (1 - 1e-9) - 1e-6).any():
                want.add((rows[i][0], rows[j][0]))
    got = {(r["source_id"], r["target_id"]) for r in graph.gabriel_network(nodes, 1500.0, 34.0, 75.0).collect()}
    every = {(r["source_id"], r["target_id"]) for r in graph.triangulated_network(nodes, 1500.0, 34.0, 75.0).collect()}
    # Exact squares of the grid keep both diagonals in the triangulation; their circles hold the other corners on the rim only.
    assert got == want and got <= every and len(got) < len(every)
    assert graph.gabriel_network(nodes.limit(0)).count() == 0


def test_one_wide_zone_leaves_the_others_their_cells(spark, monkeypatch):
    from terradrift.operators import spatial_join

    rng = np.random.default_rng(7)
    nodes = spark.createDataFrame([(f"n{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.random((400, 2)) * [2, 2] + [33, 74])], "node_id string, lat double, lon double")
    rows = [(f"z{i}", float(a), float(b), 1000.0 + i % 50) for i, (a, b) in enumerate(rng.random((300, 2)) * [2, 2] + [33, 74])]
    zones = spark.createDataFrame(rows + [("wide", 34.0, 75.0, 90_000.0), ("none", 34.0, 75.0, None), ("point", float(rows[0][1]), float(rows[0][2]), 0.0)],
                                  "zone_name string, lat double, lon double, radius_m double")
    radii, join = [], spatial_join.distance_join
    monkeypatch.setattr(spatial_join, "distance_join", lambda a, b, r, *x, **y: (radii.append((r, a.count())), join(a, b, r, *x, **y))[1])
    got = {(r["zone_name"], r["node_id"]) for r in zone_join(nodes, zones).collect()}
    known = zones.filter("radius_m IS NOT NULL").collect()
    want = {(z["zone_name"], n["node_id"]) for z in known for n in nodes.collect() if haversine(z["lat"], z["lon"], n["lat"], n["lon"]) <= z["radius_m"]}
    assert got == want and dict(radii)[131072.0] == 1 and sum(n for r, n in radii if r <= 2048.0) == 301
    assert zone_join(nodes, zones.limit(0)).count() == 0




def test_gabriel_candidates_of_a_long_strip_stay_few(spark, monkeypatch):
    """Points on the rim see none outwards; the distance asked for bounds their pairs, also at high latitudes."""
    from terradrift.operators import triangulate

    rng = np.random.default_rng(11)
    n = 600
    lat, lon = 60 + np.repeat(np.arange(n // 2), 2) * 0.002 + rng.random(n) * 1e-3, 75 + np.tile([0, 0.004], n // 2) + rng.random(n) * 1e-3
    nodes = spark.createDataFrame([(f"n{i:03d}", "Road", float(a), float(o), 0) for i, (a, o) in enumerate(zip(lat, lon))],
                                  "node_id string, class string, lat double, lon double, epoch int")
    counted, find = [], triangulate._candidates
    monkeypatch.setattr(triangulate, "_candidates", lambda points: (counted.append(find(points).count()), find(points))[1])
    got = {(r["source_id"], r["target_id"]) for r in graph.gabriel_network(nodes, 400.0, 24.0, 75.0).collect()}
    x, y = np.radians(lon - 75) * 6371000 * np.cos(np.radians(24)), np.radians(lat - 24) * 6371000
    h = np.sin(np.radians(lat[:, None] - lat) / 2) ** 2 + np.cos(np.radians(lat[:, None])) * np.cos(np.radians(lat)) * np.sin(np.radians(lon[:, None] - lon) / 2) ** 2
    want = set()
    for i, j in zip(*np.nonzero(np.triu(2 * 6371000 * np.arcsin(np.sqrt(h)) <= 400, 1))):
        d = np.hypot(x - (x[i] + x[j]) / 2, y - (y[i] + y[j]) / 2)
        if (d < np.hypot(x[i] - x[j], y[i] - y[j]) / 2 * (1 - 1e-9) - 1e-6).sum() == 0:
            want.add((f"n{i:03d}", f"n{j:03d}"))
    assert got == want and len(want) > n / 2 and counted[0] < 10 * n


def test_triangulation_candidates_of_a_long_strip_stay_few(spark, monkeypatch):
    """Points on the rim see none outwards, but only those that their neighbours leave open meet far ones."""
    from terradrift.operators import triangulate

    rng = np.random.default_rng(12)
    n = 2000
    lat, lon = 24 + np.repeat(np.arange(n // 2), 2) * 0.002 + rng.random(n) * 1e-3, 75 + np.tile([0, 0.004], n // 2) + rng.random(n) * 1e-3
    nodes = spark.createDataFrame([(f"n{i:04d}", "Road", float(a), float(o), 0) for i, (a, o) in enumerate(zip(lat, lon))],
                                  "node_id string, class string, lat double, lon double, epoch int")
    counted, find = [], triangulate._candidates
    monkeypatch.setattr(triangulate, "_candidates", lambda points: (counted.append(find(points).count()), find(points))[1])
    got = {(r["source_id"], r["target_id"]) for r in graph.triangulated_network(nodes, 1200.0, 24.0, 75.0).collect()}
    x, y = np.radians(lon - 75) * 6371000 * np.cos(np.radians(24)), np.radians(lat - 24) * 6371000
    h = np.sin(np.radians(lat[:, None] - lat) / 2) ** 2 + np.cos(np.radians(lat[:, None])) * np.cos(np.radians(lat)) * np.sin(np.radians(lon[:, None] - lon) / 2) ** 2
    want = set()
    for i, j in zip(*np.nonzero(np.triu(2 * 6371000 * np.arcsin(np.sqrt(h)) <= 1200, 1))):
        dx, dy = x[j] - x[i], y[j] - y[i]
        px, py = np.delete(x - (x[i] + x[j]) / 2, [i, j]), np.delete(y - (y[i] + y[j]) / 2, [i, j])
        side = py * dx - px * dy
        centre = (px * px + py * py - (dx * dx + dy * dy) / 4) / (2 * side)
        if centre[side < 0].max(initial=-np.inf) < centre[side > 0].min(initial=np.inf):
            want.add((f"n{i:04d}", f"n{j:04d}"))
    assert got == want and len(want) > n and sum(counted) < 40 * n
