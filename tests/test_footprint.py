"""Footprints of invalid geometry against known shapes and an even-odd point count."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradrift.functions.geo import multipolygon_area_m2
from terradrift.operators.footprint import footprints, repaired

GEOMETRY = "id string, geometry array<array<array<array<double>>>>, x1 double, key int"


def box(a, b, c, d):
    a, b, c, d = map(float, (a, b, c, d))
    return [[a, b], [c, b], [c, d], [a, d], [a, b]]


def even_odd(rings, n=700):
    """Share of a grid over the bounding box that lies inside, and that box."""
    pts = np.array([p for r in rings for p in r])
    (x0, y0), (x1, y1) = pts.min(0), pts.max(0)
    gx, gy = np.meshgrid(x0 + (np.arange(n) + 0.5) / n * (x1 - x0), y0 + (np.arange(n) + 0.5) / n * (y1 - y0))
    odd = np.zeros(gx.shape, int)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
            if ay != by:
                odd += ((ay > gy) != (by > gy)) & (gx < ax + (gy - ay) / (by - ay) * (bx - ax))
    inside = odd % 2 == 1
    return inside.mean() * (x1 - x0) * (y1 - y0), gx[inside].mean(), gy[inside].mean()


def shapes():
    rng = np.random.default_rng(3)
    deg = 1e-3
    known = {
        "bow": [[[[0, 0], [2, 0], [0, 2], [2, 2], [0, 0]]]],
        "open": [[[[0, 0], [2, 0], [2, 2], [0, 2]]]],
        "hole": [[box(0, 0, 4, 4), box(1, 1, 2, 3)]],
        "edge": [[box(0, 0, 4, 4), box(0, 1, 2, 3)]],
        "isle": [[box(0, 0, 8, 8), box(1, 1, 7, 7), box(2, 2, 6, 6), box(3, 3, 5, 5)]],
        "apart": [[box(0, 0, 2, 2), box(5, 5, 6, 6)]],
        "beside": [[box(0, 0, 2, 2)], [box(2, 0, 4, 2)]],
        "corner": [[box(0, 0, 2, 2)], [box(2, 2, 4, 4)]],
        "spike": [[[[0, 0], [4, 0], [4, 2], [6, 2], [4, 2], [4, 4], [0, 4], [0, 0]]]],
        "star": [[[[math.sin(4 * math.pi * k / 5), math.cos(4 * math.pi * k / 5)] for k in (0, 1, 2, 3, 4, 0)]]],
        "across": [[box(0, 0, 4, 4), box(2, 2, 6, 6)]],
    }
    for i in range(12):
        known[f"random{i}"] = [[rng.random((rng.integers(4, 13), 2)).tolist()]]
    known["long"] = [[(rng.random((60, 2)) * [1, 0.3]).tolist(), box(0.2, 0.1, 0.7, 0.2)]]
    return {k: [[[[75 + x * deg, 25 + y * deg] for x, y in r] for r in p] for p in g] for k, g in known.items()}


@pytest.fixture(scope="module")
def features(spark):
    rows = [(k, g, 1.0, 2) for k, g in shapes().items()]
    rows += [("null", None, 1.0, 2), ("empty", [], 1.0, 2), ("line", [[[[75.0, 25.0], [75.1, 25.1], [75.0, 25.0]]]], 1.0, 2), ("point", [[[[75.0, 25.0]]]], 1.0, 2),
             ("twice", [[shapes()["open"][0][0], shapes()["open"][0][0]]], 1.0, 2), ("gap", [[[[75.0, 25.0], [None, 25.1], [75.0, 25.1], [75.1, 25.0]]]], 1.0, 2)]
    return spark.createDataFrame(rows, GEOMETRY)


def test_areas_and_centroids_equal_the_even_odd_rule(features):
    got = {r["id"]: r for r in footprints(features, "id").collect()}
    per_deg = got["open"]["area_sq_m"] / (2e-3) ** 2
    for k, g in shapes().items():
        area, lon, lat = even_odd([r for p in g for r in p])
        assert got[k]["area_sq_m"] == pytest.approx(area * per_deg, rel=0.01), k
        assert abs(got[k]["lon"] - lon) < 1e-5 and abs(got[k]["lat"] - lat) < 1e-5, k
        assert abs(got[k]["lon_area"] - got[k]["lon"]) < 2e-6 and abs(got[k]["lat_area"] - got[k]["lat"]) < 2e-6, k
    for k in ("null", "empty", "line", "point", "twice"):
        assert got[k]["area_sq_m"] == pytest.approx(0, abs=1e-6) and got[k]["lat"] is None, k
    assert len(got) == features.count()


def test_repaired_rings_hold_the_same_area(features):
    fixed = repaired(features, "id")
    both = footprints(features, "id").join(fixed, "id").select("id", "area_sq_m", multipolygon_area_m2("geometry").alias("again"), "geometry").collect()
    for r in both:
        assert r["again"] == pytest.approx(r["area_sq_m"], rel=1e-9, abs=1e-6), r["id"]
    count = {r["id"]: [len(p) for p in r["geometry"]] for r in both}
    assert count["bow"] == [1, 1] and count["corner"] == [1, 1] and count["beside"] == [1] and count["apart"] == [1, 1]
    assert sorted(count["isle"]) == [2, 2] and count["hole"] == [2] and count["edge"] == [1] and len(count["star"]) == 5
    assert count["null"] == [] and count["twice"] == []


def test_square_of_100_m_within_half_a_percent(spark):
    d_lat, d_lon = 100 / 110_787.0, 100 / 100_865.0
    g = [[box(75, 25, 75 + d_lon, 25 + d_lat)]]
    (r,) = footprints(spark.createDataFrame([("s", g, 0.0, 1)], GEOMETRY), "id").collect()
    assert r["area_sq_m"] == pytest.approx(10_000, rel=0.005) and r["area_hectares"] == pytest.approx(1, rel=0.005)
    assert r["grid_ref"].startswith("43R") and (r["lat"], r["lon"]) == (round(25 + d_lat / 2, 6), round(75 + d_lon / 2, 6))


def test_centroid_by_area_of_a_tall_cell(spark):
    (r,) = footprints(spark.createDataFrame([("t", [[box(10, 0, 11, 60)]], 0.0, 1)], GEOMETRY), "id").collect()
    s = math.degrees(math.asin(math.sin(math.radians(60)) / 2))
    assert r["lat"] == 30 and r["lon"] == 10.5 and r["lon_area"] == 10.5 and abs(r["lat_area"] - s) < 0.3


def test_work_grows_with_the_outline(spark):
    n = 20_000
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ring = np.stack([75 + 0.01 * np.cos(t), 25 + 0.01 * np.sin(t)], 1).tolist()
    (r,) = footprints(spark.createDataFrame([("c", [[ring]], 0.0, 1)], GEOMETRY), "id").collect()
    unit = footprints(spark.createDataFrame([("u", [[box(74.99, 24.99, 75.01, 25.01)]], 0.0, 1)], GEOMETRY), "id").first()["area_sq_m"]
    assert r["area_sq_m"] == pytest.approx(unit * math.pi / 4, rel=1e-4)


def test_no_side_that_grows_with_the_edges_is_broadcast(spark, monkeypatch):
    """Files of pieces pack a hundredfold, so a planner that trusts their size would send all of them to the driver."""
    from terradrift.operators import footprint

    plans, save = [], footprint.save_table

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(footprint, "save_table", lambda df, *a: (plans.append(plan_of(df)), save(df, *a))[1])
    rows = spark.range(50).select(F.col("id"), F.array(F.array(F.array(
        *[F.array(F.lit(x) + F.col("id"), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0))]))).alias("geometry"))
    plans.append(plan_of(footprints(rows, "id")))
    assert len(plans) == 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_short_outlines_equal_the_sweep_and_shuffle_keys_only(spark, features, monkeypatch):
    """Outlines of a few points in one row are measured where they lie; those of several rows or with odd values still meet in the sweep."""
    from terradrift.operators import footprint

    g = {k: [[[[*p] for p in r] for r in q] for q in v] for k, v in shapes().items()}
    rows = [("gone", [g["star"][0], None], 1.0, 2), ("ring", [[g["open"][0][0], None]], 1.0, 2), ("z", [[[[*p, 9.0] for p in g["open"][0][0]]]], 1.0, 2)]
    rows += [("bow", g["bow"], 1.0, 2), ("pair", g["open"], 1.0, 2), ("pair", g["apart"], 1.0, 2), (None, g["hole"], 1.0, 2), (None, g["star"], 1.0, 2)]
    mixed = features.unionByName(spark.createDataFrame(rows, GEOMETRY))
    every = [r.asDict() for r in footprints(mixed, "id").collect()]
    swept, sweep = [], footprint._swept_totals
    monkeypatch.setattr(footprint, "_swept_totals", lambda f, *a: (swept.extend(r["key"] for r in f.select("key").collect()), sweep(f, *a))[1])
    footprints(mixed, "id").collect()
    assert {str(k) for k in swept} == {"None", "bow", "gone", "long", "null", "pair", "ring"}
    monkeypatch.setattr(footprint, "SHORT", 0)
    whole = {r["id"]: r.asDict() for r in footprints(mixed, "id").collect()}
    assert len(every) == len(whole) == mixed.select("id").distinct().count()
    for r in every:
        for k, v in r.items():
            w = whole[r["id"]][k]
            assert w == v if v is None or isinstance(v, str) else w == pytest.approx(v, rel=1e-9, abs=1e-6), (r["id"], k)
