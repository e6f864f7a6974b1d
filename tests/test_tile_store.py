"""Scans of stored tiles: results, pushed predicates, and files that must not be opened."""

import glob

import numpy as np
import pytest
from helpers import pixel_frame, scene_frame
from test_pipeline import epochs, request

from terradrift.operators import guards
from terradrift.plans import pipeline
from terradrift.session import save_table
from terradrift.sources.tile_store import cut_windows, scan_window, store_pixels, window_tiles
from terradrift.sources.tiles import AreaOfInterest

SHAPE = (96, 128)


@pytest.fixture(scope="module")
def raster(spark):
    n = SHAPE[0] * SHAPE[1]
    parts = [pixel_frame(spark, {"b1": np.arange(n).reshape(SHAPE) + k, "b2": np.ones(SHAPE, int)}, str(k)) for k in (7, 8, 9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("NOT (scene_id = '8' AND row = 40 AND col = 50)")


@pytest.fixture(scope="module")
def windows(spark):
    rows = [("a", "8", 33, 47, 40, 63), ("b", "8", 35, 36, 50, 51), ("c", "8", 0, 10, 0, 10), ("d", "9", 90, 96, 120, 128), ("empty", "8", 5, 5, 0, 9), ("far", "none", 0, 9, 0, 9)]
    return save_table(spark.createDataFrame(rows, "request_id string, scene_id string, row0 int, row1 int, col0 int, col1 int"), "windows")


def test_windows_of_a_store_equal_those_of_the_pixels(spark, raster, windows):
    want = {("a", r - 33, c - 40): r * 128 + c + 8 for r in range(33, 47) for c in range(40, 63) if (r, c) != (40, 50)}
    want |= {("b", 0, 0): 35 * 128 + 50 + 8} | {("c", r, c): r * 128 + c + 8 for r in range(10) for c in range(10)}
    want |= {("d", r, c): (r + 90) * 128 + c + 120 + 9 for r in range(6) for c in range(8)}
    stored = store_pixels(raster, ["b1", "b2"], tile=16)
    for px in (raster, stored):
        got = cut_windows(px, windows, ["b1"], 16).collect()
        assert {(r["scene_id"], r["row"], r["col"]): r["b1"] for r in got} == want and len(got) == len(want)
    assert cut_windows(stored, windows.limit(0), ["b1"]).count() == 0


def test_tile_lists(spark):
    w = spark.createDataFrame([("w", 15, 33, 16, 17), ("none", 3, 3, 0, 5)], "k string, row0 int, row1 int, col0 int, col1 int")
    assert sorted((r["tile_r"], r["tile_c"]) for r in window_tiles(w, 16).collect()) == [(0, 1), (1, 1), (2, 1)]


def test_plan_prunes_partitions_and_pushes_ranges(spark, raster, windows):
    stored = store_pixels(raster, ["b1", "b2"], tile=16)
    plan = cut_windows(stored, windows, ["b1"])._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "tile_c" in line and "rows" in line)
    assert "dynamicpru" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "tile_r" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(tile_c" in scan.split("PushedFilters")[1] and "b2" not in scan.split("ReadSchema")[1]


def test_other_files_are_not_opened(spark, raster, windows, tmp_path):
    path = str(tmp_path / "tiles")
    stored = store_pixels(raster, ["b1", "b2"], path, 16)
    before = cut_windows(stored, windows, ["b1"]).count()
    # Scenes and tile rows are pruned each by itself.
    kept = [f"scene_id={s}/tile_r={r}/" for s in (8, 9) for r in (0, 2, 5)]
    spoiled = [f for f in glob.glob(f"{path}/scene_id=*/tile_r=*/*.parquet") if not any(x in f for x in kept)]
    assert len(spoiled) == 12
    for f in spoiled:
        with open(f, "r+b") as out:
            out.write(b"no tiles here " * 4)
            out.truncate(56)
    assert cut_windows(stored, windows, ["b1"]).count() == before
    aoi = AreaOfInterest(24.9959, 24.9966, 75.0, 75.002)
    assert scan_window(stored, scene_frame(spark, *SHAPE, scene_id="8"), aoi, ["b1"]).count() == 7 * 20


def test_analysis_and_screening_from_stores_equal_those_from_pixels(spark):
    t1, t2 = epochs(spark)
    scene, requests = scene_frame(spark, 100, 100), request(spark)
    hits = spark.createDataFrame([(24.996, 75.005)], "lat double, lon double")
    out = []
    for a, b in ((t1, t2), tuple(store_pixels(t, ["b1", "b2", "b3"], tile=16) for t in (t1, t2))):
        run = pipeline.analyze(requests, a, b, scene, guards.catalogue(spark))
        found = pipeline.screened_features(hits, a, b, scene, 25.0, padding_m=400.0, screen_tile=24)
        out.append((run.summary.collect(), sorted(map(str, run.detections.collect())), sorted(map(str, found.collect()))))
    assert out[0] == out[1] and len(out[0][2]) == 1 and len(out[0][1]) >= 1
