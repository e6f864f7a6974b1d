"""Tile-array differencing against the pixel-table operators, over tile sizes, gaps and seams."""

import numpy as np
import pytest
from helpers import erode_dilate, pixel_frame, scene_frame
from pyspark.sql import functions as F

from terradrift.operators import components, raster, tile_arrays
from terradrift.plans import features
from terradrift.session import save_table

BANDS = ("b1", "b2")


def epochs(spark, shape=(50, 70), seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    a = {b: rng.integers(0, 90, shape).astype(float) for b in BANDS}
    b = {k: v + rng.integers(0, 6, shape) for k, v in a.items()}
    for r0, r1, c0, c1 in ((3, 12, 2, 30), (10, 40, 28, 34), (30, 36, 5, 60), (44, 49, 62, 69), (20, 24, 64, 70)):
        for k in BANDS:
            b[k][r0:r1, c0:c1] += 150
    t1, t2 = pixel_frame(spark, a), pixel_frame(spark, b)
    if gaps:
        t1 = t1.filter("NOT (row % 9 = 4 AND col % 7 = 3)").withColumn("b2", F.when(F.expr("(row * 31 + col) % 23 = 0"), None).otherwise(F.col("b2")))
        t2 = t2.filter("NOT (row BETWEEN 15 AND 17 AND col BETWEEN 20 AND 24)")
    return t1, t2


def by_pixels(t1, t2, scene, tau):
    score, _ = features.spectral_score(t1, t2, BANDS, dims=scene)
    return components.label_components(features.change_mask(score, tau))


@pytest.mark.parametrize("tile", [8, 16, 256])
@pytest.mark.parametrize("gaps", [False, True])
def test_labels_equal_the_pixel_path(spark, tile, gaps):
    t1, t2 = epochs(spark, gaps=gaps)
    scene = scene_frame(spark, 50, 70)
    want = {(r["row"], r["col"]): (r["label"], round(r["prob"], 9)) for r in by_pixels(t1, t2, scene, 0.5).collect()}
    got = tile_arrays.change_pixels(t1, t2, scene, BANDS, 0.5, tile=tile).collect()
    assert want and {(r["row"], r["col"]): (r["label"], round(r["prob"], 9)) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("shape", [(1, 40), (2, 3), (40, 1)])
def test_thin_rasters_are_mirrored(spark, shape):
    rng = np.random.default_rng(3)
    a = {b: rng.integers(0, 50, shape).astype(float) for b in BANDS}
    b = {k: v + rng.integers(0, 200, shape) for k, v in a.items()}
    t1, t2, scene = pixel_frame(spark, a), pixel_frame(spark, b), scene_frame(spark, *shape)
    diff = raster.band_difference(raster.bitemporal(t1, t2, BANDS), BANDS)
    want = {(r["row"], r["col"]): round(r["diff"], 9) for r in raster.gaussian_blur(diff, "diff", scene, 7).collect()}
    got = {}
    for t in tile_arrays.difference_tiles(t1, t2, scene, BANDS, 7, halo=0, tile=16).collect():
        v = np.array(t["values"]).reshape(t["side"], t["side"])
        got |= {(t["top"] + i, t["left"] + j): round(v[i, j], 9) for i, j in zip(*np.nonzero(~np.isnan(v)))}
    assert got == want


def test_records_equal_the_pixel_path_with_and_without_rings(spark):
    t1, t2 = epochs(spark)
    scene = scene_frame(spark, 50, 70)
    columns = ["label", "feature_id", "confidence", "area_sq_m", "area_hectares", "centroid", "grid_ref", "n_pixels"]
    score, _ = features.spectral_score(t1, t2, BANDS, dims=scene)
    want = sorted(map(tuple, features.extract_features(score, scene, 0.5).select(*columns).collect()))
    for geometry in (False, True):
        got = features.difference_features(t1, t2, scene, BANDS, 0.5, "a longer text than thirty characters", tile=16, geometry=geometry)
        assert sorted(map(tuple, got.select(*columns).collect())) == want and len(want) >= 2
        assert got.first()["class"] == "Detected Surface Anomaly (a longer text than thirty characters)"


def test_scenes_do_not_touch_and_missing_epochs_say_nothing(spark):
    t1, t2 = epochs(spark, gaps=False)
    other = [t.withColumn("scene_id", F.lit("b")) for t in (t1, t2)]
    scene = scene_frame(spark, 50, 70).unionByName(scene_frame(spark, 50, 70, scene_id="b"))
    both = tile_arrays.change_components(t1.unionByName(other[0]), t2.unionByName(other[1]), scene, BANDS, 0.5, tile=16)
    alone = tile_arrays.change_components(t1, t2, scene, BANDS, 0.5, tile=32)
    rows = {(r["scene_id"], r["label"]): (r["n_pixels"], round(r["area"], 6), round(r["mr"], 9)) for r in both.collect()}
    assert {k[1]: v for k, v in rows.items() if k[0] == "a"} == {r["label"]: (r["n_pixels"], round(r["area"], 6), round(r["mr"], 9)) for r in alone.collect()}
    assert {k[1]: v for k, v in rows.items() if k[0] == "b"} == {k[1]: v for k, v in rows.items() if k[0] == "a"}
    assert tile_arrays.change_pixels(t1, t2.limit(0), scene, BANDS).count() == 0


def test_a_component_over_many_seams_is_one(spark):
    shape = (60, 60)
    a = {b: np.zeros(shape) for b in BANDS}
    b = {k: np.zeros(shape) for k in BANDS}
    for k in BANDS:
        for i in range(0, 60, 8):
            b[k][i : i + 4, :] = 100.0
        b[k][:, 28:32] = 100.0
    got = tile_arrays.change_components(pixel_frame(spark, a), pixel_frame(spark, b), scene_frame(spark, *shape), BANDS, 0.5, ksize=1, tile=8)
    assert got.count() == 1


def test_opening_of_arrays_equals_direct_neighbourhoods():
    rng = np.random.default_rng(5)
    for kernel in (3, 5):
        flags = (rng.random((30, 40)) < 0.8).astype(np.int8)
        assert (tile_arrays.opened(flags, np.ones(flags.shape, bool), kernel) == erode_dilate(flags, kernel)).all()


def test_pixels_are_shuffled_once(spark):
    t1, t2 = epochs(spark, gaps=False)
    plan = tile_arrays.difference_tiles(t1, t2, save_table(scene_frame(spark, 50, 70), "dims"), BANDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
