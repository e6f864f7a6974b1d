import numpy as np
import pytest
from helpers import erode_dilate, flood_labels, grid_of, pixel_frame, scene_frame
from pyspark.sql import functions as F

from terradrift.functions import pixel
from terradrift.functions.geo import multipolygon_area_m2
from terradrift.operators import align, components, mosaic, polygons, raster
from terradrift.plans import features
from terradrift.session import save_table
from terradrift.sources import tile_store, tiles


def test_percentile_stretch_range_and_nodata(spark):
    rng = np.random.default_rng(0)
    bands = {f"b{i}": rng.integers(1000, 5000, (100, 100)) for i in range(1, 5)}
    for b in bands.values():
        b[0, 0], b[99, 99] = 0, 65535
    px = pixel_frame(spark, bands)
    out = raster.percentile_normalise(px, list(bands)).collect()
    for name, raw in bands.items():
        got = grid_of(out, name, (100, 100))
        valid = (raw != 0) & (raw != 65535)
        lo, hi = np.percentile(raw[valid], [2, 98])
        want = np.where(valid, np.clip((raw - lo) / (hi - lo + 1e-6), 0, 1), 0)
        assert np.allclose(got, want, atol=1e-9)


def test_constant_band_is_half_and_empty_band_is_zero(spark):
    px = pixel_frame(spark, {"b1": np.full((20, 20), 2000), "b2": np.zeros((20, 20), int)})
    row = raster.percentile_normalise(px, ["b1", "b2"]).agg(
        F.min("b1"), F.max("b1"), F.max("b2")).first()
    assert tuple(row) == (0.5, 0.5, 0.0)


@pytest.mark.parametrize("low,high", [(-1, 98), (50, 50), (98, 2), (2, 101)])
def test_bad_percentiles_raise(spark, low, high):
    px = pixel_frame(spark, {"b1": np.ones((2, 2))})
    with pytest.raises(ValueError):
        raster.band_percentiles(px, ["b1"], low, high)


@pytest.mark.parametrize("rgb,want", [((1, 0, 0), 0.299), ((0, 1, 0), 0.587), ((0, 0, 1), 0.114), ((1, 1, 1), 1.0)])
def test_luminance_weights(spark, rgb, want):
    lum = pixel.luminance(*[F.lit(float(v)) for v in rgb])
    assert spark.range(1).select(lum).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("tile", [7, 16, 256])
def test_opening_matches_direct_scan_for_any_tile(spark, tile):
    mask = (np.random.default_rng(3).random((40, 45)) < 0.8).astype(int)
    out = raster.opening(pixel_frame(spark, {"flag": mask}), "flag", 3, tile).collect()
    assert np.array_equal(grid_of(out, "flag", mask.shape), erode_dilate(mask))


def test_opening_drops_salt_and_keeps_block(spark):
    prob = np.zeros((64, 64))
    prob[5, 5], prob[12, 40], prob[50, 20] = 0.95, 0.88, 0.92
    prob[20:28, 20:28] = 0.85
    kept = {(r.row, r.col) for r in features.change_mask(pixel_frame(spark, {"prob": prob}), 0.7).collect()}
    assert kept == {(r, c) for r in range(20, 28) for c in range(20, 28)}


@pytest.mark.parametrize("ksize", [3, 5, 7, 9])
def test_blur_mirrors_about_the_edge(spark, ksize):
    img = np.random.default_rng(5).random((23, 31))
    k = ksize // 2
    w = np.array(raster.blur_weights(ksize))
    pad = np.pad(img, k, mode="reflect")
    mid = sum(w[i] * pad[:, i : i + img.shape[1]] for i in range(ksize))
    want = sum(w[i] * mid[i : i + img.shape[0]] for i in range(ksize))
    px = pixel_frame(spark, {"v": img})
    out = raster.gaussian_blur(px, "v", raster.scene_dims(px), ksize, tile=8).collect()
    assert np.allclose(grid_of(out, "v", img.shape), want)


def test_even_blur_size_is_skipped(spark):
    px = pixel_frame(spark, {"v": np.ones((3, 3))})
    assert raster.gaussian_blur(px, "v", raster.scene_dims(px), 4) is px


def test_otsu_matches_exhaustive_search(spark):
    rng = np.random.default_rng(8)
    v = np.clip(np.concatenate([rng.normal(0.2, 0.05, 3000), rng.normal(0.75, 0.08, 1000)]), 0, 1).reshape(40, 100)
    bins = np.floor(np.clip(v * 255, 0, 255)).astype(int).ravel()
    best = max(range(256), key=lambda t: (
        (lambda a, b: round(len(a) * len(b) / bins.size**2 * (a.mean() - b.mean()) ** 2, 9) if len(a) and len(b) else 0)(
            bins[bins <= t], bins[bins > t]), -t))
    px = pixel_frame(spark, {"norm": v})
    t = save_table(raster.otsu_threshold(px, "norm"), "otsu")
    assert t.first()["otsu_bin"] == best
    scored = grid_of(raster.otsu_score(px, "norm", t).collect(), "prob", v.shape)
    above = bins.reshape(v.shape) > best
    assert np.allclose(scored, np.where(above, np.maximum(v, best / 255), np.minimum(v, best / 255 * 0.5)))


@pytest.mark.parametrize("rows,verdict,ratio", [(40, "REJECTED_CLOUD_COVER", 0.4), (15, "OK", 0.15), (0, "OK", 0.0)])
def test_cloud_guard(spark, rows, verdict, ratio):
    mask = np.zeros((100, 100), int)
    mask[:rows] = 1
    out = raster.cloud_ratio(pixel_frame(spark, {"mask": mask}), scene_frame(spark, 100, 100)).first()
    assert (out["status"], out["ratio"]) == (verdict, pytest.approx(ratio))


def test_cloud_guard_without_pixels_is_clear(spark):
    empty = pixel_frame(spark, {"mask": np.ones((1, 1), int)}).limit(0)
    out = raster.cloud_ratio(empty, scene_frame(spark, 1, 1)).first()
    assert (out["ratio"], out["status"]) == (0.0, "OK")


@pytest.mark.parametrize("tile", [16, 256])
def test_components_match_flood_fill(spark, tile):
    mask = np.random.default_rng(1).random((60, 70)) < 0.42
    set_px = pixel_frame(spark, {"flag": mask.astype(int)}).filter("flag = 1")
    out = components.label_components(set_px, tile).collect()
    want = flood_labels(mask)
    assert len(out) == mask.sum()
    assert all(want[r.row, r.col] == r.label for r in out)


def test_snake_across_tiles_is_one_component(spark):
    mask = np.zeros((33, 33), int)
    mask[::4] = 1
    for i, r in enumerate(range(0, 32, 4)):
        mask[r : r + 4, 32 if i % 2 == 0 else 0] = 1
    set_px = pixel_frame(spark, {"flag": mask}).filter("flag = 1")
    assert components.label_components(set_px, 8).select("label").distinct().count() == 1


@pytest.mark.parametrize("small_limit", [0, 10**6])
def test_outline_area_equals_pixel_count_with_holes_and_corners(spark, small_limit):
    mask = np.zeros((20, 20), int)
    mask[2:10, 2:10] = 1
    mask[4:6, 4:6] = 0  # hole
    mask[7, 7] = 0  # second hole
    mask[10:13, 10:13] = 1  # touches at a corner
    mask[15, 1] = 1
    labelled = save_table(components.label_components(pixel_frame(spark, {"flag": mask}).filter("flag = 1")), "lab")
    vertices = save_table(polygons.ring_vertices(labelled, small_limit), "rings")
    rings = polygons.rings(vertices).collect()
    by_label = {}
    for r in rings:
        by_label.setdefault(r.label, []).append((r.area_px, r.n_points))
    sizes = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    assert {k: sum(a for a, _ in v) for k, v in by_label.items()} == sizes
    big = max(by_label.values(), key=len)
    assert sorted(a for a, _ in big) == [-4.0, -1.0, 9.0, 64.0]
    assert all(n == 4 for _, n in big)
    shapes = polygons.multipolygons(vertices, labelled, scene_frame(spark, 20, 20), tile=8).collect()
    assert sorted(sorted(len(p) for p in s.geometry) for s in shapes) == [[1], [1, 3]]
    assert all(ring[0] == ring[-1] for s in shapes for p in s.geometry for ring in p)


def test_multipolygon_area_equals_cell_area_on_a_random_mask(spark):
    mask = np.random.default_rng(14).random((40, 40)) < 0.55
    scene = scene_frame(spark, 40, 40)
    set_px = pixel_frame(spark, {"flag": mask.astype(int), "prob": mask * 0.9}).filter("flag = 1")
    labelled = save_table(components.label_components(set_px, 16), "lab")
    shapes = polygons.multipolygons(polygons.ring_vertices(labelled), labelled, scene, tile=16)
    both = features.measure_components(labelled, scene).join(shapes, ["scene_id", "label"])
    worst = both.agg(F.max(F.abs(multipolygon_area_m2("geometry") / F.col("area") - 1)), F.count("*")).first()
    assert worst[0] < 1e-4 and worst[1] == labelled.select("label").distinct().count()


def test_outline_paths_agree_on_a_random_mask(spark):
    mask = np.random.default_rng(11).random((30, 30)) < 0.5
    labelled = save_table(components.label_components(pixel_frame(spark, {"flag": mask.astype(int)}).filter("flag = 1")), "lab")
    a = {tuple(r) for r in polygons.ring_vertices(labelled).collect()}
    b = {tuple(r) for r in polygons.ring_vertices(labelled, small_limit=0).collect()}
    assert a == b


def test_row_runs_cover_the_mask(spark):
    mask = np.random.default_rng(12).random((15, 40)) < 0.6
    labelled = components.label_components(pixel_frame(spark, {"flag": mask.astype(int)}).filter("flag = 1"))
    seen = np.zeros_like(mask)
    for r in polygons.row_runs(labelled).collect():
        assert not seen[r.row, r.col_start : r.col_end + 1].any()
        seen[r.row, r.col_start : r.col_end + 1] = True
    assert np.array_equal(seen, mask)


def test_ten_block_area(spark):
    prob = np.zeros((64, 64))
    prob[20:30, 20:30] = 0.90
    scene = scene_frame(spark, 64, 64, a=10 / 100865, e=-10 / 110787)
    (f,) = features.extract_features(pixel_frame(spark, {"prob": prob}), scene, 0.7, geometry=True).collect()
    assert f.area_sq_m == pytest.approx(10000, rel=0.005)
    assert f.confidence >= 0.89 and f.grid_ref.startswith("43R")
    assert len(f.geometry) == 1 and len(f.geometry[0][0]) == 5


def test_clutter_is_dropped_and_empty_mask_gives_nothing(spark):
    prob = np.zeros((40, 40))
    prob[2:6, 2:6], prob[12:14, 12:14], prob[30, 30] = 0.9, 0.9, 0.9
    scene = scene_frame(spark, 40, 40, a=5 / 100865, e=-5 / 110787)
    found = features.extract_features(pixel_frame(spark, {"prob": prob}), scene, 0.7).collect()
    assert len(found) == 1 and found[0].area_sq_m >= 50
    none = features.extract_features(pixel_frame(spark, {"prob": np.zeros((40, 40))}), scene, 0.7)
    assert none.count() == 0


def test_many_blocks_are_many_features(spark):
    prob = np.zeros((200, 1000))
    for i in range(100):
        r, c = (i // 25) * 40 + 10, (i % 25) * 40 + 10
        prob[r : r + 6, c : c + 6] = 0.9
    found = features.extract_features(pixel_frame(spark, {"prob": prob}), scene_frame(spark, 200, 1000), 0.7, tile=64)
    assert found.count() == 100


def test_bitemporal_pair_is_detected(spark):
    t1 = np.full((128, 128), 50.0)
    t2 = t1.copy()
    t2[20:60, 20:100], t2[80:110, 80:110], t2[70:75, 10:60] = 180, 210, 90
    bands = ("b1", "b2", "b3")
    a, b = (pixel_frame(spark, {k: t for k in bands}) for t in (t1, t2))
    found = features.difference_features(a, b, scene_frame(spark, 128, 128), bands, 0.60).collect()
    assert len(found) == 2 and all(f.area_sq_m > 50 for f in found)


def test_identical_epochs_give_no_change(spark):
    px = pixel_frame(spark, {b: np.full((30, 30), 9.0) for b in ("b1", "b2", "b3")})
    assert features.difference_features(px, px, scene_frame(spark, 30, 30)).count() == 0


def test_two_blobs_become_nodes(spark):
    mask = np.zeros((100, 100), int)
    mask[10:30, 10:30] = 1
    mask[60:70, 50:90] = 1
    labelled = components.label_components(pixel_frame(spark, {"flag": mask}).filter("flag = 1"))
    nodes = features.nodes_from_mask(labelled, scene_frame(spark, 100, 100), "2025-01-15").collect()
    assert sorted(n.area_m2 for n in nodes) == [40000.0, 40000.0]
    assert sorted(n.aspect_ratio for n in nodes) == [1.0, 4.0]


@pytest.mark.parametrize("dy,dx", [(0, 0), (1, -2), (-2, 1)])
def test_alignment_finds_the_shift(spark, dy, dx):
    rng = np.random.default_rng(2)
    wide = rng.random((70, 70))
    wide = sum(np.roll(wide, (i, j), (0, 1)) for i in range(3) for j in range(3)) / 9
    l1, l2 = wide[5:55, 5:55], wide[5 - dy : 55 - dy, 5 - dx : 55 - dx]
    planes = pixel_frame(spark, {"l1": l1, "l2": l2})
    best = align.best_shift(align.shift_scores(planes, 2, tile=16)).first()
    assert (best.dy, best.dx, best.status) == (dy, dx, "OK") and best.score > 0.99
    px = pixel_frame(spark, {"b1": l2})
    exact = save_table(align.best_shift(align.shift_scores(planes, 2)), "shift")
    back = align.warp(px, raster.scene_dims(px), align.shift_warp(exact, fine=False), ["b1"]).collect()
    got = grid_of(back, "b1", l1.shape)
    assert np.allclose(got[3:-3, 3:-3], l1[3:-3, 3:-3])


def test_flat_and_noise_pairs_are_rejected(spark):
    rng = np.random.default_rng(4)
    flat = pixel_frame(spark, {"l1": np.full((20, 20), 0.5), "l2": np.full((20, 20), 0.5)})
    noise = pixel_frame(spark, {"l1": rng.random((30, 30)), "l2": rng.random((30, 30))})
    for planes in (flat, noise):
        assert align.best_shift(align.shift_scores(planes, 1)).first().status == "REJECTED_ALIGNMENT"


def test_tiles_and_blend_stay_in_range(spark):
    px = pixel_frame(spark, {"v": np.random.default_rng(6).random((64, 96))})
    dims = raster.scene_dims(px)
    bounds = mosaic.tile_bounds(dims).collect()
    assert len(bounds) == 4 and {(b.r1, b.r2) for b in bounds} == {(0, 35), (29, 64)}
    w = mosaic.assign_tiles(px, dims).agg(F.min(mosaic.blend_weight()), F.max(mosaic.blend_weight())).first()
    assert 0 <= w[0] and w[1] <= 1
    out = mosaic.tiled_scores(px, dims, lambda pdf: pdf["v"], max_tile=40)
    assert out.count() == 64 * 96
    worst = out.join(px, ["scene_id", "row", "col"]).agg(F.max(F.abs(F.col("prob") - F.col("v")))).first()[0]
    assert worst < 1e-9


def test_window_scan_and_pushdown(spark, tmp_path):
    px = pixel_frame(spark, {"b1": np.arange(512 * 64).reshape(512, 64), "b2": np.zeros((512, 64), int)})
    scene = scene_frame(spark, 512, 64, lon=74.56, lat=34.166)
    aoi = tiles.AreaOfInterest(34.13, 34.15, 74.561, 74.563)
    out = tile_store.scan_window(px, scene, aoi, ["b1", "b7"]).collect()
    assert len(out) == 200 * 20 and max(r.row for r in out) == 199 and max(r.col for r in out) == 19
    far = tiles.window_bounds(scene.withColumns(tiles.AreaOfInterest(10, 10.1, 10, 10.1).columns())).first()
    near = tiles.window_bounds(scene.withColumns(aoi.columns())).first()
    assert far.status == "NO_COVERAGE" and near.status == "OK" and 5 <= near.gsd_m <= 20
    with pytest.raises(ValueError):
        tile_store.scan_window(px, scene, aoi, ["b8"])
    path = str(tmp_path / "tiles")
    tiles.write_tiles(tiles.pack_tiles(px, ["b1", "b2"], 32), path)
    part = tiles.read_tiles(spark, path, ["b1"], rows=(100, 140), cols=(0, 40), tile=32)
    assert part.count() == 40 * 40
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "tile_r" in plan and "b2" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("box", [(91, 92, 0, 1), (0, 1, -181, 0), (1, 1, 0, 1), (2, 1, 0, 1), (0, 1, 5, 5)])
def test_bad_areas_raise(box):
    with pytest.raises(ValueError):
        tiles.AreaOfInterest(*box)


def test_window_digest_ignores_partitioning(spark):
    px = pixel_frame(spark, {"b1": np.arange(900).reshape(30, 30)})
    a = tiles.window_digest(px, ["b1"], 8).first().sha256
    assert a == tiles.window_digest(px.repartition(13), ["b1"], 8).first().sha256
    changed = px.withColumn("b1", F.when(F.col("b1") == 7, 8).otherwise(F.col("b1")))
    assert a != tiles.window_digest(changed, ["b1"], 8).first().sha256


def test_opening_shuffles_once(spark):
    px = save_table(pixel_frame(spark, {"flag": np.ones((20, 20), int)}), "px")
    plan = raster.opening(px, "flag")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_w_shaped_mask_crosses_seams_once(spark):
    """Pieces that meet only through a third one, with two neighbours each: every pixel once, one label."""
    mask = np.zeros((8, 20), int)
    for c in range(20):
        mask[abs(c % 8 - 4), c] = 1
    set_px = pixel_frame(spark, {"flag": mask}).filter("flag = 1")
    out = components.label_components(set_px, 4).collect()
    assert len(out) == mask.sum() and len({r.label for r in out}) == 1


def test_linked_ids_with_two_parents(spark):
    from terradrift.operators.linking import connected_components

    links = spark.createDataFrame([("s", 4, 3), ("s", 4, 1), ("s", 5, 3), ("s", 5, 2), ("t", 5, 4)], "scene_id string, u long, v long")
    got = {(r["scene_id"], r["id"]): r["root"] for r in connected_components(links, "u", "v", by=["scene_id"]).collect()}
    assert got == {("s", i): 1 for i in (1, 2, 3, 4, 5)} | {("t", 4): 4, ("t", 5): 4}


@pytest.mark.parametrize("few", [0, 100, 100_000])
def test_a_round_of_linking_writes_one_table(spark, monkeypatch, few):
    from terradrift.operators import linking

    monkeypatch.setattr(linking, "FEW", few)
    written, rounds, save, star = [], [], linking.save_table, linking._small_star
    monkeypatch.setattr(linking, "save_table", lambda df, name: written.append(name) or save(df, name))
    monkeypatch.setattr(linking, "_small_star", lambda *args: rounds.append(1) or star(*args))
    # A path in scattered order, a hub and a ring; repeats, loops and both directions among the edges.
    path = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]
    hub, ring = [(500, 501 + i) for i in range(30)], [(600 + i, 600 + (i + 1) % 9) for i in range(9)]
    edges = path + [(b, a) for a, b in path[:50]] + hub + hub + ring + [(700, 700)]
    got = {r["id"]: r["root"] for r in linking.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 531)} | {i: 600 for i in range(600, 609)}
    assert len(written) == 1 + len(rounds)  # the edges, then a table a round


def test_opening_goes_by_position_across_gaps(spark):
    cols = [0, 1, 2, 20, 40, 41, 42]
    grid = np.ones((9, 43), int)
    full = pixel_frame(spark, {"flag": grid})
    # A lone column whose neighbours are present and unset must vanish; gaps next to it must not lend it the pixels beyond.
    unset = full.filter((F.col("col") >= 19) & (F.col("col") <= 21)).withColumn("flag", F.when(F.col("col") == 20, 1).otherwise(0))
    rest = full.filter(F.col("col").isin(*[c for c in cols if c != 20]))
    out = raster.opening(rest.unionByName(unset), "flag", 3).filter("flag = 1")
    assert {r["col"] for r in out.select("col").distinct().collect()} == {0, 1, 2, 40, 41, 42}


@pytest.mark.parametrize("shape", [(1, 6), (2, 6), (6, 1), (3, 2), (7, 8)])
def test_blur_mirrors_thin_rasters(spark, shape):
    values = np.random.default_rng(4).random(shape)
    px = pixel_frame(spark, {"v": values})
    out = grid_of(raster.gaussian_blur(px, "v", scene_frame(spark, *shape)).collect(), "v", shape, np.nan)
    w = np.array(raster.blur_weights(5))

    def line(x):
        n = len(x)
        at = np.zeros((n, 5), int) if n == 1 else np.array([[min(p := (i + d) % (2 * (n - 1)), 2 * (n - 1) - p) for d in range(-2, 3)] for i in range(n)])
        return (x[at] * w).sum(1)

    want = np.apply_along_axis(line, 0, np.apply_along_axis(line, 1, values))
    assert np.allclose(out, want)
