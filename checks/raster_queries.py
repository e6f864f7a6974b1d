"""Raster queries: scans, statistics, neighbourhoods, components, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import raster_sql as R
from checks.registry import check, with_ctes
from checks.views import PX_SQL, SCENE_SQL, hav_sql, pixels, scenes, with_scene
from terradrift.functions import geo, pixel
from terradrift.operators import components, graph, polygons, raster, tile_arrays
from terradrift.plans import features
from terradrift.sources import tile_store, tiles
from terradrift.session import save_table

B3 = ("b1", "b2", "b3")
B4 = ("b1", "b2", "b3", "b4")
AOI = tiles.AreaOfInterest(24.9943, 24.9991, 75.0012, 75.0087)
PX = "scene_id, row, col"


def _pairs(spark, d, bands=B3):
    return raster.bitemporal(pixels(spark, d, 1), pixels(spark, d, 2), bands)


def _score(spark, d):
    return features.spectral_score(pixels(spark, d, 1), pixels(spark, d, 2), B3)


def _labelled(spark, d, tile=16):
    return components.label_components(features.change_mask(_score(spark, d)[0], tile=tile), tile)


# --- scans ------------------------------------------------------------------------------------

_BOUNDS = (
    "cw AS (SELECT *, CAST(round_even((75.0012::DOUBLE - lon0) / px, 0) AS INT) AS c0, "
    "CAST(round_even((75.0087::DOUBLE - 75.0012::DOUBLE) / px, 0) AS INT) AS w, "
    "CAST(round_even((lat0 - 24.9991::DOUBLE) / px, 0) AS INT) AS r0, "
    "CAST(round_even((24.9991::DOUBLE - 24.9943::DOUBLE) / px, 0) AS INT) AS h FROM scene), "
    "win AS (SELECT *, greatest(r0, 0) AS row0, greatest(c0, 0) AS col0, "
    "least(r0 + h, n_rows) AS row1, least(c0 + w, n_cols) AS col1 FROM cw)"
)


@check("s1_window_scan", with_ctes(PX_SQL, SCENE_SQL, _BOUNDS, select=(
    "SELECT scene_id, CAST(row - row0 AS INT) AS row, CAST(col - col0 AS INT) AS col, b1, b4 FROM px1 "
    "JOIN win USING (scene_id) WHERE row >= row0 AND row < row1 AND col >= col0 AND col < col1")))
def _(spark, d):
    stored = tile_store.store_pixels(pixels(spark, d, 1), B4, tile=16)
    return tile_store.scan_window(stored, scenes(spark, d), AOI, ["b1", "b4", "b9"])


@check("s3_window_affine_gsd", with_ctes(PX_SQL, SCENE_SQL, _BOUNDS, select=(
    "SELECT scene_id, CASE WHEN row1 > row0 AND col1 > col0 THEN 'OK' ELSE 'NO_COVERAGE' END AS status, "
    "row0, col0, row1, col1, round(lon0 + col0 * px, 6) AS origin_lon, round(lat0 - row0 * px, 6) AS origin_lat, "
    "round(sqrt(px * px * (111132.954::DOUBLE - 559.822::DOUBLE * cos(2 * radians(24.9967::DOUBLE)) "
    "+ 1.175::DOUBLE * cos(4 * radians(24.9967::DOUBLE))) "
    "* (111412.84::DOUBLE * cos(radians(24.9967::DOUBLE)) - 93.5::DOUBLE * cos(3 * radians(24.9967::DOUBLE)))), 4) AS gsd_m "
    "FROM win")))
def _(spark, d):
    b = tiles.window_bounds(scenes(spark, d).withColumns(AOI.columns()))
    return b.select(
        "scene_id", "status", "row0", "col0", "row1", "col1",
        F.round("window_affine.c", 6).alias("origin_lon"), F.round("window_affine.f", 6).alias("origin_lat"),
        F.round("gsd_m", 4).alias("gsd_m"),
    )


_TILE_TEXT = "string_agg(b1 || ',' || b2 || ',' || b3 || ',' || b4, ';' ORDER BY row, col)"


@check("s5_window_digest", with_ctes(PX_SQL, select=(
    f"SELECT scene_id, sha256(string_agg(t, ';' ORDER BY tr)) AS sha256 FROM (SELECT scene_id, tr, "
    f"sha256(string_agg(t, ';' ORDER BY tc)) AS t FROM (SELECT scene_id, row // 32 AS tr, col // 32 AS tc, "
    f"sha256({_TILE_TEXT}) AS t FROM px1 GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")))
def _(spark, d):
    return tiles.window_digest(pixels(spark, d, 1), B4, tile=32)


@check("s1_tile_round_trip", with_ctes(PX_SQL, select=f"SELECT {PX}, b1, b2, b3, b4 FROM px2"))
def _(spark, d):
    return tiles.unpack_tiles(tiles.pack_tiles(pixels(spark, d, 2), B4, tile=32), B4)


# --- pixel expressions ------------------------------------------------------------------------


@check("p3_pixel_to_geo", with_ctes(PX_SQL, SCENE_SQL, select=(
    f"SELECT {PX}, round(lon0 + px * col, 6) AS lon, round(lat0 - px * row, 6) AS lat FROM px1 JOIN scene USING (scene_id)")))
def _(spark, d):
    j = pixels(spark, d, 1).join(scenes(spark, d), "scene_id")
    return j.select(
        "scene_id", "row", "col", F.round(geo.pixel_to_lon("affine", "col", "row"), 6).alias("lon"),
        F.round(geo.pixel_to_lat("affine", "col", "row"), 6).alias("lat"),
    )


@check("p4_geo_to_pixel", with_ctes(PX_SQL, SCENE_SQL, select=(
    "SELECT o_orderkey, scene_id, round((75.0::DOUBLE + (o_orderkey % 997) * 0.00001::DOUBLE - lon0) / px, 4) AS col, "
    "round((25.0::DOUBLE - (o_custkey % n) * 0.004::DOUBLE - (o_orderkey % 911) * 0.00001::DOUBLE - lat0) / -px, 4) AS row FROM orders, "
    "(SELECT count(*) AS n FROM scene) JOIN scene ON scene_id = 'S' || (o_custkey % n)")))
def _(spark, d):
    from checks.views import table

    # Every scene takes part: the key picks one of all scenes, whose rows are counted once.
    pts = with_scene(table(spark, d, "orders"), scenes(spark, d), "o_custkey").selectExpr(
        "o_orderkey", "scene_id",
        "75.0D + (o_orderkey % 997) * 0.00001D AS lon", "25.0D - scene_no * 0.004D - (o_orderkey % 911) * 0.00001D AS lat",
    )
    j = pts.join(scenes(spark, d), "scene_id")
    return j.select(
        "o_orderkey", "scene_id", F.round(geo.geo_to_col("affine", "lon", "lat"), 4).alias("col"),
        F.round(geo.geo_to_row("affine", "lon", "lat"), 4).alias("row"),
    )


@check("p5_luminance", with_ctes(PX_SQL, select=(
    f"SELECT {PX}, round(least(greatest(0.299::DOUBLE * b1 / 65535 + 0.587::DOUBLE * b2 / 65535 "
    f"+ 0.114::DOUBLE * b3 / 65535, 0), 1), 8) AS lum FROM px1")))
def _(spark, d):
    scaled = [F.col(b) / 65535 for b in B3]
    return pixels(spark, d, 1).select("scene_id", "row", "col", F.round(pixel.luminance(*scaled), 8).alias("lum"))


@check("p6_visual_bytes", with_ctes(PX_SQL, select=(
    f"SELECT {PX}, CAST(least(greatest(round_even(b1 / 2000.0::DOUBLE * 255.0::DOUBLE, 0), 0), 255) AS INT) AS v1 FROM px1")))
def _(spark, d):
    return pixels(spark, d, 1).select("scene_id", "row", "col", pixel.to_byte(F.col("b1") / 2000.0).alias("v1"))


@check("f8_quality_bits", with_ctes(PX_SQL, select=(
    f"SELECT {PX}, CAST((b2 >> 10) & 1 AS INT) AS opaque, CAST((b2 >> 11) & 1 AS INT) AS cirrus, "
    f"CAST(greatest((b2 >> 10) & 1, (b2 >> 11) & 1) AS INT) AS cloud FROM px1")))
def _(spark, d):
    return pixels(spark, d, 1).select(
        "scene_id", "row", "col", pixel.quality_bit("b2", 10).alias("opaque"),
        pixel.quality_bit("b2", 11).alias("cirrus"), pixel.opaque_or_cirrus("b2").alias("cloud"),
    )


@check("f9_valid_pixels", with_ctes(PX_SQL, select=(
    "SELECT scene_id, count(CASE WHEN b1 NOT IN (0, 65535) THEN 1 END) AS valid_b1, "
    "count(CASE WHEN b4 NOT IN (0, 65535) THEN 1 END) AS valid_b4, count(*) AS n FROM px1 GROUP BY 1")))
def _(spark, d):
    return pixels(spark, d, 1).groupBy("scene_id").agg(
        F.count(pixel.valid_or_null("b1")).alias("valid_b1"), F.count(pixel.valid_or_null("b4")).alias("valid_b4"),
        F.count("*").alias("n"),
    )


@check("f7_cloud_cover", with_ctes(PX_SQL, SCENE_SQL, select=(
    "SELECT scene_id, round(coalesce(ratio, 0), 6) AS ratio, CASE WHEN coalesce(ratio, 0) > 0.35 "
    "THEN 'REJECTED_CLOUD_COVER' ELSE 'OK' END AS status FROM scene LEFT JOIN "
    "(SELECT scene_id, avg(CASE WHEN (b2 >> 10) & 1 = 1 OR (b2 >> 11) & 1 = 1 THEN 1.0 ELSE 0.0 END) AS ratio "
    "FROM px1 GROUP BY 1) USING (scene_id)")))
def _(spark, d):
    mask = pixels(spark, d, 1).withColumn("mask", pixel.opaque_or_cirrus("b2"))
    return raster.cloud_ratio(mask, scenes(spark, d)).withColumn("ratio", F.round("ratio", 6))


# --- statistics -------------------------------------------------------------------------------

_LONG = "long AS (" + " UNION ALL ".join(f"SELECT scene_id, '{b}' AS band, {b}::DOUBLE AS v FROM px1" for b in B4) + ")"
_PCT = (
    "pct AS (SELECT scene_id, band, quantile_cont(v, 0.02) AS p_low, quantile_cont(v, 0.98) AS p_high FROM long "
    "WHERE v NOT IN (0, 65535) GROUP BY 1, 2)"
)


@check("a1_percentiles", with_ctes(PX_SQL, _LONG, _PCT, select=(
    "SELECT scene_id, band, round(p_low, 6) AS p_low, round(p_high, 6) AS p_high FROM pct")))
def _(spark, d):
    p = raster.band_percentiles(pixels(spark, d, 1), B4)
    return p.select("scene_id", "band", F.round("p_low", 6).alias("p_low"), F.round("p_high", 6).alias("p_high"))


def _stretch_sql(b):
    return (
        f"round(CASE WHEN {b} IN (0, 65535) OR s_{b}.p_low IS NULL THEN 0.0 WHEN s_{b}.p_high - s_{b}.p_low <= 1e-6 THEN 0.5 "
        f"ELSE least(greatest(({b} - s_{b}.p_low) / (s_{b}.p_high - s_{b}.p_low + 1e-6), 0), 1) END, 8) AS {b}"
    )


@check("a2_percentile_normalise", with_ctes(PX_SQL, _LONG, _PCT, select=(
    f"SELECT {PX}, " + ", ".join(_stretch_sql(b) for b in B4) + " FROM px1 "
    + " ".join(f"LEFT JOIN (SELECT scene_id, p_low, p_high FROM pct WHERE band = '{b}') s_{b} USING (scene_id)" for b in B4))))
def _(spark, d):
    n = raster.percentile_normalise(pixels(spark, d, 1), B4)
    return n.select("scene_id", "row", "col", *[F.round(b, 8).alias(b) for b in B4])


@check("j1_bitemporal_join", with_ctes(PX_SQL, R.PAIRS, select=(
    f"SELECT {PX}, " + ", ".join(f"b{i}_t1, b{i}_t2" for i in (1, 2, 3)) + " FROM pairs")))
def _(spark, d):
    return _pairs(spark, d)


@check("j1_shape_check", with_ctes(PX_SQL, select=(
    "SELECT scene_id, a.n AS n_t1, a.r AS rows_t1, a.c AS cols_t1, b.n AS n_t2, b.r AS rows_t2, b.c AS cols_t2, "
    "a.n = b.n AND a.r = b.r AND a.c = b.c AS same_shape FROM "
    "(SELECT scene_id, count(*) AS n, max(row) + 1 AS r, max(col) + 1 AS c FROM px1 GROUP BY 1) a JOIN "
    "(SELECT scene_id, count(*) AS n, max(row) + 1 AS r, max(col) + 1 AS c FROM px2 GROUP BY 1) b USING (scene_id)")))
def _(spark, d):
    return raster.shape_check(pixels(spark, d, 1), pixels(spark, d, 2))


@check("a4_band_difference", with_ctes(*R.TO_DIFF, select=f"SELECT {PX}, round(diff, 6) AS diff FROM diff"))
def _(spark, d):
    return raster.band_difference(_pairs(spark, d), B3).withColumn("diff", F.round("diff", 6))


@check("w2_gaussian_blur", with_ctes(*R.TO_DIFF, R.BLUR, select=f"SELECT {PX}, round(diff, 6) AS diff FROM blur"))
def _(spark, d):
    diff = raster.band_difference(_pairs(spark, d), B3)
    blurred = raster.gaussian_blur(diff, "diff", scenes(spark, d), 5, tile=16)
    return blurred.select("scene_id", "row", "col", F.round("diff", 6).alias("diff"))


@check("a3_min_max", with_ctes(*R.TO_DIFF, R.BLUR, R.NORM, select=f"SELECT {PX}, round(norm, 8) AS norm FROM nrm"))
def _(spark, d):
    diff = raster.gaussian_blur(raster.band_difference(_pairs(spark, d), B3), "diff", scenes(spark, d), 5)
    scaled = raster.min_max_normalise(save_table(diff, "difference"), "diff", "norm")
    return scaled.select("scene_id", "row", "col", F.round("norm", 8).alias("norm"))


@check("a5_otsu", with_ctes(*R.TO_SCORE, select="SELECT scene_id, otsu_bin FROM otsu"))
def _(spark, d):
    return _score(spark, d)[1]


@check("a5_otsu_score", with_ctes(*R.TO_SCORE, select=f"SELECT {PX}, round(prob, 8) AS prob FROM score"))
def _(spark, d):
    return _score(spark, d)[0].withColumn("prob", F.round("prob", 8))


@check("a9_probability_stats", with_ctes(*R.TO_SCORE, select=(
    "SELECT scene_id, round_even(avg(prob), 4) AS mean_prob, round_even(max(prob), 4) AS max_prob FROM score GROUP BY 1")))
def _(spark, d):
    return raster.score_stats(_score(spark, d)[0])


@check("f3_score_threshold", with_ctes(*R.TO_SCORE, select=f"SELECT {PX} FROM score WHERE prob >= 0.70::DOUBLE"))
def _(spark, d):
    return _score(spark, d)[0].filter("prob >= 0.70D").select("scene_id", "row", "col")


_CHANGED = "flagged AS (SELECT scene_id, row, col, CAST(b1_t2 - b1_t1 > 800 AS INT) AS flag FROM pairs)"


@check("w1_opening", with_ctes(PX_SQL, R.PAIRS, _CHANGED, R.opening_sql("flagged", "opened", "flag"), select=(
    f"SELECT {PX}, open_flag AS flag FROM opened")))
def _(spark, d):
    flagged = _pairs(spark, d).select("scene_id", "row", "col", (F.expr("b1_t2 - b1_t1 > 800")).cast("int").alias("flag"))
    return raster.opening(flagged, "flag", 3, tile=16)


# --- components and features ------------------------------------------------------------------


@check("r1_components", with_ctes(*R.TO_COMPONENTS, recursive=True, select=f"SELECT {PX}, label FROM comp"))
def _(spark, d):
    found = tile_arrays.change_pixels(pixels(spark, d, 1), pixels(spark, d, 2), scenes(spark, d), B3, tile=16)
    return found.select("scene_id", "row", "col", "label")


_LAB = "lab AS (SELECT c.*, m.prob FROM comp c JOIN mask m USING (scene_id, row, col))"


@check("a6_component_score", with_ctes(*R.TO_COMPONENTS, _LAB, recursive=True, select=(
    "SELECT scene_id, label, least(greatest(round_even(avg(prob), 4), 0), 1) AS confidence FROM lab GROUP BY 1, 2")))
def _(spark, d):
    return components.component_score(_labelled(spark, d))


_STATS = (
    "stats AS (SELECT scene_id, label, count(*) AS n_pixels, min(row) AS top, min(col) AS \"left\", "
    "max(row) - min(row) + 1 AS height, max(col) - min(col) + 1 AS width, avg(row) AS mean_row, avg(col) AS mean_col "
    "FROM comp GROUP BY 1, 2)"
)


@check("a7_component_stats", with_ctes(*R.TO_COMPONENTS, _STATS, recursive=True, select=(
    "SELECT scene_id, label, n_pixels, top, \"left\", height, width, round(mean_row, 6) AS mean_row, "
    "round(mean_col, 6) AS mean_col FROM stats")))
def _(spark, d):
    s = components.component_stats(_labelled(spark, d))
    return s.withColumns({"mean_row": F.round("mean_row", 6), "mean_col": F.round("mean_col", 6)})


@check("r3_outline_area", with_ctes(*R.TO_COMPONENTS, recursive=True, select=(
    "SELECT scene_id, label, count(*)::DOUBLE AS area_px FROM comp GROUP BY 1, 2")))
def _(spark, d):
    found = polygons.rings(polygons.ring_vertices(_labelled(spark, d)))
    return found.groupBy("scene_id", "label").agg(F.sum("area_px").alias("area_px"))


@check("r3_row_runs", with_ctes(*R.TO_COMPONENTS, recursive=True, select=(
    "SELECT scene_id, label, row, min(col) AS col_start, max(col) AS col_end FROM "
    "(SELECT *, col - row_number() OVER (PARTITION BY scene_id, row ORDER BY col) AS island FROM comp) "
    "GROUP BY scene_id, label, row, island")))
def _(spark, d):
    return polygons.row_runs(_labelled(spark, d))


def _q(lat):
    s = f"sin(radians({lat}))"
    return f"({s} / (1 - {geo.WGS84_E2!r} * {s} * {s}) + atanh({geo.WGS84_E!r} * {s}) / {geo.WGS84_E!r})"


_CELL = f"abs(radians(px) * ({_q('lat0 - px * row')} - {_q('lat0 - px * (row + 1)')})) * {geo.WGS84_B**2 / 2!r}"
FEATURE_SQL = (
    _LAB,
    f"meas AS (SELECT scene_id, label, sum({_CELL}) AS area, avg(prob) AS mp, avg(row + 0.5::DOUBLE) AS mr, "
    "avg(col + 0.5::DOUBLE) AS mc, count(*) AS n_pixels, any_value(lat0) AS lat0, any_value(lon0) AS lon0, any_value(px) AS px "
    "FROM lab JOIN scene USING (scene_id) GROUP BY 1, 2)",
    "feat AS (SELECT scene_id, label, sha256(scene_id || ':' || label) AS feature_id, "
    "least(greatest(round_even(mp, 4), 0), 1) AS confidence, round_even(area, 2) AS area_sq_m, "
    "greatest(0.005::DOUBLE, round_even(area / 10000.0::DOUBLE, 4)) AS area_hectares, "
    "round_even(lat0 - px * mr, 6) AS lat, round_even(lon0 + px * mc, 6) AS lon, n_pixels "
    "FROM meas WHERE area >= 50)",
)
_FEAT_COLS = "scene_id, label, feature_id, confidence, area_sq_m, area_hectares, lat, lon, n_pixels"


def _flat(found, *more):
    return found.select(
        "scene_id", "label", "feature_id", "confidence", "area_sq_m", "area_hectares",
        F.col("centroid.lat").alias("lat"), F.col("centroid.lon").alias("lon"), "n_pixels", *more,
    )


@check("r4_vector_features", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, recursive=True, select=f"SELECT {_FEAT_COLS} FROM feat"))
def _(spark, d):
    return _flat(features.extract_features(_score(spark, d)[0], scenes(spark, d), tile=16))


@check("r5_differencing", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, recursive=True, select=(
    f"SELECT {_FEAT_COLS}, 'Detected Surface Anomaly (surface change)' AS class FROM feat")))
def r5_differencing(spark, d):
    found = features.difference_features(
        pixels(spark, d, 1), pixels(spark, d, 2), scenes(spark, d), query_text="surface change"
    )
    return _flat(found, "class")


@check("a8_area_totals", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, recursive=True, select=(
    "SELECT scene_id, count(*) AS n_features, round(sum(area_sq_m), 2) AS total_area_sq_m, "
    "round(sum(area_sq_m) / 10000.0::DOUBLE, 4) AS total_area_ha FROM feat GROUP BY 1")))
def _(spark, d):
    return features.area_totals(features.extract_features(_score(spark, d)[0], scenes(spark, d)))


@check("f1_minimum_area", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, recursive=True, select=(
    "SELECT scene_id, label, area_sq_m FROM feat WHERE area_sq_m >= 6000")))
def _(spark, d):
    found = features.extract_features(_score(spark, d)[0], scenes(spark, d))
    return features.min_area(found, 6000.0).select("scene_id", "label", "area_sq_m")


@check("r16_mask_nodes", with_ctes(*R.TO_COMPONENTS, _STATS, recursive=True, select=(
    "SELECT 'prim_2025-01-15_' || scene_id || '_' || label AS node_id, round_even(lat0 - px * mean_row, 6) AS lat, "
    "round_even(lon0 + px * mean_col, 6) AS lon, n_pixels * 100.0::DOUBLE AS area_m2, "
    "2.0::DOUBLE * (width + height) * 10 AS perimeter_m, "
    "round_even(greatest(width / height, height / width), 2) AS aspect_ratio, "
    "round_even(lat0 - px * (top + height), 6) AS min_lat, round_even(lon0 + px * (\"left\" + width), 6) AS max_lon, "
    "CASE WHEN greatest(width / height, height / width) >= 8 AND n_pixels * 100 >= 5000 THEN 'Airstrip' "
    "WHEN greatest(width / height, height / width) >= 4.5 THEN 'Road' "
    "WHEN n_pixels * 100 < 150 AND 4 * pi() * n_pixels * 100 / pow(20.0 * (width + height), 2) >= 0.7 THEN 'Tower' "
    "WHEN n_pixels * 100 >= 15000 AND greatest(width / height, height / width) < 2.5 THEN 'GradedArea' "
    "WHEN n_pixels * 100 BETWEEN 300 AND 4000 AND 4 * pi() * n_pixels * 100 / pow(20.0 * (width + height), 2) < 0.4 "
    "THEN 'Revetment' WHEN n_pixels * 100 >= 50 THEN 'Structure' ELSE 'Unknown' END AS class "
    "FROM stats JOIN scene USING (scene_id) WHERE n_pixels * 100 >= 25")))
def _(spark, d):
    nodes = features.nodes_from_mask(_labelled(spark, d), scenes(spark, d), "2025-01-15")
    return nodes.select(
        "node_id", "lat", "lon", "area_m2", "perimeter_m", "aspect_ratio", "min_lat", "max_lon", "class"
    )


_MASK_NODES = (
    "mn AS (SELECT 'prim_2025-01-15_' || scene_id || '_' || label AS node_id, round_even(lat0 - px * mean_row, 6) AS lat, "
    "round_even(lon0 + px * mean_col, 6) AS lon FROM stats JOIN scene USING (scene_id))"
)


@check("g3_scene_graph", with_ctes(*R.TO_COMPONENTS, _STATS, _MASK_NODES, recursive=True, select=(
    f"SELECT a.node_id AS source_id, b.node_id AS target_id, round_even({hav_sql('a', 'b')}, 2) AS distance_m "
    f"FROM mn a JOIN mn b ON a.node_id < b.node_id WHERE {hav_sql('a', 'b')} <= 400")))
def _(spark, d):
    nodes = save_table(features.nodes_from_mask(_labelled(spark, d), scenes(spark, d), "2025-01-15"), "nodes")
    return graph.radius_network(nodes, 400.0).select("source_id", "target_id", "distance_m")


# --- grid differencing ------------------------------------------------------------------------


def _lum(t):
    return f"least(greatest(0.299::DOUBLE * b1_{t} + 0.587::DOUBLE * b2_{t} + 0.114::DOUBLE * b3_{t}, 0), 255)"


# Digital numbers are scaled to the 0..255 range of display imagery first.
def _display(px):
    return px.select("scene_id", "row", "col", *[(F.col(b) / 16.0).alias(b) for b in B3])


_DISPLAY = (
    "disp AS (SELECT scene_id, row, col, "
    + ", ".join(f"b{i}_{t} / 16.0::DOUBLE AS b{i}_{t}" for i in (1, 2, 3) for t in ("t1", "t2")) + " FROM pairs)"
)
_ACTIVE = f"act AS (SELECT scene_id, row, col, CAST(abs({_lum('t2')} - {_lum('t1')}) >= 38 AS INT) AS active FROM disp)"
_DENSITY = (
    "dens AS (SELECT scene_id, row // 4 AS row, col // 4 AS col, avg(active) AS density FROM act GROUP BY 1, 2, 3)"
)
_GRID = (PX_SQL, SCENE_SQL, R.PAIRS, _DISPLAY, _ACTIVE, _DENSITY)


def _display_pairs(spark, d):
    return raster.bitemporal(_display(pixels(spark, d, 1)), _display(pixels(spark, d, 2)), B3)


@check("r14_luminance_delta", with_ctes(*_GRID[:5], select=f"SELECT {PX} FROM act WHERE active = 1"))
def _(spark, d):
    return raster.luminance_change(_display_pairs(spark, d), B3).filter("active = 1").select("scene_id", "row", "col")


@check("a13_grid_density", with_ctes(*_GRID, select=(
    "SELECT scene_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(density, 6) AS density FROM dens")))
def _(spark, d):
    g = raster.grid_density(raster.luminance_change(_display_pairs(spark, d), B3), 4)
    return g.withColumn("density", F.round("density", 6))


_CELLS = (
    "cells AS MATERIALIZED (SELECT scene_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM dens WHERE density >= 0.22)",
    R.components_sql("cells", "cc"),
    "clus AS (SELECT c.*, n_cells FROM cc c JOIN (SELECT scene_id, label, count(*) AS n_cells FROM cc GROUP BY 1, 2) "
    "USING (scene_id, label) WHERE n_cells >= 2)",
)


@check("r2_grid_clusters", with_ctes(*_GRID, *_CELLS, recursive=True, select=(
    "SELECT scene_id, row, col, label, n_cells FROM clus")))
def _(spark, d):
    active = raster.luminance_change(_display_pairs(spark, d), B3)
    return features.grid_clusters(active, 4).select("scene_id", "row", "col", "label", "n_cells")


_BOXES = (
    "box0 AS (SELECT scene_id, label, count(*) AS n_cells, min(col) * 4 AS x0, (max(col) + 1) * 4 AS x1u, "
    "min(row) * 4 AS y0, (max(row) + 1) * 4 AS y1u FROM clus GROUP BY 1, 2)",
    "box1 AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n_cells DESC, label) AS rank FROM box0)",
    "box2 AS (SELECT b.*, least(x1u, n_cols) AS x1, least(y1u, n_rows) AS y1, n_rows, n_cols FROM box1 b "
    "JOIN scene USING (scene_id) WHERE rank <= 12)",
    "box3 AS (SELECT *, round((x1 - x0) * (y1 - y0) * 0.72::DOUBLE * 100.0::DOUBLE, 0) AS area_sq_m, "
    "greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) AS aspect FROM box2)",
)


@check("t1_top_clusters", with_ctes(*_GRID, *_CELLS, *_BOXES, recursive=True, select=(
    "SELECT scene_id, label, CAST(rank AS INT) AS rank, n_cells FROM box1 WHERE rank <= 12")))
def _(spark, d):
    from pyspark.sql import Window as W

    active = raster.luminance_change(_display_pairs(spark, d), B3)
    sizes = features.grid_clusters(active, 4).groupBy("scene_id", "label").agg(F.count("*").alias("n_cells"))
    order = W.partitionBy("scene_id").orderBy(F.desc("n_cells"), "label")
    return sizes.withColumn("rank", F.row_number().over(order)).filter("rank <= 12")


@check("r15_grid_differencing", with_ctes(*_GRID, *_CELLS, *_BOXES, recursive=True, select=(
    "SELECT scene_id, CAST(rank AS INT) AS rank, n_cells, x0, y0, x1, y1, area_sq_m, "
    "round(area_sq_m / 10000.0::DOUBLE, 4) AS area_hectares, "
    "CASE WHEN aspect >= 4.5 AND area_sq_m >= 5000 THEN 'Newly Paved Runway / Access Extension' "
    "WHEN aspect >= 3.0 THEN 'Graded Logistics Connector Road' WHEN area_sq_m >= 10000 THEN 'Cleared Heavy Staging Platform' "
    "WHEN area_sq_m <= 3500 AND aspect < 2.0 THEN 'Hardened Revetment Bastion ' || chr(CAST(65 + (rank - 1) % 26 AS INT)) "
    "ELSE 'Excavated Structural Enclosure #' || rank END AS class, "
    "round(least(0.98::DOUBLE, greatest(0.72::DOUBLE, 0.85::DOUBLE + n_cells / 100.0::DOUBLE * 0.1::DOUBLE)), 3) AS confidence, "
    "round(25.1::DOUBLE - (y0 + y1) / 2.0::DOUBLE / n_rows * 0.1::DOUBLE, 5) AS centroid_lat, "
    "round(75.0::DOUBLE + (x0 + x1) / 2.0::DOUBLE / n_cols * 0.1::DOUBLE, 5) AS centroid_lon "
    "FROM box3 WHERE area_sq_m >= 150")))
def _(spark, d):
    return features.grid_change_boxes(_display(pixels(spark, d, 1)), _display(pixels(spark, d, 2)), B3, cell=4)
