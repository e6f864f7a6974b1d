"""Alignment, mosaics, chips, guards, vectors, reports, pipelines and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import raster_sql as R
from checks.graph_queries import DELTA, NODE_SQL
from checks.raster_queries import B3, FEATURE_SQL, _flat, _labelled, _pairs, _score
from checks.registry import check, with_ctes
from checks.views import LAT0, LON0, PX_SQL, SCENE_SQL, T2_EPOCH, nodes_t1, nodes_t2, pixels, scenes, table, with_scene
from terradrift.functions import pixel, text
from terradrift.functions.registry import register_sql_functions
from terradrift.operators import align, chips, guards, mosaic, similarity_cells, vectors
from terradrift.plans import features, pipeline, report
from terradrift.session import save_table, work_dir
from terradrift.sources import geojson, tables, tile_store
from terradrift.streaming import detections as stream

PX = "scene_id, row, col"

# --- alignment --------------------------------------------------------------------------------

_PLANES = (
    "pl AS (SELECT scene_id, row, col, least(greatest(0.299::DOUBLE * (b1_t1 / 4000.0::DOUBLE) + 0.587::DOUBLE * (b2_t1 / 4000.0::DOUBLE) "
    "+ 0.114::DOUBLE * (b3_t1 / 4000.0::DOUBLE), 0), 1) AS l1, least(greatest(0.299::DOUBLE * (b1_t2 / 4000.0::DOUBLE) "
    "+ 0.587::DOUBLE * (b2_t2 / 4000.0::DOUBLE) + 0.114::DOUBLE * (b3_t2 / 4000.0::DOUBLE), 0), 1) AS l2 FROM pairs)"
)
_SHIFTS = (
    "sh AS (SELECT a.scene_id, dy, dx, corr(a.l1, b.l2) AS score FROM pl a, (SELECT unnest([-1, 0, 1]) AS dy) y, "
    "(SELECT unnest([-1, 0, 1]) AS dx) x, pl b WHERE b.scene_id = a.scene_id AND b.row = a.row + dy AND b.col = a.col + dx GROUP BY 1, 2, 3)"
)


def _planes(spark, d):
    lum = {
        f"l{i}": pixel.luminance(*[F.col(f"{b}_t{i}") / 4000.0 for b in B3]) for i in (1, 2)
    }
    return _pairs(spark, d).select("scene_id", "row", "col", *[v.alias(k) for k, v in lum.items()])


@check("r6_shift_scores", with_ctes(PX_SQL, R.PAIRS, _PLANES, _SHIFTS, select=(
    "SELECT scene_id, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, round(score, 6) AS score FROM sh")))
def _(spark, d):
    s = align.shift_scores(_planes(spark, d), reach=1, tile=32)
    return s.select("scene_id", "dy", "dx", F.round("score", 6).alias("score"))


@check("f10_alignment_guard", with_ctes(PX_SQL, R.PAIRS, _PLANES, _SHIFTS, select=(
    "SELECT scene_id, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, round(score, 6) AS score, "
    "CASE WHEN score < 0.65 THEN 'REJECTED_ALIGNMENT' ELSE 'OK' END AS status FROM "
    "(SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC) AS k FROM sh) WHERE k = 1")))
def _(spark, d):
    s = align.best_shift(align.shift_scores(_planes(spark, d), reach=1))
    return s.select("scene_id", "dy", "dx", F.round("score", 6).alias("score"), "status")


def _mirror(i, n):
    p = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"CASE WHEN {p} < {n} THEN {p} ELSE 2 * {n} - 1 - {p} END"


@check("r7_warp", with_ctes(PX_SQL, SCENE_SQL, select=(
    "SELECT scene_id, row, col, round(sum(w * v.b1), 6) AS b1, round(sum(w * v.b3), 6) AS b3 FROM "
    f"(SELECT p.scene_id, p.row, p.col, {_mirror('p.row - 1 + oy', 'n_rows')} AS sr, {_mirror('p.col + 2 + ox', 'n_cols')} AS sc, "
    "(CASE WHEN oy = 1 THEN 0.75 ELSE 0.25 END) * (CASE WHEN ox = 1 THEN 0.5 ELSE 0.5 END)::DOUBLE AS w "
    "FROM px2 p JOIN scene USING (scene_id), (SELECT unnest([0, 1]) AS oy) y, (SELECT unnest([0, 1]) AS ox) x) q "
    "JOIN (SELECT scene_id, row AS sr, col AS sc, b1, b3 FROM px2) v USING (scene_id, sr, sc) GROUP BY 1, 2, 3")))
def _(spark, d):
    s = scenes(spark, d)
    m = s.selectExpr("scene_id", "1D AS m00", "0D AS m01", "2.5D AS m02", "0D AS m10", "1D AS m11", "-0.25D AS m12")
    w = align.warp(pixels(spark, d, 2), s, m, ["b1", "b3"])
    return w.select("scene_id", "row", "col", F.round("b1", 6).alias("b1"), F.round("b3", 6).alias("b3"))


# --- mosaics ----------------------------------------------------------------------------------

_TILES = (
    "td AS (SELECT *, n_rows // 2 AS sr, n_cols // 2 AS sc, CAST(round_even((n_rows // 2) * 0.1::DOUBLE, 0) AS INT) AS er, "
    "CAST(round_even((n_cols // 2) * 0.1::DOUBLE, 0) AS INT) AS ec FROM scene), "
    "tb AS (SELECT scene_id, i AS tile_i, j AS tile_j, n_rows, n_cols, CASE WHEN i = 0 THEN 0 ELSE greatest(sr - er, 0) END AS r1, "
    "CASE WHEN i = 1 THEN n_rows ELSE least(sr + er, n_rows) END AS r2, CASE WHEN j = 0 THEN 0 ELSE greatest(sc - ec, 0) END AS c1, "
    "CASE WHEN j = 1 THEN n_cols ELSE least(sc + ec, n_cols) END AS c2 FROM td, (SELECT unnest([0, 1]) AS i) y, (SELECT unnest([0, 1]) AS j) x)"
)


def _ramp_sql(pos, lo, hi, idx, border):
    n = f"({hi} - {lo})"
    ov = f"CAST(round_even({n} / 2 * 0.1::DOUBLE, 0) AS INT)"
    ov = f"(CASE WHEN 2 * {ov} <= {n} THEN {ov} ELSE {n} // 2 END)"

    def rise(k):
        return f"0.5 * (1 - cos(pi() * ({k}) / greatest({ov} - 1, 1)))"

    lo_ok, hi_ok = ("true", "true") if border else (f"{idx} <> 0", f"{idx} <> 1")
    return (
        f"(CASE WHEN {hi} - 1 - {pos} < {ov} AND {hi_ok} THEN {rise(f'{hi} - 1 - {pos}')} "
        f"WHEN {pos} - {lo} < {ov} AND {lo_ok} THEN {rise(f'{pos} - {lo}')} ELSE 1.0 END)"
    )


def _weights(border):
    w = f"{_ramp_sql('row', 'r1', 'r2', 'tile_i', border)} * {_ramp_sql('col', 'c1', 'c2', 'tile_j', border)}"
    return (
        f"tw AS (SELECT p.scene_id, row, col, tile_i, tile_j, {w} AS weight, least(abs(b1_t2 - b1_t1) / 2000.0::DOUBLE, 1) AS base "
        "FROM pairs p JOIN tb ON tb.scene_id = p.scene_id AND row >= r1 AND row < r2 AND col >= c1 AND col < c2)"
    )


def _tiled(spark, d):
    return mosaic.assign_tiles(_pairs(spark, d), scenes(spark, d))


@check("r8_tile_bounds", with_ctes(PX_SQL, SCENE_SQL, _TILES, select="SELECT scene_id, tile_i, tile_j, r1, r2, c1, c2 FROM tb"))
def _(spark, d):
    return mosaic.tile_bounds(scenes(spark, d)).drop("parts_i", "parts_j")


@check("r9_blend_weights", with_ctes(PX_SQL, SCENE_SQL, R.PAIRS, _TILES, _weights(True), select=(
    f"SELECT {PX}, tile_i, tile_j, round(weight, 8) AS weight FROM tw")))
def _(spark, d):
    t = _tiled(spark, d)
    w = mosaic.blend_weight(ref_border=True)
    return t.select("scene_id", "row", "col", "tile_i", "tile_j", F.round(w, 8).alias("weight"))


def _step_score(pdf):
    return ((pdf["b1_t2"] - pdf["b1_t1"]).abs() / 2000.0).clip(upper=1.0)


@check("r10_tiled_score", with_ctes(PX_SQL, SCENE_SQL, R.PAIRS, _TILES, _weights(False), select=(
    f"SELECT {PX}, round(least(greatest(sum(base * weight) / greatest(sum(weight), 1e-6), 0), 1), 8) AS prob FROM tw GROUP BY 1, 2, 3")))
def _(spark, d):
    scored = mosaic.tiled_scores(_pairs(spark, d), scenes(spark, d), _step_score)
    return scored.withColumn("prob", F.round("prob", 8))


@check("a17_weighted_blend", with_ctes(PX_SQL, SCENE_SQL, R.PAIRS, _TILES, _weights(True), select=(
    f"SELECT {PX}, round(least(greatest(sum(base * (1 + tile_i + tile_j) * weight) / greatest(sum(weight), 1e-6), 0), 1), 8) AS prob "
    "FROM tw GROUP BY 1, 2, 3")))
def _(spark, d):
    base = F.least(F.abs(F.col("b1_t2") - F.col("b1_t1")) / 2000.0, F.lit(1.0))
    t = _tiled(spark, d).withColumns(
        {"prob": base * (1 + F.col("tile_i") + F.col("tile_j")), "weight": mosaic.blend_weight(ref_border=True)}
    )
    return mosaic.blend(t).withColumn("prob", F.round("prob", 8))


# --- chips ------------------------------------------------------------------------------------

_CENTRES = (
    "ce AS (SELECT s_suppkey AS chip_id, 'S' || (s_suppkey % (SELECT count(*) FROM scene)) AS scene_id, CAST((s_suppkey * 7) % 40 AS INT) AS cr, "
    "CAST((s_suppkey * 13) % 100 AS INT) AS cc FROM supplier)"
)


@check("r11_chips", with_ctes(PX_SQL, SCENE_SQL, _CENTRES, select=(
    "SELECT chip_id, CAST(y AS INT) AS row, CAST(x AS INT) AS col, coalesce(b1, 0) AS b1, coalesce(b2, 0) AS b2 FROM ce, "
    "(SELECT unnest(range(0, 8)) AS y) g, (SELECT unnest(range(0, 8)) AS x) h LEFT JOIN px2 p ON p.scene_id = ce.scene_id "
    "AND p.row = cr - 4 + y AND p.col = cc - 4 + x")))
def _(spark, d):
    centres = with_scene(table(spark, d, "supplier"), scenes(spark, d), "s_suppkey").selectExpr(
        "s_suppkey AS chip_id", "scene_id",
        "CAST((s_suppkey * 7) % 40 AS INT) AS cr", "CAST((s_suppkey * 13) % 100 AS INT) AS cc",
    )
    return chips.extract_chips(pixels(spark, d, 2), centres, ["b1", "b2"], 8)


_SHOWN = (
    "en AS (SELECT scene_id, min(least(b1, b2, b3))::DOUBLE AS lo, max(greatest(b1, b2, b3))::DOUBLE AS hi FROM px2 GROUP BY 1), "
    "shown AS (SELECT scene_id, row, col, "
    + ", ".join(f"CAST(floor((b{i} - lo) / (hi - lo) * 255.0::DOUBLE) AS INT) AS {c}" for i, c in ((1, "red"), (2, "green"), (3, "blue")))
    + " FROM px2 JOIN en USING (scene_id))"
)


@check("r12_display_stretch", with_ctes(PX_SQL, _SHOWN, select=f"SELECT {PX}, red, green, blue FROM shown"))
def _(spark, d):
    return chips.display_stretch(pixels(spark, d, 2).drop("b4"), list(B3))


def _mixed(name, colour):
    return f"CAST(CASE WHEN m.row IS NOT NULL THEN round_even({0.4 * colour!r} + 0.6::DOUBLE * {name}, 0) ELSE {name} END AS INT) AS {name}"


@check("r13_overlay", with_ctes(*R.TO_MASK, _SHOWN, select=(
    f"SELECT s.scene_id, s.row, s.col, {_mixed('red', 239)}, {_mixed('green', 68)}, {_mixed('blue', 68)} FROM shown s "
    "LEFT JOIN mask m ON m.scene_id = s.scene_id AND m.row = s.row AND m.col = s.col")))
def _(spark, d):
    shown = chips.display_stretch(pixels(spark, d, 2).drop("b4"), list(B3))
    return chips.overlay(shown, _labelled(spark, d))


# --- guards -----------------------------------------------------------------------------------

_TERMS_SQL = "terms AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {d}::DOUBLE, {i})" for i, (t, d) in enumerate(guards.CATALOGUE)) + ") v(term, dimension_m, ordinal))"
_ASKS = (
    "asks AS (SELECT doc_id AS request_id, text || ' seen near the ' || term || '.' AS query_text, 2.0::DOUBLE + doc_id % 20 AS gsd "
    f"FROM documents JOIN terms ON ordinal = doc_id % {len(guards.CATALOGUE)})"
)
_BEST = (
    "plain AS MATERIALIZED (SELECT request_id, lower(query_text) AS low, ' ' || array_to_string(regexp_split_to_array(lower(query_text), "
    r"'[^\pL\pN\pM_]+'), ' ') || ' ' AS spaced FROM asks), "
    "best AS (SELECT request_id, term, dimension_m FROM (SELECT a.request_id, t.term, t.dimension_m, row_number() OVER "
    "(PARTITION BY request_id ORDER BY length(t.term) DESC, t.ordinal) AS k FROM plain a, terms t "
    "WHERE contains(spaced, ' ' || t.term || ' ') AND contains(low, t.term)) WHERE k = 1)"
)


def _asks(spark, d):
    n = len(guards.CATALOGUE)
    terms = guards.catalogue(spark).select("term", F.col("ordinal").cast("long").alias("k"))
    docs = table(spark, d, "documents").withColumn("k", F.col("doc_id") % n)
    return docs.join(terms, "k").select(
        F.col("doc_id").alias("request_id"), F.concat("text", F.lit(" seen near the "), "term", F.lit(".")).alias("query_text"),
        (F.lit(2.0) + F.col("doc_id") % 20).alias("gsd"),
    )


@check("f6_resolution", with_ctes(_TERMS_SQL, _ASKS, _BEST, select=(
    "SELECT a.request_id, term, dimension_m, CASE WHEN dimension_m < 2 * gsd THEN 'REJECTED_SUB_NYQUIST' ELSE 'OK' END AS status "
    "FROM asks a LEFT JOIN best USING (request_id)")))
def _(spark, d):
    s = guards.resolution_status(_asks(spark, d), guards.catalogue(spark), F.col("gsd"))
    return s.select("request_id", "term", "dimension_m", "status")


@check("w3_longest_match", with_ctes(_TERMS_SQL, _ASKS, _BEST, select="SELECT request_id, term, dimension_m FROM best"))
def _(spark, d):
    return guards.catalogue_matches(_asks(spark, d), guards.catalogue(spark))


_REQ_COLS = [
    "c_custkey AS request_id", "CASE WHEN c_custkey % 11 = 0 THEN '??!' WHEN c_custkey % 13 = 0 THEN 'ab' ELSE c_mktsegment END AS query_text",
    "CAST(c_acctbal / 100.0 AS DOUBLE) AS min_lat", "CAST(c_acctbal / 100.0 + 1.0 - c_custkey % 3 AS DOUBLE) AS max_lat",
    "CAST(c_acctbal / 40.0 - 60.0 AS DOUBLE) AS min_lon", "CAST(c_acctbal / 40.0 - 59.0 AS DOUBLE) AS max_lon",
    "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(0.25 + (c_custkey % 70) / 100.0 AS DOUBLE) END AS tau",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 60 AS DOUBLE) END AS cloud_percent",
]
_REQS = "reqs AS (SELECT " + ", ".join(_REQ_COLS).replace("100.0", "100.0::DOUBLE").replace("40.0", "40.0::DOUBLE") + " FROM customer)"


@check("f12_request_validation", with_ctes(_REQS, "rq AS (SELECT *, coalesce(tau, 0.70) AS t, coalesce(cloud_percent, 35) AS cp FROM reqs)", select=(
    "SELECT request_id, CASE WHEN length(query_text) NOT BETWEEN 3 AND 256 THEN 'query_text length' "
    "WHEN NOT regexp_matches(query_text, '[A-Za-z0-9]') THEN 'query_text noise' "
    "WHEN min_lat NOT BETWEEN -90 AND 90 OR max_lat NOT BETWEEN -90 AND 90 THEN 'latitude range' "
    "WHEN min_lon NOT BETWEEN -180 AND 180 OR max_lon NOT BETWEEN -180 AND 180 THEN 'longitude range' "
    "WHEN max_lat <= min_lat OR max_lon <= min_lon THEN 'bounds order' WHEN t NOT BETWEEN 0.30 AND 0.95 THEN 'tau range' "
    "WHEN cp NOT BETWEEN 5 AND 50 THEN 'cloud range' END AS problem FROM rq")))
def _(spark, d):
    reqs = table(spark, d, "customer").selectExpr(*[c.replace("100.0", "100.0D").replace("40.0", "40.0D") for c in _REQ_COLS])
    return guards.validate_requests(reqs).select("request_id", "problem")


@check("l3_status", with_ctes(_TERMS_SQL, _ASKS, _BEST, select=(
    "SELECT a.request_id, CASE WHEN dimension_m < 2 * gsd THEN 'REJECTED_SUB_NYQUIST' WHEN a.request_id % 4 = 1 THEN 'REJECTED_CLOUD_COVER' "
    "ELSE 'COMPLETED' END AS status FROM asks a LEFT JOIN best USING (request_id)")))
def _(spark, d):
    asks = _asks(spark, d)
    fit = guards.resolution_status(asks, guards.catalogue(spark), F.col("gsd"))
    cloudy = asks.filter("request_id % 4 = 1").select("request_id", F.lit("REJECTED_CLOUD_COVER").alias("status"))
    return guards.overall_status(asks, fit, cloudy)


# --- text and vectors -------------------------------------------------------------------------

_WORDS = r"wd AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\s\x0b\x85\pZ]+')) AS w FROM documents) WHERE w <> '')"


@check("p19_words", with_ctes(_WORDS, select="SELECT doc_id, count(*) AS n_words, count(DISTINCT w) AS n_distinct FROM wd GROUP BY 1"))
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(text.words("text")).alias("w"))
    counts = w.groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


_COORDS = (
    "co AS (SELECT doc_id, h % 64 AS idx, sum(CASE WHEN (h // 128) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS value FROM "
    "(SELECT doc_id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) AS BIGINT) AS h FROM wd) GROUP BY 1, 2 HAVING "
    "sum(CASE WHEN (h // 128) % 2 = 0 THEN 1 ELSE -1 END) <> 0)"
)


def _round8(c):
    """Eight places as the SQL engine rounds them: 23 / 2560 is a tie in decimals, but not once it is scaled."""
    return F.round(F.col(c) * 1e8) / 1e8


@check("v1_hash_embedding", with_ctes(_WORDS, _COORDS, select=(
    "SELECT doc_id, CAST(idx AS INT) AS idx, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 8) AS value FROM co")))
def _(spark, d):
    v = vectors.embed_text(table(spark, d, "documents"), "doc_id", "text", 64)
    return v.select("doc_id", F.posexplode("vector").alias("idx", "value")).filter("value <> 0").withColumn("value", _round8("value"))


_VEC = (
    "vx AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), "
    "cen AS (SELECT label, i, avg(x) AS x FROM vx GROUP BY 1, 2), "
    "cu AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM cen), "
    "vu AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM vx)"
)


def _centroids(spark, d):
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return mean.groupBy("label").agg(listed.alias("centre"))


@check("p15_unit_vectors", with_ctes(_VEC, select="SELECT vec_id, CAST(i - 1 AS INT) AS i, round(x, 8) AS x FROM vu"))
def _(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", F.posexplode(pixel.unit("embedding")).alias("i", "x"))
    return u.withColumn("x", F.round("x", 8))


@check("v2_negative_conditioning", with_ctes(_VEC, "mv AS (SELECT v.vec_id, v.i, v.x - 0.65 * c.x AS x FROM vu v JOIN cu c "
       "ON c.label = (v.label + 1) % 10 AND c.i = v.i)", select=(
    "SELECT vec_id, CAST(i - 1 AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 8) AS x FROM mv")))
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", ((F.col("label") + 1) % 10).alias("label"), pixel.unit("embedding").alias("p"))
    n = _centroids(spark, d).select("label", pixel.unit("centre").alias("n"))
    out = e.join(n, "label").select("vec_id", F.posexplode(vectors.condition("p", "n")).alias("i", "x"))
    return out.withColumn("x", F.round("x", 8))


@check("v3_top_similar", with_ctes(_VEC, "sc AS (SELECT c.label AS query_id, vec_id AS item_id, sum(c.x * v.x) AS score FROM cu c JOIN vu v "
       "USING (i) GROUP BY 1, 2)", select=(
    "SELECT query_id, item_id, round(score, 6) AS score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY score DESC, item_id) AS k FROM sc) WHERE k <= 5")))
def _(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vec"))
    queries = _centroids(spark, d).select(F.col("label").alias("query_id"), F.col("centre").alias("query_vec"))
    return similarity_cells.top_similar(queries, items, 5).withColumn("score", F.round("score", 6))


# --- digests and reports ----------------------------------------------------------------------


@check("p16_digests", (
    "SELECT doc_id, sha256(text) AS text_sha256, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}') "
    "AS json_sha256 FROM documents"))
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.digest("text").alias("text_sha256"), text.digest(text.canonical_json("n_chars", "lang", "doc_id")).alias("json_sha256")
    )


@check("p17_cache_key", "SELECT o_orderkey, sha256(o_custkey || '::' || o_orderstatus || '::' || o_orderpriority) AS key FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", text.cache_key(F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("key")
    )


_TASKS = "task AS (SELECT scene_id AS task_id, scene_id FROM scene UNION ALL SELECT 'empty', NULL)"


def _features(spark, d):
    found = save_table(features.extract_features(_score(spark, d)[0], scenes(spark, d)), "features")
    return found.withColumn("task_id", F.col("scene_id"))


def _runs(spark, d):
    ids = scenes(spark, d).select(F.col("scene_id").alias("task_id"), "scene_id")
    empty = ids.limit(1).select(F.lit("empty").alias("task_id"), F.lit(None).cast("string").alias("scene_id"))
    return ids.unionByName(empty)


@check("l4_target_table", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, _TASKS, recursive=True, select=(
    "SELECT t.task_id, CAST(coalesce(k, 1) AS INT) AS position, coalesce(substr(feature_id, 1, 8), '-') AS id, "
    "coalesce(printf('%.1f%%', confidence * 100), '-') AS confidence, coalesce(format('{:,.0f}', round_even(area_sq_m, 0)), '0') AS area_m2, "
    "coalesce(printf('%.3f', area_hectares), '0.000') AS area_ha, coalesce(printf('%.4f', lat) || '°, ' || printf('%.4f', lon) || '°', '-') AS centroid "
    "FROM task t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY area_sq_m DESC, feature_id) AS k FROM feat) f "
    "ON f.scene_id = t.scene_id AND k <= 15")))
def _(spark, d):
    return report.target_table(_features(spark, d), _runs(spark, d)).drop("class", "grid_ref")


@check("l5_run_metadata", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, _TASKS, recursive=True, select=(
    "SELECT t.task_id, 'ops' AS analyst, '2024-01-15' AS t1, '2025-01-15' AS t2, 'None' AS negative_query, "
    "'[24.9000, 75.0000] to [25.0000, 75.1000]' AS aoi, count(feature_id) AS n_features, "
    "format('{:,.1f}', coalesce(sum(area_sq_m), 0)) || ' m² (' || printf('%.3f', coalesce(sum(area_sq_m), 0) / 10000) || ' ha)' AS altered_area "
    "FROM task t LEFT JOIN feat f ON f.scene_id = t.scene_id GROUP BY 1")))
def _(spark, d):
    runs = _runs(spark, d).selectExpr(
        "task_id", "scene_id", "'ops' AS analyst", "'surface change' AS query_text", "CAST(NULL AS STRING) AS negative_query",
        "DATE '2024-01-15' AS t1", "DATE '2025-01-15' AS t2", "24.9D AS min_lat", "25.0D AS max_lat", "75.0D AS min_lon", "75.1D AS max_lon",
    )
    shifts = align.best_shift(align.shift_scores(_planes(spark, d), reach=1))
    return report.run_metadata(runs, _features(spark, d), shifts).drop("query_text", "alignment")


def _manifest_inputs(spark, d):
    runs = _runs(spark, d).select(
        "task_id", F.lit("ops").alias("analyst"), text.digest(F.concat(F.lit("t1"), "task_id")).alias("t1_sha256"),
        text.digest(F.concat(F.lit("t2"), "task_id")).alias("t2_sha256"),
    )
    return runs, _features(spark, d)


@check("a18_evidence_manifest", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, _TASKS, recursive=True, select=(
    "SELECT task_id, sha256('t1' || task_id) AS t1_sha256, sha256('t2' || task_id) AS t2_sha256, "
    "count(feature_id) > 0 AS has_features FROM task t LEFT JOIN feat f ON f.scene_id = t.scene_id GROUP BY 1")))
def _(spark, d):
    runs, found = _manifest_inputs(spark, d)
    m = report.evidence_manifest(runs, found, "2025-02-01T00:00:00Z")
    none = text.digest(F.lit(""))
    return m.select("task_id", "t1_sha256", "t2_sha256", (F.col("vector_sha256") != none).alias("has_features"))


@check("l6_verify_manifest", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, _TASKS, recursive=True, select=(
    "SELECT task_id, count(feature_id) FILTER (WHERE area_sq_m >= 400) = 0 AS verified FROM task t LEFT JOIN feat f ON f.scene_id = t.scene_id GROUP BY 1")))
def _(spark, d):
    runs, found = _manifest_inputs(spark, d)
    found = save_table(found, "features")
    stored = save_table(report.evidence_manifest(runs, found, "2025-02-01T00:00:00Z"), "manifest")
    # Large features lose a square metre after the seal: exactly the manifests of tasks that have one must fail.
    changed = found.withColumn("area_sq_m", F.when(F.col("area_sq_m") >= 400, F.col("area_sq_m") - 1).otherwise(F.col("area_sq_m")))
    return report.verify_manifest(stored, runs, changed)


@check("s7_feature_export", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, recursive=True, select=(
    "SELECT feature_id, 'MultiPolygon' AS kind, confidence, area_sq_m, lat, lon, true AS closed FROM feat")))
def _(spark, d):
    found = features.extract_features(_score(spark, d)[0], scenes(spark, d), geometry=True)
    path = f"{work_dir(spark)}/export-{abs(hash(d))}"
    geojson.write_feature_lines(found, path)
    back = spark.read.text(path)
    get = lambda p: F.get_json_object("value", p)
    ring = F.from_json(get("$.geometry.coordinates"), "array<array<array<array<double>>>>")[0][0]
    return back.select(
        get("$.properties.feature_id").alias("feature_id"), get("$.geometry.type").alias("kind"),
        get("$.properties.confidence").cast("double").alias("confidence"),
        get("$.properties.area_sq_meters").cast("double").alias("area_sq_m"),
        get("$.properties.centroid_lat").cast("double").alias("lat"), get("$.properties.centroid_lon").cast("double").alias("lon"),
        (ring[0] == F.element_at(ring, -1)).alias("closed"),
    )


@check("s8_task_export", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, recursive=True, select=(
    "SELECT scene_id, 'changes_t9' AS name, 'urn:ogc:def:crs:OGC:1.3:CRS84' AS crs, count(*) OVER (PARTITION BY scene_id) AS n_features, "
    "row_number() OVER (PARTITION BY scene_id ORDER BY feature_id) = 1 AS leads, feature_id, 't9' AS task_id, confidence, area_sq_m, lat, lon FROM feat")))
def _(spark, d):
    found = save_table(features.extract_features(_score(spark, d)[0], scenes(spark, d), geometry=True), "features")
    path = f"{work_dir(spark)}/tasks-{uuid.uuid4().hex}"
    manifest = geojson.write_collections(found, path, "scene_id", "t9")
    lines = geojson.read_collections_lines(spark, path, found.schema["scene_id"].dataType.simpleString(), "scene_id")
    get = lambda p: F.get_json_object("one", p)
    heads = lines.filter(F.col("value").endswith("[")).withColumn("one", F.concat("value", F.lit("]}"))).select(
        "scene_id", get("$.name").alias("name"), get("$.crs.properties.name").alias("crs"))
    counts = manifest.groupBy("scene_id").agg(F.sum("n_features").alias("n_features"))
    one = lines.filter(F.col("value").contains('"Feature"')).withColumn("one", F.ltrim("value", F.lit(",")))
    place = F.from_json(get("$.properties.centroid_wgs84"), "array<double>")
    return one.join(heads, "scene_id").join(counts, "scene_id").select(
        "scene_id", "name", "crs", "n_features", F.col("value").startswith("{").alias("leads"), get("$.properties.feature_id").alias("feature_id"),
        get("$.properties.task_id").alias("task_id"), get("$.properties.confidence").cast("double").alias("confidence"),
        get("$.properties.area_sq_meters").cast("double").alias("area_sq_m"), place[0].alias("lat"), place[1].alias("lon"))


@check("s9_persist_detections", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, _TASKS, recursive=True, select=(
    "SELECT t.task_id, count(feature_id) AS stored, count(feature_id) AS polygons_detected, round(coalesce(sum(area_sq_m), 0), 2) AS total_area_sq_m "
    "FROM task t LEFT JOIN feat f ON f.scene_id = t.scene_id GROUP BY 1")))
def _(spark, d):
    root = f"{work_dir(spark)}/store-{uuid.uuid4().hex}"
    found = _features(spark, d).withColumn("epoch", F.lit("2025-01-15").cast("date"))
    tables.persist_run(found, tables.audit_row(found, _runs(spark, d).select("task_id", F.lit("q").alias("prompt"))), root)
    kept = spark.read.parquet(f"{root}/detected_changes").groupBy("task_id").agg(F.count("*").alias("stored"))
    audit = spark.read.parquet(f"{root}/audit_logs").select("task_id", "polygons_detected", "total_area_sq_m")
    return audit.join(kept, "task_id", "left").fillna({"stored": 0})


@check("s10_insert_absent", with_ctes(NODE_SQL, select=(
    "SELECT node_id, CAST(epoch AS DATE) AS epoch FROM node1 UNION ALL SELECT node_id, epoch FROM node2 WHERE node_id NOT IN (SELECT node_id FROM node1)")))
def _(spark, d):
    path = f"{work_dir(spark)}/nodes-{uuid.uuid4().hex}"
    tables.insert_absent(nodes_t1(spark, d), path, "node_id")
    tables.insert_absent(nodes_t2(spark, d), path, "node_id")
    return spark.read.parquet(path).select("node_id", "epoch")


# --- pipelines --------------------------------------------------------------------------------


def _requests(spark, d):
    """Requests from the suppliers: windows on all scenes, some infeasible or out of cover."""
    return with_scene(table(spark, d, "supplier"), scenes(spark, d), "s_suppkey").selectExpr(
        "concat('r', CAST(s_suppkey AS STRING)) AS request_id", "scene_id",
        "CASE WHEN s_suppkey % 7 = 0 THEN 'a parked vehicle' ELSE 'runway extension' END AS query_text",
        "24.9965D - scene_no * 0.004D AS min_lat", "24.9999D - scene_no * 0.004D AS max_lat",
        "75.0002D + (s_suppkey % 10) * 0.0012D AS min_lon", "75.0062D + (s_suppkey % 10) * 0.0012D AS max_lon",
        "0.6D + (s_suppkey % 4) * 0.1D AS tau", "CASE WHEN s_suppkey % 9 = 0 THEN 70D ELSE 35D END AS cloud_percent",
        "'2024-01-15' AS t1", "'2025-01-15' AS t2",
    )


def _analysis(spark, d):
    first, second = (tile_store.store_pixels(pixels(spark, d, e), B3, tile=16) for e in (1, 2))
    # The quality bits of a scene's first epoch: every fifth scene is half under cloud.
    cloud = pixels(spark, d, 1).selectExpr("scene_id", "row", "col", "CAST(CAST(substr(scene_id, 2) AS INT) % 5 = 4 AND row < 20 AS INT) AS mask")
    return pipeline.analyze(_requests(spark, d), first, second, scenes(spark, d), guards.catalogue(spark), B3, cloud_mask=cloud)


@check("l1_analyze")
def _(spark, d):
    return _analysis(spark, d).summary


@check("l2_requery", with_ctes(*R.TO_COMPONENTS, *FEATURE_SQL, recursive=True, select=(
    "SELECT feature_id, confidence, area_sq_m, 'second look' AS class FROM feat WHERE scene_id = 'S1'").replace("S1", "S0")))
def _(spark, d):
    path = f"{work_dir(spark)}/scores-{uuid.uuid4().hex}"
    score = _score(spark, d)[0].join(scenes(spark, d).select("scene_id", "affine"), "scene_id")
    keyed = score.withColumn("cache_key", text.cache_key("scene_id", F.lit("t1"), F.lit("t2")))
    keyed.write.partitionBy("cache_key").parquet(path)
    key = spark.range(1).select(text.cache_key(F.lit("S0"), F.lit("t1"), F.lit("t2"))).first()[0]
    found = pipeline.requery(spark, path, key, 0.70, "second look")
    return found.select("feature_id", "confidence", "area_sq_m", "class")


_LAYERS = (
    "layered AS (SELECT s.scene_id || '@' || tau AS scene_id, row, col, prob, CAST(prob >= tau AS INT) AS flag FROM score s, "
    "(SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS tau) t)"
)


@check("l2_threshold_sweep", with_ctes(
    *R.TO_SCORE, _LAYERS, R.opening_sql("layered", "lopen", "flag"),
    "lmask AS MATERIALIZED (SELECT scene_id, row, col FROM lopen WHERE open_flag = 1)", R.components_sql("lmask", "lcomp"),
    "cnt AS (SELECT scene_id, label, count(*) AS n FROM lcomp GROUP BY 1, 2)",
    recursive=True, select=(
        "SELECT scene_id, tau, count(label) AS n_features FROM (SELECT s.scene_id, tau, label FROM scene s CROSS JOIN "
        "(SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS tau) t LEFT JOIN cnt c ON c.scene_id = s.scene_id || '@' || tau) GROUP BY 1, 2")))
def _(spark, d):
    score = save_table(_score(spark, d)[0], "scores")
    return pipeline.sweep(score, scenes(spark, d), [0.5, 0.7, 0.9]).drop("total_area_sq_m")


_SCREEN = (
    "hit AS (SELECT 25.0::DOUBLE - (s_suppkey % n) * 0.004::DOUBLE - 0.0001::DOUBLE - (s_suppkey % 7) * 0.0005::DOUBLE AS lat, "
    "75.0002::DOUBLE + (s_suppkey % 9) * 0.0003::DOUBLE AS lon FROM supplier, (SELECT count(*) AS n FROM scene))",
    "sbox AS (SELECT round_even(min(lat) - 60.0::DOUBLE / 111320.0::DOUBLE, 6) AS min_lat, round_even(max(lat) + 60.0::DOUBLE / 111320.0::DOUBLE, 6) AS max_lat, "
    "round_even(min(lon) - 60.0::DOUBLE / (111320.0::DOUBLE * cos(radians(25.0::DOUBLE))), 6) AS min_lon, "
    "round_even(max(lon) + 60.0::DOUBLE / (111320.0::DOUBLE * cos(radians(25.0::DOUBLE))), 6) AS max_lon FROM hit "
    "GROUP BY CAST(trunc(lat / 0.05::DOUBLE) AS INT), CAST(trunc(lon / 0.05::DOUBLE) AS INT))",
    "swin AS (SELECT scene_id, greatest(round_even((lat0 - max_lat) / px, 0), 0) AS row0, greatest(round_even((min_lon - lon0) / px, 0), 0) AS col0, "
    "least(round_even((lat0 - max_lat) / px, 0) + round_even((max_lat - min_lat) / px, 0), n_rows) AS row1, "
    "least(round_even((min_lon - lon0) / px, 0) + round_even((max_lon - min_lon) / px, 0), n_cols) AS col1 FROM scene, sbox)",
    "screened AS (SELECT DISTINCT p.scene_id, p.row, p.col FROM px1 p JOIN swin w ON p.scene_id = w.scene_id AND w.row1 > w.row0 AND w.col1 > w.col0 "
    "AND p.row // 16 BETWEEN w.row0 // 16 AND (w.row1 - 1) // 16 AND p.col // 16 BETWEEN w.col0 // 16 AND (w.col1 - 1) // 16)",
)


def _gap_blur(src: str, out: str, axis: str, size: str) -> str:
    """Blur along an axis over the pixels that are there: mirrored at the raster's edges, weights scaled up beside gaps."""
    across = "row" if axis == "col" else "col"
    period = f"(2 * s.{size} - 2)"
    place = f"(((s.{axis} + d) % {period} + {period}) % {period})"
    return (
        f"{out} AS (SELECT s.scene_id, s.row, s.col, s.n_rows, s.n_cols, sum(w * n.diff) / sum(w) AS diff FROM {src} s, "
        f"(VALUES (-2, 0.0625::DOUBLE), (-1, 0.25::DOUBLE), (0, 0.375::DOUBLE), (1, 0.25::DOUBLE), (2, 0.0625::DOUBLE)) k(d, w) "
        f"JOIN {src} n ON n.scene_id = s.scene_id AND n.{across} = s.{across} AND n.{axis} = least({place}, {period} - {place}) GROUP BY ALL)"
    )


@check("l7_screened_scoring", with_ctes(
    PX_SQL, SCENE_SQL, *_SCREEN, R.PAIRS.replace("px1 a JOIN", "px1 a SEMI JOIN screened USING (scene_id, row, col) JOIN"), R.DIFF,
    "sized AS (SELECT d.*, n_rows, n_cols FROM diff d JOIN scene USING (scene_id))", _gap_blur("sized", "bl1", "col", "n_cols"),
    _gap_blur("bl1", "blur", "row", "n_rows"), R.NORM, R.OTSU, R.SCORE, R.MASK, R.components_sql("mask", "comp"), *FEATURE_SQL,
    recursive=True, select="SELECT scene_id, label, feature_id, confidence, area_sq_m, area_hectares, lat, lon, n_pixels FROM feat"))
def _(spark, d):
    hits = with_scene(table(spark, d, "supplier"), scenes(spark, d), "s_suppkey").selectExpr(
        "25.0D - scene_no * 0.004D - 0.0001D - (s_suppkey % 7) * 0.0005D AS lat", "75.0002D + (s_suppkey % 9) * 0.0003D AS lon"
    )
    first, second = (tile_store.store_pixels(pixels(spark, d, e), B3, tile=16) for e in (1, 2))
    return _flat(pipeline.screened_features(hits, first, second, scenes(spark, d), 25.0, padding_m=60.0, screen_tile=16))


@check("u1_sql_functions", with_ctes(NODE_SQL, select=(
    "SELECT node_id, round(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(24.1::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * "
    "cos(radians(24.1::DOUBLE)) * pow(sin(radians(75.1::DOUBLE - lon) / 2), 2))), 3) AS metres, "
    "round(radians(lat - 24.0::DOUBLE) * 6371000.0::DOUBLE, 3) AS y FROM node1")))
def _(spark, d):
    register_sql_functions(spark)
    nodes_t1(spark, d).createOrReplaceTempView("check_nodes")
    return spark.sql(
        "SELECT node_id, round(haversine_m(lat, lon, 24.1D, 75.1D), 3) AS metres, round(tangent_y(lat, 24.0D), 3) AS y FROM check_nodes"
    )


# --- streaming --------------------------------------------------------------------------------

_DET = [
    "CAST(ts AS TIMESTAMP) AS ts", "event_type AS class", "24.0 + (event_id % 97) * 0.003 AS lat", "75.0 + (event_id % 89) * 0.004 AS lon", "value AS area_sq_m",
]
_DET_SQL = "det AS (SELECT " + ", ".join(_DET).replace("24.0", "24.0::DOUBLE").replace("75.0", "75.0::DOUBLE").replace(
    "0.003", "0.003::DOUBLE").replace("0.004", "0.004::DOUBLE") + " FROM events)"
_DET_SPARK = [c.replace("24.0", "24.0D").replace("75.0", "75.0D").replace("0.003", "0.003D").replace("0.004", "0.004D") for c in _DET]
_WINDOWED = (
    "win AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, class, "
    "CAST(floor(lat / 0.05::DOUBLE) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.05::DOUBLE) AS BIGINT) AS cell_lon, count(*) AS n, "
    "round(sum(area_sq_m), 2) AS area_sq_m FROM det GROUP BY ALL)"
)


def _naive(counts):
    return counts.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@check("x1_windowed_counts", with_ctes(_DET_SQL, _WINDOWED, select="SELECT * FROM win"))
def _(spark, d):
    return _naive(stream.windowed_counts(table(spark, d, "events").selectExpr(*_DET_SPARK), "6 hours"))


@check("x1_streamed_counts", with_ctes(_DET_SQL, _WINDOWED, select=(
    "SELECT * FROM win WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM det)")))
def _(spark, d):
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = stream.windowed_counts(source.selectExpr(*_DET_SPARK), "6 hours")
    query = (
        counts.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return _naive(spark.read.schema(counts.schema).parquet(f"{out}/data"))


@check("x2_latest_baseline", (
    "WITH h AS (SELECT o_custkey AS site_id, CAST(o_orderdate AS DATE) AS epoch, 'n' || o_orderkey AS node_id, o_totalprice AS area_m2 FROM orders), "
    "p AS (SELECT site_id, epoch, arg_max(node_id, node_id) AS node_id, arg_max(area_m2, node_id) AS area_m2 FROM h GROUP BY 1, 2), "
    "l AS (SELECT *, lag(epoch) OVER w AS be, lag(node_id) OVER w AS bn, lag(area_m2) OVER w AS ba FROM p WINDOW w AS (PARTITION BY site_id ORDER BY epoch)) "
    "SELECT h.node_id, h.site_id, h.epoch, be AS baseline_epoch, bn AS baseline_id, ba AS baseline_area_m2 FROM h JOIN l USING (site_id, epoch)"))
def _(spark, d):
    h = table(spark, d, "orders").selectExpr(
        "o_custkey AS site_id", "CAST(o_orderdate AS DATE) AS epoch", "concat('n', CAST(o_orderkey AS STRING)) AS node_id", "o_totalprice AS area_m2"
    )
    return stream.latest_baseline(h, h).drop("area_m2")


@check("x3_epoch_ingestion", with_ctes(*DELTA, select=(
    "SELECT 'EMERGED' AS status, node_id FROM added UNION ALL SELECT 'REMOVED', node_id FROM removed UNION ALL "
    "SELECT 'MODIFIED', old_id FROM modified")))
def _(spark, d):
    root = f"{work_dir(spark)}/ingest-{uuid.uuid4().hex}"
    # The first epoch comes in two batches of its own, its last part together with the second epoch.
    first, second = nodes_t1(spark, d), nodes_t2(spark, d)
    part = F.pmod(F.xxhash64("node_id"), F.lit(3))
    for nodes in (first.filter(part == 0), first.filter(part == 1), first.filter(part == 2).unionByName(second)):
        nodes.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(nodes.schema).parquet(f"{root}/in")
        stream.ingest_epochs(source, f"{root}/base", f"{root}/delta", LAT0, LON0, f"{root}/checkpoint").awaitTermination()
    delta = spark.read.parquet(f"{root}/delta").filter(F.col("delta_epoch") == F.lit(T2_EPOCH).cast("date"))
    return delta.select("status", "node_id")
