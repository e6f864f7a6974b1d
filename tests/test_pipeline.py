import json
from urllib.parse import unquote, urlparse

import numpy as np
import pytest
from helpers import pixel_frame, scene_frame
from pyspark.sql import functions as F

from terradrift.functions import text
from terradrift.functions.registry import register_sql_functions
from terradrift.operators import guards, vectors
from terradrift.plans import features, pipeline, report
from terradrift.session import save_table
from terradrift.sources import geojson, tables
from terradrift.streaming import detections as stream


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id long, query_text string")


@pytest.mark.parametrize("query,gsd,status,term", [
    ("find a vehicle here", 10, "REJECTED_SUB_NYQUIST", "vehicle"),
    ("an individual vehicle", 10, "REJECTED_SUB_NYQUIST", "individual vehicle"),
    ("a Single Tree", 10, "REJECTED_SUB_NYQUIST", "single tree"),
    ("new runway extension", 10, "OK", "runway extension"),
    ("perimeter revetment", 10, "OK", "perimeter revetment"),
    ("runway with a vehicle", 10, "REJECTED_SUB_NYQUIST", "vehicle"),
    ("scary cartoon", 10, "OK", None),
    ("vehicle", 0.5, "OK", "vehicle"),
    ("anti-tank ditch", 10, "REJECTED_SUB_NYQUIST", "tank"),
    ("road  grading", 10, "OK", None),
])
def test_resolution_guard(spark, query, gsd, status, term):
    r = guards.resolution_status(asks(spark, query), guards.catalogue(spark), gsd).first()
    assert (r.status, r.term) == (status, term)


def test_resolution_guard_reads_whole_texts(spark):
    long = "filler words " * 20000 + "then a hangar"
    assert guards.resolution_status(asks(spark, long), guards.catalogue(spark)).first().term == "hangar"


def test_longest_term_wins_and_ties_follow_the_catalogue(spark):
    terms = guards.catalogue(spark, [("abc", 1.0), ("xyz", 2.0), ("abc xyz", 3.0), ("c++ lab", 4.0)])
    got = {r.request_id: r.term for r in guards.catalogue_matches(asks(spark, "xyz abc", "abc xyz", "the c++ lab"), terms).collect()}
    assert got == {0: "abc", 1: "abc xyz", 2: "c++ lab"}


def test_texts_are_searched_where_they_lie(spark):
    """Neither texts nor runs of their words travel; a text meets the catalogue in one pass."""
    found = guards.catalogue_matches(asks(spark, "a tank"), guards.catalogue(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" not in plan and "Generate" not in plan


def test_terms_stand_as_whole_words_in_any_script(spark):
    terms = guards.catalogue(spark, [("fob", 1.0), ("straße", 2.0), ("c++", 3.0), ("road (new)", 4.0), ("...", 5.0)])
    texts = ["éfob", "fob-é", "fob_1 FOB", "ALTE STRAßE!", "straßen", "c++ c", "c++x", "a road (new)s", "...", None]
    got = {r.request_id: r.term for r in guards.catalogue_matches(asks(spark, *texts), terms).collect()}
    assert got == {1: "fob", 2: "fob", 3: "straße", 6: "c++", 7: "road (new)"}


def request(spark, **over):
    base = dict(request_id="r", scene_id="a", query_text="runway extension", min_lat=24.991, max_lat=24.9995, min_lon=75.0005,
                max_lon=75.009, tau=0.6, cloud_percent=35.0, t1="2024", t2="2025")
    return spark.createDataFrame([{**base, **over}], "request_id string, scene_id string, query_text string, min_lat double, "
                                 "max_lat double, min_lon double, max_lon double, tau double, cloud_percent double, t1 string, t2 string")


@pytest.mark.parametrize("over,problem", [
    ({}, None), ({"query_text": "ab"}, "query_text length"), ({"query_text": "?!?!"}, "query_text noise"),
    ({"max_lat": 91.0}, "latitude range"), ({"min_lon": -181.0}, "longitude range"), ({"max_lat": 24.0}, "bounds order"),
    ({"tau": 0.2}, "tau range"), ({"cloud_percent": 60.0}, "cloud range"), ({"tau": None}, None),
])
def test_request_rules(spark, over, problem):
    assert guards.validate_requests(request(spark, **over)).first().problem == problem


def epochs(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(800, 1200, (100, 100)).astype(float)
    base = base + np.add.outer(np.arange(100), np.arange(100)) * 12.0
    later = base.copy()
    later[30:50, 40:60] += 1200
    make = lambda a: pixel_frame(spark, {f"b{i}": a + i for i in (1, 2, 3)})
    return save_table(make(base), "t1"), save_table(make(later), "t2")


def test_analyze_runs_requests_and_requery_reads_saved_scores(spark, tmp_path):
    t1, t2 = epochs(spark)
    scene = scene_frame(spark, 100, 100)
    reqs = (
        request(spark)
        .unionByName(request(spark, request_id="small", query_text="one vehicle"))
        .unionByName(request(spark, request_id="bad", tau=2.0))
        .unionByName(request(spark, request_id="out", min_lat=10.0, max_lat=11.0))
        .unionByName(request(spark, request_id="cloudy", cloud_percent=5.0, min_lon=75.0))
    )
    mask = t1.select("scene_id", "row", "col", (F.col("col") < 8).cast("int").alias("mask"))
    run = pipeline.analyze(reqs, t1, t2, scene, guards.catalogue(spark), cloud_mask=mask)
    status = {r.request_id: r.status for r in run.status.collect()}
    assert status == {"r": "COMPLETED", "small": "REJECTED_SUB_NYQUIST", "bad": "REJECTED_INVALID_REQUEST",
                      "out": "REJECTED_NO_COVERAGE", "cloudy": "REJECTED_CLOUD_COVER"}
    (found,) = run.detections.collect()
    assert found["class"] == "runway extension" and abs(found.n_pixels - 400) < 60
    summary = {r.request_id: r for r in run.summary.collect()}
    assert summary["r"].n_features == 1 and summary["small"].n_features == 0
    path = str(tmp_path / "scores")
    pipeline.save_scores(run, reqs, path)
    key = reqs.filter("request_id = 'r'").select(text.cache_key(F.concat_ws(",", *pipeline.REQUEST_BOX), "t1", "t2")).first()[0]
    again = pipeline.requery(spark, path, key, 0.6, "second look").collect()
    assert [(f.area_sq_m, f["class"]) for f in again] == [(found.area_sq_m, "second look")]
    pipeline.save_scores(run, reqs, path)  # a second save replaces the first
    assert [f.area_sq_m for f in pipeline.requery(spark, path, key, 0.6, "third look").collect()] == [found.area_sq_m]
    with pytest.raises(KeyError):
        pipeline.requery(spark, path, "missing", 0.6, "x")


def test_analyze_rejects_epochs_of_different_shape(spark):
    t1, t2 = epochs(spark)
    holed = t2.filter("NOT (row = 50 AND col = 50)")
    run = pipeline.analyze(request(spark), t1, holed, scene_frame(spark, 100, 100), guards.catalogue(spark))
    assert [r.status for r in run.status.collect()] == ["REJECTED_SHAPE_MISMATCH"] and run.detections.isEmpty()


def test_sweep_equals_single_thresholds(spark):
    rng = np.random.default_rng(3)
    prob = np.kron(rng.random((12, 12)), np.ones((5, 5)))
    px, scene = pixel_frame(spark, {"prob": prob}), scene_frame(spark, 60, 60)
    got = {r.tau: r.n_features for r in pipeline.sweep(px, scene, [0.4, 0.8, 1.0]).collect()}
    assert got == {t: features.extract_features(px, scene, t).count() for t in (0.4, 0.8, 1.0)}


def test_screening_scores_only_boxes(spark):
    t1, t2 = epochs(spark)
    scene = scene_frame(spark, 100, 100)
    hits = spark.createDataFrame([(24.996, 75.005), (10.0, 10.0)], "lat double, lon double")
    found = pipeline.screened_features(hits, t1, t2, scene, 25.0, padding_m=400.0).collect()
    assert len(found) == 1 and found[0].scene_id == "a"


def sample_features(spark):
    rows = [("t", f"{i:064x}", "site", 0.5 + i / 100, 100.0 * i, 0.01 * i, (25.0, 75.0), "43R", [[[[75.0, 25.0], [75.1, 25.0], [75.0, 25.1], [75.0, 25.0]]]])
            for i in range(1, 21)]
    return spark.createDataFrame(rows, "task_id string, feature_id string, class string, confidence double, area_sq_m double, "
                                 "area_hectares double, centroid struct<lat: double, lon: double>, grid_ref string, "
                                 "geometry array<array<array<array<double>>>>")


def test_report_shows_fifteen_and_a_dash_row(spark):
    runs = spark.createDataFrame([("t",), ("none",)], "task_id string")
    rows = report.target_table(sample_features(spark), runs).collect()
    mine = sorted((r.position, r) for r in rows if r.task_id == "t")
    assert len(mine) == 15 and mine[0][1].area_m2 == "2,000" and mine[0][1].confidence == "70.0%"
    (blank,) = [r for r in rows if r.task_id == "none"]
    assert blank["class"] == report.EMPTY_TEXT and blank.area_ha == "0.000"


def test_manifest_is_repeatable_and_detects_tampering(spark):
    feats = sample_features(spark)
    runs = spark.createDataFrame([("t", "ops", "aa", "bb")], "task_id string, analyst string, t1_sha256 string, t2_sha256 string")
    m = report.evidence_manifest(runs, feats, "2025-01-01T00:00:00Z")
    assert m.first() == report.evidence_manifest(runs, feats.repartition(7), "2025-01-01T00:00:00Z").first()
    assert report.verify_manifest(m, runs, feats).first().verified
    changed = feats.withColumn("area_sq_m", F.when(F.col("area_sq_m") == 100, 101.0).otherwise(F.col("area_sq_m")))
    assert not report.verify_manifest(m, runs, changed).first().verified


def test_file_digest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert report.file_digests(spark, str(tmp_path / "x.bin")).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_exports_round_trip(spark, tmp_path):
    feats = sample_features(spark)
    geojson.write_feature_lines(feats, str(tmp_path / "out"), task_id="t")
    back = geojson.read_feature_lines(spark, str(tmp_path / "out"))
    nodes = geojson.nodes_from_features(back, "2025-01-15")
    assert nodes.count() == 20 and nodes.filter("properties['task_id'] = 't'").count() == 20
    tables.persist_run(feats.withColumn("epoch", F.lit("2025-01-15").cast("date")),
                       tables.audit_row(feats, spark.createDataFrame([("t", "q")], "task_id string, prompt string")), str(tmp_path / "store"))
    audit = spark.read.parquet(str(tmp_path / "store" / "audit_logs")).first()
    assert (audit.polygons_detected, audit.total_area_sq_m) == (20, 21000.0)


def test_collections_are_documents_cut_into_ordered_parts(spark, tmp_path):
    feats = sample_features(spark)
    other = feats.withColumn("task_id", F.lit("u/2")).withColumn("class", F.lit('line\nbreak "quoted", [x]'))
    both = feats.unionByName(other).unionByName(feats.limit(3))
    path = tmp_path / "tasks"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many parts although there are few rows
    try:
        for rows in (feats.withColumn("task_id", F.lit("old")), both):
            manifest = geojson.write_collections(rows.repartition(5), str(path), "task_id", "t9")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    listed = {}
    for r in manifest.orderBy("task_id", "part_no").collect():
        listed.setdefault(r.task_id, []).append((r.file, r.n_features))
    assert set(listed) == {"t", "u/2"} and all(sum(n for _, n in files) == 20 for files in listed.values())
    assert max(map(len, listed.values())) > 1
    for task, files in listed.items():
        names = [unquote(urlparse(f).path) for f, _ in files]
        found = json.loads("".join(open(n).read() for n in sorted(names)))
        ids = [f["properties"]["feature_id"] for f in found["features"]]
        assert found["name"] == "changes_t9" and ids == sorted(ids) and len(set(ids)) == 20 and names == sorted(names)
        want = {r.feature_id: json.loads(r.feature) for r in geojson.feature_json(both.filter(F.col("task_id") == task), "t9").collect()}
        assert {f["properties"]["feature_id"]: f for f in found["features"]} == want
    assert geojson.write_collections(feats.limit(0), str(tmp_path / "none"), "task_id").count() == 0
    with pytest.raises(ValueError, match="task_id"):
        geojson.write_collections(feats.withColumn("task_id", F.lit("")), str(tmp_path / "bad"), "task_id")


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "paved runway near road"), (2, "cloud shadow"), (3, "  "), (4, None)], "id long, t string")
    v = {r.id: np.array(r.vector) for r in vectors.embed_text(docs, "id", "t", 64).collect()}
    assert all(np.linalg.norm(x) == pytest.approx(1) for x in v.values())
    assert v[3][0] == 1.0 and v[4][0] == 1.0
    row = spark.createDataFrame([(v[1].tolist(), v[2].tolist(), None)], "p array<double>, n array<double>, z array<double>")
    moved, plain, same = row.select(vectors.condition("p", "n"), vectors.condition("p", "z"), vectors.condition("p", "p", 1.0)).first()
    assert np.dot(moved, v[2]) < np.dot(v[1], v[2]) and np.linalg.norm(moved) == pytest.approx(1)
    assert np.allclose(plain, v[1]) and np.allclose(same, v[1])


def test_anchors_share_a_place(spark):
    docs = spark.createDataFrame([(1, "airfield"), (2, "airstrip")], "id long, t string")
    a, b = (r.vector for r in vectors.embed_text(docs, "id", "t", 64, {"airfield": "air", "airstrip": "air"}).collect())
    assert a == b


def test_top_similar_matches_numpy(spark):
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(7, 8)), rng.normal(size=(300, 8))
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query_vec array<double>")
    xs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, item_vec array<double>")
    got = {(r.query_id, r["rank"]): r.item_id for r in vectors.top_similar(qs, xs, 4).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    order = np.argsort(-(unit(q) @ unit(x).T), axis=1)
    assert got == {(i, k + 1): order[i, k] for i in range(7) for k in range(4)}


def test_sql_functions(spark):
    assert "haversine_m" in register_sql_functions(spark)
    d = spark.sql("SELECT haversine_m(0D, 0D, 0D, 1D), hectares(12345D), cell_area_m2(-90D, 90D, 360D)").first()
    assert d[0] == pytest.approx(111194.93, abs=0.1) and d[1] == 1.2345 and d[2] == pytest.approx(5.10065622e14, rel=1e-8)


def test_sql_grid_references_and_rings_equal_the_columns(spark):
    from pyspark.sql import functions as F

    from terradrift.functions.geo import ring_area_m2
    from terradrift.functions.gridref import format_grid_ref, with_grid_ref

    register_sql_functions(spark)
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300))] + [(60.0, 5.0), (78.0, 20.0), (25.0, 75.0), (-79.9, 179.99)]
    points = with_grid_ref(spark.createDataFrame(rows, "lat double, lon double"), "lat", "lon")
    assert points.filter(F.expr("grid_ref(lat, lon)") != F.col("grid_ref")).count() == 0
    ring = F.array(*[F.array(F.col("lon") + x, F.col("lat") + y) for x, y in ((0.0, 0.0), (0.1, 0.0), (0.05, 0.2), (0.0, 0.0))])
    rings = points.filter("lat BETWEEN -80 AND 80").withColumn("ring", ring)
    assert rings.filter(F.abs(F.expr("ring_area_m2(ring)") / ring_area_m2("ring") - 1) > 1e-9).count() == 0
    refs = spark.createDataFrame([("43RBK1234567890",), (" 4RBK12345 67890 ",), ("short",)], "ref string")
    assert refs.filter(F.expr("format_grid_ref(ref)") != format_grid_ref("ref")).count() == 0


def test_stream_drops_late_rows_and_repeats(spark, tmp_path):
    schema = "feature_id string, ts timestamp, class string, lat double, lon double, area_sq_m double"
    source = str(tmp_path / "in")

    def feed(rows):
        spark.createDataFrame(rows, "feature_id string, ts string, class string, lat double, lon double, area_sq_m double").withColumn(
            "ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        det = stream.first_sightings(spark.readStream.schema(schema).parquet(source))
        q = det.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    feed([("a", "2024-01-01 00:10:00", "Road", 25.0, 75.0, 5.0), ("a", "2024-01-01 00:20:00", "Road", 25.0, 75.0, 5.0)])
    feed([("b", "2024-01-01 09:00:00", "Road", 25.0, 75.0, 7.0), ("a", "2024-01-01 00:25:00", "Road", 25.0, 75.0, 5.0)])
    feed([("late", "2024-01-01 01:00:00", "Road", 25.0, 75.0, 9.0)])
    assert sorted(r.feature_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_latest_baseline_is_strictly_earlier(spark):
    h = spark.createDataFrame([("s", "2024-01-01", "a", 1.0), ("s", "2024-03-01", "b", 2.0), ("s", "2024-03-01", "c", 3.0), ("u", "2024-01-01", "d", 4.0)],
                              "site_id string, epoch string, node_id string, area_m2 double").withColumn("epoch", F.col("epoch").cast("date"))
    got = {r.node_id: r.baseline_id for r in stream.latest_baseline(h, h).collect()}
    assert got == {"a": None, "b": "a", "c": "a", "d": None}


def test_altered_area_does_not_depend_on_the_order_of_features(spark):
    """These areas add up to 30036.45 in one order and to a little less in the other."""
    runs = spark.sql("SELECT 't' AS task_id, 's' AS scene_id, 'a' AS analyst, 'q' AS query_text, CAST(NULL AS STRING) AS negative_query, "
                     "DATE '2024-01-15' AS t1, DATE '2025-01-15' AS t2, 1D AS min_lat, 2D AS max_lat, 3D AS min_lon, 4D AS max_lon")
    shifts = spark.sql("SELECT 's' AS scene_id, 0.9D AS score")
    areas = [8714.34, 7892.25, 2826.84, 7740.78, 2862.24]
    shown = set()
    for order in (areas, areas[::-1]):
        found = spark.createDataFrame([("t", a) for a in order], "task_id string, area_sq_m double").coalesce(1)
        shown.add(report.run_metadata(runs, found, shifts).first()["altered_area"])
    assert len(shown) == 1
