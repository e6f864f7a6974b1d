"""Joins of tables that grow with the pixels shuffle both sides, however small the written files are."""

from pyspark.sql import functions as F

from terradrift.operators import align, components, raster
from terradrift.session import save_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _pixels(spark, *bands):
    grid = spark.range(400).select(F.lit("s").alias("scene_id"), (F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"),
                                   *[(F.col("id") * 7 % 50 + i).cast("double").alias(b) for i, b in enumerate(bands)])
    return save_table(grid, "pixels")


def test_pixels_of_two_epochs_are_not_broadcast(spark):
    px = _pixels(spark, "b1")
    assert "BroadcastHashJoin" not in _plan(raster.bitemporal(px, px, ["b1"]))


def test_source_pixels_of_a_warp_are_not_broadcast(spark):
    px = _pixels(spark, "b1")
    matrix = spark.range(1).selectExpr("'s' AS scene_id", "1D AS m00", "0D AS m01", "1D AS m02", "0D AS m10", "1D AS m11", "0D AS m12")
    dims = spark.range(1).selectExpr("'s' AS scene_id", "20 AS n_rows", "20 AS n_cols")
    assert _plan(align.warp(px, dims, matrix, ["b1"])).count("SortMergeJoin") == 1


def test_planes_of_an_alignment_are_not_broadcast(spark, monkeypatch):
    plans, save = {}, align.save_table
    monkeypatch.setattr(align, "save_table", lambda df, name: (plans.setdefault(name, []).append(_plan(df)), save(df, name))[1])
    align.pyramid_shift(_pixels(spark, "l1", "l2"), 4, tile=32)
    assert plans["shift-scores"] and all("SortMergeJoin" in p for p in plans["shift-scores"])


def test_labels_at_seams_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in _plan(components._seam_pairs(_pixels(spark, "label").withColumn("label", F.col("label").cast("long")), 8, 8))


def test_matches_are_not_broadcast(spark):
    from terradrift.operators import graph

    nodes = save_table(spark.range(50).selectExpr(
        "concat('n', id) AS node_id", "'Road' AS class", "24D + id * 0.01D AS lat", "75D AS lon", "100D + id AS area_m2", "0D AS min_lat",
        "0D AS min_lon", "0D AS max_lat", "0D AS max_lon"), "nodes")
    matches = save_table(graph.match_nodes(nodes, nodes, 24.0, 75.0), "matches")
    for found in (graph.added_nodes(nodes, matches), graph.removed_nodes(nodes, matches), graph.modified_nodes(nodes, nodes, matches)):
        assert "BroadcastHashJoin" not in _plan(found)


def test_calm_places_are_not_shuffled_to_drop_copies(spark, monkeypatch):
    """Only crowded cells need that; of places with several points the smallest id wins all the same."""
    from terradrift.operators import spatial_join

    saved, save = [], spatial_join.save_table
    monkeypatch.setattr(spatial_join, "save_table", lambda df, name, *a: (saved.append(name), save(df, name, *a))[1])
    points = spark.range(60).selectExpr("concat('p', id) AS old_id", "24D + (id % 20) * 0.01D AS lat", "75D AS lon")
    near = spatial_join.nearest_join(points.withColumnRenamed("old_id", "new_id"), points, 35.0, "new_id", "old_id")
    got = {r.new_id: r.old_id for r in near.collect()}
    assert saved == [] and got == {f"p{i}": min(f"p{j}" for j in range(i % 20, 60, 20)) for i in range(60)}
    near = spatial_join.nearest_join(points.withColumnRenamed("old_id", "new_id"), points, 35.0, "new_id", "old_id", hot_cell=2)
    assert {r.new_id: r.old_id for r in near.collect()} == got and "places" in saved
