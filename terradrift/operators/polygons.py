"""Outlines of labelled components as ring-vertex tables and MultiPolygon values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradrift.functions import geo
from terradrift.operators.components import label_components
from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE
from terradrift.session import save_table

# Unit sides run clockwise (rows grow downwards): east, south, west, north.
_STEP_X = (1, 0, -1, 0)
_STEP_Y = (0, 1, 0, -1)
_START = ((0, 0), (1, 0), (1, 1), (0, 1))
_NEIGHBOUR = ((-1, 0), (0, 1), (1, 0), (0, -1))
RING_SCHEMA = f"{SCENE} string, label long, ring long, seq long, x int, y int"
# Sides of one component that are chained in memory; longer outlines are chained by joins.
SMALL_OUTLINE = 2_000_000


def boundary_sides(labelled: DataFrame) -> DataFrame:
    """Unit pixel sides whose outer neighbour is not in the mask, as directed steps."""
    options = F.array(
        *[
            F.struct(
                F.lit(d).alias("d"), (F.col("row") + dr).alias("nr"), (F.col("col") + dc).alias("nc"),
                (F.col("col") + ox).alias("x"), (F.col("row") + oy).alias("y"),
            )
            for d, ((dr, dc), (ox, oy)) in enumerate(zip(_NEIGHBOUR, _START))
        ]
    )
    sides = labelled.select(SCENE, "label", F.explode(options).alias("s")).select(SCENE, "label", "s.*")
    inside = labelled.select(SCENE, F.col("row").alias("nr"), F.col("col").alias("nc"))
    return sides.join(inside, [SCENE, "nr", "nc"], "left_anti").select(SCENE, "label", "x", "y", "d")


def _trace(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain the sides of one component into rings, turning right where two rings touch."""
    x, y, d = (pdf[k].to_numpy(np.int64) for k in ("x", "y", "d"))
    width = x.max() + 2
    key = ((y + 1) * width + x + 1) * 4 + d
    order = np.argsort(key)
    x, y, d, key = x[order], y[order], d[order], key[order]
    end = (y + 1 + np.take(_STEP_Y, d)) * width + x + 1 + np.take(_STEP_X, d)
    nxt = np.full(len(key), -1)
    for turn in (1, 0, 3):
        want = end * 4 + (d + turn) % 4
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = (nxt < 0) & (key[at] == want)
        nxt[hit] = at[hit]
    # Doubling: smallest member of the cycle, then steps from that member.
    head, jump = np.arange(len(key)), nxt.copy()
    for _ in range(int(np.ceil(np.log2(len(key)))) + 1):
        head, jump = np.minimum(head, head[jump]), jump[jump]
    stop = nxt == head
    left, jump = np.where(stop, 0, 1), np.where(stop, np.arange(len(key)), nxt)
    for _ in range(int(np.ceil(np.log2(len(key)))) + 1):
        left, jump = left + left[jump], jump[jump]
    seq = left[head] - left
    before = np.empty_like(nxt)
    before[nxt] = np.arange(len(key))
    corner = d[before] != d
    out = pd.DataFrame({"ring": key[head], "seq": seq, "x": x, "y": y})[corner]
    return out.assign(**{SCENE: pdf[SCENE].iloc[0], "label": pdf["label"].iloc[0]})[
        [SCENE, "label", "ring", "seq", "x", "y"]
    ].astype({"x": "int32", "y": "int32"})


def _chain_by_joins(sides: DataFrame) -> DataFrame:
    """The same rings for outlines of any length, by pointer doubling over written tables."""
    keys = [SCENE, "label"]
    ident = F.struct("y", "x", "d")
    d = F.col("d")
    step_x = F.element_at(F.array(*map(F.lit, _STEP_X)), d + 1)
    step_y = F.element_at(F.array(*map(F.lit, _STEP_Y)), d + 1)
    tail = sides.select(*keys, ident.alias("id"), "d", (F.col("x") + step_x).alias("x"), (F.col("y") + step_y).alias("y"))
    turn = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(3), F.lit(2)), (F.col("d2") - d + 4) % 4 + 1)
    after = sides.select(*keys, "x", "y", F.col("d").alias("d2"))
    nexts = (
        tail.join(after, [*keys, "x", "y"])
        .groupBy(*keys, "id")
        .agg(F.min_by(F.struct("y", "x", F.col("d2").alias("d")), turn).alias("next"))
    )
    links = save_table(nexts, "sides")

    def double(table: DataFrame, value: str, combine) -> DataFrame:
        """Follow jumps until no value changes; ``combine`` folds in the value jumped to."""
        while True:
            there = table.select(*keys, F.col("id").alias("jump"), F.col(value).alias("_v"), F.col("jump").alias("_j"))
            new = combine(F.col(value), F.col("_v"))
            step = table.join(there, [*keys, "jump"]).select(
                *keys, "id", new.alias(value), F.col("_j").alias("jump"), (new != F.col(value)).alias("moved")
            )
            step = save_table(step, "sides")
            if step.filter("moved").isEmpty():
                return step.drop("moved")
            table = step.drop("moved")

    start = links.select(*keys, "id", F.least("id", "next").alias("head"), F.col("next").alias("jump"))
    heads = double(start, "head", F.least).drop("jump")
    tied = links.join(heads, [*keys, "id"])
    stop = F.col("next") == F.col("head")
    first = tied.select(
        *keys, "id", F.when(stop, 0).otherwise(1).cast("long").alias("left"),
        F.when(stop, F.col("id")).otherwise(F.col("next")).alias("jump"),
    )
    left = double(first, "left", lambda a, b: a + b).drop("jump")
    ranked = tied.join(left, [*keys, "id"])
    total = left.select(*keys, F.col("id").alias("head"), F.col("left").alias("total"))
    before = links.select(*keys, F.col("next").alias("id"), F.col("id.d").alias("d_before"))
    rows = ranked.join(total, [*keys, "head"]).join(before, [*keys, "id"]).filter(F.col("d_before") != F.col("id.d"))
    widths = sides.groupBy(*keys).agg((F.max("x") + 2).cast("long").alias("w"))
    ring = ((F.col("head.y") + 1) * F.col("w") + F.col("head.x") + 1) * 4 + F.col("head.d")
    return rows.join(widths, keys).select(
        *keys, ring.alias("ring"), (F.col("total") - F.col("left")).alias("seq"),
        F.col("id.x").alias("x"), F.col("id.y").alias("y"),
    )


def ring_vertices(labelled: DataFrame, small_limit: int = SMALL_OUTLINE) -> DataFrame:
    """Corner points of every ring: ``(scene_id, label, ring, seq, x, y)`` in pixel corners.

    Components are separated by outline length: short ones take one grouped pass, and
    outlines too long for a task are chained by joins.
    """
    sides = save_table(boundary_sides(labelled), "outline")
    sizes = save_table(sides.groupBy(SCENE, "label").agg(F.count("*").alias("n")), "outline-size")
    long = sizes.filter(F.col("n") > small_limit).select(SCENE, "label")
    if long.isEmpty():
        return sides.groupBy(SCENE, "label").applyInPandas(_trace, RING_SCHEMA)
    short = sides.join(long, [SCENE, "label"], "left_anti").groupBy(SCENE, "label").applyInPandas(_trace, RING_SCHEMA)
    return short.unionByName(_chain_by_joins(sides.join(long, [SCENE, "label"], "left_semi")))


def _signed_area(points: Column) -> Column:
    closing = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, 1, 1))
    cross = F.zip_with(
        points, closing, lambda p, n: p["x"].cast("double") * n["y"] - n["x"].cast("double") * p["y"]
    )
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2


def rings(vertices: DataFrame) -> DataFrame:
    """One row per ring: ordered corners, signed pixel area (holes are negative) and point count."""
    points = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    return (
        vertices.groupBy(SCENE, "label", "ring")
        .agg(points.alias("points"))
        .withColumn("area_px", _signed_area(F.col("points")))
        .withColumn("n_points", F.size("points"))
    )


def _with_part(ring_rows: DataFrame, labelled: DataFrame, tile: int) -> DataFrame:
    """Add the 4-connected part each ring borders.

    A ring starts at its top-left corner: for an outer ring that corner's own pixel belongs
    to the part, for a hole it is the pixel above.
    """
    mask = labelled.select(SCENE, "row", "col")
    parts = label_components(mask, tile, connectivity=4).withColumnRenamed("label", "part")
    start = F.col("points")[0]
    row = F.when(F.col("area_px") > 0, start["y"]).otherwise(start["y"] - 1)
    return ring_rows.withColumns({"row": row, "col": start["x"]}).join(parts, [SCENE, "row", "col"]).drop("row", "col")


def multipolygons(vertices: DataFrame, labelled: DataFrame, scene: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """``geometry`` per component: polygons of an outer ring and its holes, as closed lon/lat rings.

    Every ring borders exactly one 4-connected part and every part has one outer ring, so
    holes find their polygon by an equi-join and not by containment tests.
    """
    flat = _with_part(rings(vertices), labelled, tile).join(scene.select(SCENE, "affine"), SCENE)
    lonlat = F.transform(
        F.concat("points", F.slice("points", 1, 1)),
        lambda p: F.array(
            F.round(geo.pixel_to_lon("affine", p["x"], p["y"]), 9), F.round(geo.pixel_to_lat("affine", p["x"], p["y"]), 9)
        ),
    )
    shaped = flat.select(SCENE, "label", "part", F.struct((F.col("area_px") < 0).alias("hole"), "ring", lonlat.alias("path")).alias("r"))

    def listed(column: str, field: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(column)), lambda x: x[field])

    polygons = shaped.groupBy(SCENE, "label", "part").agg(listed("r", "path").alias("rings"))
    return polygons.withColumn("p", F.struct("part", "rings")).groupBy(SCENE, "label").agg(listed("p", "rings").alias("geometry"))


def row_runs(labelled: DataFrame) -> DataFrame:
    """Compact geometry: horizontal runs of pixels per component (gaps and islands).

    Islands are found inside fixed column blocks first, so no sort covers more than a block,
    and runs that continue across a block border are then joined per row.
    """
    block = F.floor(F.col("col") / 4096).cast("int")
    order = W.partitionBy(SCENE, "row", "block").orderBy("col")
    island = F.col("col") - F.row_number().over(order)
    pieces = (
        labelled.select(*PIXEL_KEYS, "label", block.alias("block"))
        .withColumn("island", island)
        .groupBy(SCENE, "row", "block", "label", "island")
        .agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    )
    along = W.partitionBy(SCENE, "row").orderBy("c0")
    fresh = F.coalesce((F.lag("c1").over(along) + 1 != F.col("c0")).cast("int"), F.lit(1))
    return (
        pieces.withColumn("run", F.sum(fresh).over(along))
        .groupBy(SCENE, "label", "row", "run")
        .agg(F.min("c0").alias("col_start"), F.max("c1").alias("col_end"))
        .drop("run")
    )
