"""Connected components of pixel masks, in two levels: inside tiles, then across tile seams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradrift.operators.linking import connected_components
from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE, TILE_KEYS, shuffled, with_tile
from terradrift.session import save_table

# Neighbours that come later in row-major order, so that each touching pair is met once.
FORWARD = {8: ((0, 1), (1, -1), (1, 0), (1, 1)), 4: ((0, 1), (1, 0))}
_ROW_SHIFT = 32


def pixel_label(row: Column, col: Column) -> Column:
    """Row-major position as one number, independent of the raster width."""
    return F.shiftleft(row.cast("long"), _ROW_SHIFT) + col.cast("long")


def label_row(label: str = "label") -> Column:
    return F.shiftright(F.col(label), _ROW_SHIFT).cast("int")


def label_col(label: str = "label") -> Column:
    return F.col(label).bitwiseAND((1 << _ROW_SHIFT) - 1).cast("int")


def smallest_reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For items 0..n-1 joined by pairs (u, v), the smallest item of each one's group."""
    root = np.arange(n)
    while u.size:
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        open_pairs = root[u] != root[v]
        u, v = u[open_pairs], v[open_pairs]
    return root


def label_roots(r: np.ndarray, c: np.ndarray, connectivity: int) -> np.ndarray:
    """Per pixel of a tile, the index of the first one of its component; pixels come in row-major order."""
    if not len(r):
        return np.zeros(0, np.int64)
    top, left = r.min(), c.min()
    index = np.full((r.max() - top + 2, c.max() - left + 3), -1, np.int64)
    here = np.arange(len(r))
    index[r - top, c - left + 1] = here
    starts, ends = [], []
    for dr, dc in FORWARD[connectivity]:
        there = index[r - top + dr, c - left + 1 + dc]
        starts.append(here[there >= 0])
        ends.append(there[there >= 0])
    return smallest_reachable(len(r), np.concatenate(starts), np.concatenate(ends))


def _label_tile(pdf: pd.DataFrame, connectivity: int) -> pd.DataFrame:
    """Component label of every mask pixel of one tile: the smallest row-major position."""
    pdf = pdf.sort_values(["row", "col"], ignore_index=True)
    r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
    root = label_roots(r, c, connectivity)
    pdf["label"] = (r[root] << _ROW_SHIFT) + c[root]
    return pdf


def _seam_pairs(local: DataFrame, tile: int, connectivity: int) -> DataFrame:
    """Pairs of local labels that touch across a tile border."""
    r, c = F.col("row") % tile, F.col("col") % tile
    rim = local.filter((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)).select(*PIXEL_KEYS, "label")
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in FORWARD[connectivity]])
    probes = (
        rim.select(SCENE, F.col("label").alias("a"), "row", "col", F.explode(steps).alias("s"))
        .select(SCENE, "a", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    )
    return (
        probes.join(shuffled(rim.withColumnRenamed("label", "b")), PIXEL_KEYS)
        .filter("a <> b")
        .select(SCENE, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )


def merge_labels(local: DataFrame, tile: int, connectivity: int) -> DataFrame | None:
    """``(scene_id, label, root)`` of tile labels that meet across seams, None if none do. ``local`` holds the border pixels at least."""
    seams = save_table(_seam_pairs(local, tile, connectivity), "seams")
    if seams.isEmpty():
        return None
    return connected_components(seams, "u", "v", by=[SCENE]).withColumnRenamed("id", "label")


def label_components(
    mask: DataFrame, tile: int = DEFAULT_TILE, connectivity: int = 8
) -> DataFrame:
    """Add ``label``, the component of each row of a mask table, joining all 8 (or only 4) neighbours.

    ``mask`` holds only set pixels (``scene_id, row, col`` and any further columns). The
    label is the smallest row-major position in the component, so it does not depend on
    tile size or partitioning. Per-tile work is bounded by the tile; the cross-tile graph
    has one node per component piece that touches a tile border.
    """
    tiled = with_tile(mask, tile)
    schema = T.StructType(tiled.schema.fields + [T.StructField("label", T.LongType())])

    def label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        return _label_tile(pdf, connectivity)

    local = save_table(tiled.groupBy(*TILE_KEYS).applyInPandas(label_tile, schema).drop("tile_r", "tile_c"), "labels")
    roots = merge_labels(local, tile, connectivity)
    if roots is None:
        return local
    return (
        local.join(shuffled(roots), [SCENE, "label"], "left")
        .withColumn("label", F.coalesce("root", "label"))
        .drop("root")
        .select(*mask.columns, "label")
    )


def component_stats(labelled: DataFrame) -> DataFrame:
    """Pixel count, box and mean pixel index per component."""
    return labelled.groupBy(SCENE, "label").agg(
        F.count("*").alias("n_pixels"),
        F.min("row").alias("top"),
        F.min("col").alias("left"),
        (F.max("row") - F.min("row") + 1).alias("height"),
        (F.max("col") - F.min("col") + 1).alias("width"),
        F.avg("row").alias("mean_row"),
        F.avg("col").alias("mean_col"),
    )


def component_score(labelled: DataFrame, value: str = "prob") -> DataFrame:
    """Mean score per component, 4 decimals, within [0, 1]."""
    mean = F.least(F.greatest(F.bround(F.avg(value), 4), F.lit(0.0)), F.lit(1.0))
    return labelled.groupBy(SCENE, "label").agg(mean.alias("confidence"))
