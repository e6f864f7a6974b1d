"""Two-epoch differencing on tiles held as arrays: one shuffle of pixels, then one NumPy pass per tile and step.

A tile comes with the rim its neighbourhood steps need, so smoothing, scoring, opening and labelling run on arrays and no pixel
is sorted or shuffled again. Between the steps only per-scene ranges and 256-bin histograms are aggregated, and only labels at
tile seams are linked. Every step gives the rows of its pixel-table counterpart: gaps stay gaps, raster edges are mirrored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.functions.geo import WGS84_B, WGS84_E, WGS84_E2
from terradrift.operators import raster
from terradrift.operators.components import label_roots, merge_labels
from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE, TILE_KEYS, shuffled, with_halo
from terradrift.session import save_table

TILE_ROW = f"{SCENE} string, tile_r int, tile_c int"
#: A stored tile: position of its first pixel, the side of its square window, and the window's values (row-major) and presence bits.
STORED = f"{TILE_ROW}, top int, left int, side int, values array<double>, present binary, low double, high double"
PIECES = "array<struct<label: bigint, n_pixels: bigint, area: double, prob: double, mr: double, mc: double>>"
PIXELS = "array<struct<row: int, col: int, label: bigint, prob: double>>"
_LABEL_BITS = 32


# --- tiles from pixels ------------------------------------------------------------------------------


def _tile_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """``(scene, tile_r, tile_c)`` and the other columns as arrays, per tile of a stream sorted by tile."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        scene = batch.column(0).dictionary_encode()
        codes, names = scene.indices.to_numpy(), scene.dictionary.to_pylist()
        tr, tc = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1])])
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            mine = (names[codes[a]], int(tr[a]), int(tc[a]))
            if mine != key:
                if parts:
                    yield key, [np.concatenate(c) for c in zip(*parts)]
                key, parts = mine, []
            parts.append([c[a:b] for c in columns])
    if parts:
        yield key, [np.concatenate(c) for c in zip(*parts)]


def _mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Positions reflected about the edge pixels of a raster of ``size``, as often as it takes."""
    if size <= 1:
        return np.zeros_like(at)
    place = np.mod(at, 2 * size - 2)
    return np.minimum(place, 2 * size - 2 - place)


def _blur_axis(values: np.ndarray, present: np.ndarray, weights: Sequence[float], start: int, size: int, axis: int) -> np.ndarray:
    """Weighted mean along an axis of a window that starts at raster position ``start``; missing values have no say."""
    k = len(weights) // 2
    at = np.arange(start, start + values.shape[axis])
    total, some, weight = None, np.zeros_like(values), np.zeros_like(values)
    for d, w in zip(range(-k, k + 1), weights):
        source = _mirrored(at + d, size) - start
        inside = (source >= 0) & (source < len(at))
        seen = np.take(values, np.where(inside, source, 0), axis)
        known = np.take(present & ~np.isnan(values), np.where(inside, source, 0), axis)
        known &= inside[:, None] if axis == 0 else inside[None, :]
        part = np.where(known, w * seen, np.nan)
        total = part if total is None else total + part
        some = some + np.where(known, part, 0.0)
        weight = weight + np.where(known, w, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isnan(total), np.where(weight > 0, some / weight, np.nan), total)


def difference_tiles(
    t1: DataFrame, t2: DataFrame, dims: DataFrame, bands: Sequence[str], ksize: int = 5, halo: int = 2, tile: int = DEFAULT_TILE
) -> DataFrame:
    """Smoothed mean absolute band difference of pixels present in both epochs, one row per tile and a rim of ``halo`` pixels.

    Both epochs go through one shuffle; a tile's task holds at most ``(tile + 2 * (halo + ksize // 2))`` squared pixels of each.
    """
    smooth = ksize > 1 and ksize % 2 == 1
    weights = raster.blur_weights(ksize) if smooth else [1.0]
    reach, n_bands = halo + len(weights) // 2, len(bands)

    def side(px: DataFrame, epoch: int) -> DataFrame:
        return px.select(*PIXEL_KEYS, F.lit(epoch).alias("epoch"), *[F.col(b).cast("double").alias(b) for b in bands])

    sized = side(t1, 0).unionByName(side(t2, 1)).join(dims.select(SCENE, "n_rows", "n_cols"), SCENE)
    dealt = with_halo(sized, reach, tile).select(*TILE_KEYS, "row", "col", "epoch", "n_rows", "n_cols", *bands)
    ordered = dealt.sortWithinPartitions(*TILE_KEYS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (scene, tr, tc), (row, col, epoch, n_rows, n_cols, *values) in _tile_groups(batches):
            top, left, side = tr * tile - reach, tc * tile - reach, tile + 2 * reach
            seen = np.zeros((2, side, side), bool)
            seen[epoch, row - top, col - left] = True
            held = np.full((n_bands, 2, side, side), np.nan)
            for i, v in enumerate(values):
                held[i, epoch, row - top, col - left] = v
            present = seen[0] & seen[1]
            diff = reduce(lambda a, b: a + b, [np.abs(held[i, 1] - held[i, 0]) for i in range(n_bands)]) / n_bands
            if smooth:
                diff = _blur_axis(diff, present, weights, left, int(n_cols[0]), 1)
                diff = _blur_axis(diff, present, weights, top, int(n_rows[0]), 0)
            cut = slice(reach - halo, side - reach + halo)
            diff, present = np.where(present, diff, np.nan)[cut, cut], present[cut, cut]
            core = diff[halo : halo + tile, halo : halo + tile]
            if not present[halo : halo + tile, halo : halo + tile].any():
                continue
            known = core[~np.isnan(core)]
            yield pa.RecordBatch.from_pylist([{
                SCENE: scene, "tile_r": tr, "tile_c": tc, "top": top + reach - halo, "left": left + reach - halo, "side": tile + 2 * halo,
                "values": diff.ravel(), "present": np.packbits(present).tobytes(),
                "low": float(known.min()) if known.size else None, "high": float(known.max()) if known.size else None,
            }], schema=_STORED)

    return ordered.mapInArrow(build, STORED)


_STORED = pa.schema([
    (SCENE, pa.string()), ("tile_r", pa.int32()), ("tile_c", pa.int32()), ("top", pa.int32()), ("left", pa.int32()), ("side", pa.int32()),
    ("values", pa.list_(pa.float64())), ("present", pa.binary()), ("low", pa.float64()), ("high", pa.float64()),
])


# --- steps on stored tiles ------------------------------------------------------------------------


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Every stored tile as its scalar columns, its values and its presence mask."""
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("values", "present")]
        rows = batch.select(names).to_pylist()
        arrays, bits = batch.column("values"), batch.column("present")
        for i, row in enumerate(rows):
            side = row["side"]
            values = arrays[i].values.to_numpy(zero_copy_only=False).reshape(side, side)
            present = np.unpackbits(np.frombuffer(bits[i].as_buffer(), np.uint8), count=side * side).reshape(side, side).astype(bool)
            yield row, values, present


def _scaled(values: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """To [0, 1] by the scene's range; a constant scene becomes 0."""
    span = 0.0 if low is None else high - low
    return (values - low) / span if span > 0 else np.where(np.isnan(values), 0.0, 0.0 * values)


def _bins(norm: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(np.nan_to_num(norm) * 255.0, 0, 255)).astype(np.int64)


def scene_ranges(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy(SCENE).agg(F.min("low").alias("lo"), F.max("high").alias("hi"))


def tile_histogram(tiles: DataFrame, ranges: DataFrame, halo: int = 2) -> DataFrame:
    """Counts ``(scene_id, bin, n)`` of the scaled values of all tile cores; at most 256 rows per tile leave Python."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, values, _ in _stored(batches):
            core = values[halo : row["side"] - halo, halo : row["side"] - halo]
            n = np.bincount(_bins(_scaled(core[~np.isnan(core)], row["lo"], row["hi"])), minlength=256)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([row[SCENE]] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], [SCENE, "bin", "n"])

    counted = tiles.join(ranges, SCENE).mapInArrow(count, f"{SCENE} string, bin int, n bigint")
    return counted.groupBy(SCENE, "bin").agg(F.sum("n").alias("n"))


def _sliding(flags: np.ndarray, counts: np.ndarray, r: int, axis: int, pick: Callable, blank: int) -> np.ndarray:
    """Minimum or maximum of the counting flags within ``r`` along an axis."""
    padded = np.pad(np.where(counts, flags, blank), [(r, r) if a == axis else (0, 0) for a in (0, 1)], constant_values=blank)
    n = flags.shape[axis]
    return reduce(pick, [np.take(padded, np.arange(d, d + n), axis) for d in range(2 * r + 1)])


def opened(flags: np.ndarray, present: np.ndarray, kernel: int) -> np.ndarray:
    """Erosion, then dilation with a square kernel; absent pixels have no say. Right ``2 * (kernel // 2)`` inside the array's rim."""
    r = kernel // 2
    if r == 0:
        return flags
    for axis, pick, blank in ((1, np.minimum, 1), (0, np.minimum, 1), (0, np.maximum, 0), (1, np.maximum, 0)):
        flags = _sliding(flags, present, r, axis, pick, blank)
    return flags


def _zone(lat: np.ndarray) -> np.ndarray:
    s = np.sin(np.radians(lat))
    return s / (1 - WGS84_E2 * s * s) + np.arctanh(WGS84_E * s) / WGS84_E


def label_tiles(
    tiles: DataFrame, ranges: DataFrame, otsu: DataFrame, scene: DataFrame, tau: float, kernel: int = 3, halo: int = 2, pixels: bool = False
) -> DataFrame:
    """Change components of every tile: ``pieces`` with their sums and the ``rim`` pixels that may touch another tile.

    Scores pixels, keeps those of at least ``tau`` that survive the opening, and labels 8-connected groups inside the tile by
    their smallest row-major position. ``pixels`` adds every labelled pixel. Cell areas need ``affine`` in ``scene``.
    """
    affine = scene.select(SCENE, F.col("affine.a").alias("ax"), F.col("affine.d").alias("ad"), F.col("affine.e").alias("ae"), F.col("affine.f").alias("af"))
    known = tiles.join(ranges, SCENE).join(otsu, SCENE).join(affine, SCENE, "left")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, values, present in _stored(batches):
            t = tile["otsu_bin"] / 255.0
            norm = _scaled(values, tile["lo"], tile["hi"])
            lifted = (_bins(norm) > tile["otsu_bin"]) & ~np.isnan(norm)
            prob = np.where(lifted, np.fmax(norm, t), np.fmin(norm, t * 0.5))
            flags = opened((prob >= tau).astype(np.int8), present, kernel)
            cut = slice(halo, tile["side"] - halo)
            r, c = np.nonzero((flags == 1)[cut, cut] & present[cut, cut])
            p = prob[cut, cut][r, c]
            r, c = r + tile["top"] + halo, c + tile["left"] + halo
            root = label_roots(r, c, 8)
            names, group = np.unique(root, return_inverse=True)
            labels = (r[names] << _LABEL_BITS) + c[names]
            n = np.bincount(group, minlength=len(names))
            if tile["ae"] is None:
                cell = np.full(len(r), np.nan)
            else:
                # As the area of a latitude-longitude cell: exact on the ellipsoid.
                upper, lower = tile["ae"] * r + tile["af"], tile["ae"] * (r + 1) + tile["af"]
                cell = np.abs(np.radians(tile["ax"]) * (_zone(upper) - _zone(lower))) * (WGS84_B**2 / 2)
            sums = [np.bincount(group, w, minlength=len(names)).tolist() for w in (cell, p, r + 0.5, c + 0.5)]
            side = tile["side"] - 2 * halo
            edge = (r % side == 0) | (r % side == side - 1) | (c % side == 0) | (c % side == side - 1)
            every = labels[group]
            listed = edge | pixels
            yield pa.RecordBatch.from_arrays([
                pa.array([tile[SCENE]], pa.string()),
                pa.array([[dict(zip(("label", "n_pixels", "area", "prob", "mr", "mc"), x)) for x in zip(labels.tolist(), n.tolist(), *sums)]], _PIECES),
                pa.array([[dict(zip(("row", "col", "label", "prob"), x)) for x in zip(r[listed].tolist(), c[listed].tolist(), every[listed].tolist(), p[listed].tolist())]], _PIXELS),
            ], [SCENE, "pieces", "pixels"])

    return known.mapInArrow(label, f"{SCENE} string, pieces {PIECES}, pixels {PIXELS}")


_PIECES = pa.list_(pa.struct([("label", pa.int64()), ("n_pixels", pa.int64())] + [(k, pa.float64()) for k in ("area", "prob", "mr", "mc")]))
_PIXELS = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("label", pa.int64()), ("prob", pa.float64())]))


# --- plans -----------------------------------------------------------------------------------------


def _labelled(
    t1: DataFrame, t2: DataFrame, scene: DataFrame, bands: Sequence[str], tau: float, ksize: int, kernel: int, tile: int, pixels: bool
) -> tuple[DataFrame, DataFrame]:
    """Labelled tiles and the seam labels' components ``(scene_id, label, root)``."""
    dims = scene if "n_rows" in scene.columns else raster.scene_dims(t1)
    halo = 2 * (kernel // 2)
    tiles = save_table(difference_tiles(t1, t2, dims, bands, ksize, halo, tile), "difference-tiles")
    ranges = scene_ranges(tiles)
    otsu = raster.otsu_of_histogram(tile_histogram(tiles, ranges, halo))
    found = save_table(label_tiles(tiles, ranges, otsu, scene, tau, kernel, halo, pixels), "labelled-tiles")
    listed = found.select(SCENE, F.explode("pixels").alias("p")).select(SCENE, "p.row", "p.col", "p.label")
    return found, merge_labels(listed, tile, 8)


def _joined(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows
    return rows.join(shuffled(roots), [SCENE, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def change_pixels(
    t1: DataFrame, t2: DataFrame, scene: DataFrame, bands: Sequence[str] = ("b1", "b2", "b3"), tau: float = 0.70, ksize: int = 5,
    kernel: int = 3, tile: int = DEFAULT_TILE,
) -> DataFrame:
    """Changed pixels ``(scene_id, row, col, prob, label)`` of two epochs, labelled by component."""
    found, roots = _labelled(t1, t2, scene, bands, tau, ksize, kernel, tile, True)
    rows = found.select(SCENE, F.explode("pixels").alias("p")).select(SCENE, "p.row", "p.col", "p.prob", "p.label")
    return _joined(rows, roots).select(*PIXEL_KEYS, "prob", "label")


def change_components(
    t1: DataFrame, t2: DataFrame, scene: DataFrame, bands: Sequence[str] = ("b1", "b2", "b3"), tau: float = 0.70, ksize: int = 5,
    kernel: int = 3, tile: int = DEFAULT_TILE,
) -> DataFrame:
    """Change components of two epochs: pixel count, area, mean score and mean position, merged from the tiles' pieces."""
    found, roots = _labelled(t1, t2, scene, bands, tau, ksize, kernel, tile, False)
    pieces = found.select(SCENE, F.explode("pieces").alias("p")).select(SCENE, "p.*")
    total = _joined(pieces, roots).groupBy(SCENE, "label").agg(*[F.sum(c).alias(c) for c in ("n_pixels", "area", "prob", "mr", "mc")])
    mean = {k: F.col(k) / F.col("n_pixels") for k in ("prob", "mr", "mc")}
    return total.withColumns(mean).withColumnRenamed("prob", "mean_prob")
