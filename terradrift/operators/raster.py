"""Dense raster operators over pixel tables ``(scene_id, row, col, ...)``."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terradrift.functions.pixel import clip, luminance, valid_or_null
from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE, along, at_offset, drop_halo, shuffled, with_halo
from terradrift.session import save_table

EPSILON = 1e-6
OTSU_BINS = 256
LUMINANCE_STEP = 38.0


# --- two epochs -------------------------------------------------------------------------------


def bitemporal(t1: DataFrame, t2: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Pixels present in both epochs with bands suffixed ``_t1`` and ``_t2``."""

    def side(px: DataFrame, tag: str) -> DataFrame:
        return px.select(*PIXEL_KEYS, *[F.col(b).alias(f"{b}_{tag}") for b in bands])

    return side(t1, "t1").join(shuffled(side(t2, "t2")), PIXEL_KEYS)


def shape_check(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """Per scene: pixel counts and extents of both epochs and whether they agree."""
    both = t1.select(*PIXEL_KEYS, F.lit(1).alias("e")).unionByName(t2.select(*PIXEL_KEYS, F.lit(2).alias("e")))
    stats = []
    for e in (1, 2):
        mine = F.col("e") == e
        stats += [
            F.count_if(mine).alias(f"n_t{e}"),
            (F.max(F.when(mine, F.col("row"))) + 1).alias(f"rows_t{e}"),
            (F.max(F.when(mine, F.col("col"))) + 1).alias(f"cols_t{e}"),
        ]
    same = F.col("rows_t1").eqNullSafe(F.col("rows_t2")) & F.col("cols_t1").eqNullSafe(F.col("cols_t2"))
    same = same & (F.col("n_t1") == F.col("n_t2"))
    return both.groupBy(SCENE).agg(*stats).withColumn("same_shape", same)


def band_difference(pairs: DataFrame, bands: Sequence[str], out: str = "diff") -> DataFrame:
    """Mean absolute difference across bands."""
    steps = [F.abs(F.col(f"{b}_t2").cast("double") - F.col(f"{b}_t1")) for b in bands]
    return pairs.select(*PIXEL_KEYS, (reduce(lambda a, b: a + b, steps) / len(bands)).alias(out))


def luminance_change(pairs: DataFrame, bands: Sequence[str], step: float = LUMINANCE_STEP) -> DataFrame:
    """Change flag where 0..255 brightness moves by at least ``step``."""
    l1 = luminance(*[f"{b}_t1" for b in bands], scale=255.0)
    l2 = luminance(*[f"{b}_t2" for b in bands], scale=255.0)
    return pairs.select(*PIXEL_KEYS, (F.abs(l2 - l1) >= step).cast("int").alias("active"))


def scene_dims(px: DataFrame) -> DataFrame:
    return px.groupBy(SCENE).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


# --- statistics -------------------------------------------------------------------------------


def _rank_bins(values: DataFrame, open_ranks: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """One round of the selection: the open ranks with the range of the bin each falls into, and its rank within that bin.

    ``open_ranks`` has ``keys``, ``r`` (a rank from 0 among the values within ``lo``..``hi``) and that range. Bins hold a count, a
    least and a greatest value; what is left over is at most ``bins`` rows per rank.
    """
    ranges = open_ranks.select(*keys, "lo", "hi").distinct()
    inside = values.join(ranges, keys).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    # Halves, because the span of two doubles may overflow.
    share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
    counted = inside.groupBy(*keys, "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
    order = W.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    seen = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    hit = open_ranks.join(seen, [*keys, "lo", "hi"]).filter((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("n")))
    return hit.select(*keys, "rank", (F.col("r") - F.col("before")).alias("r"), F.col("first").alias("lo"), F.col("last").alias("hi"))


def select_ranks(values: DataFrame, ranks: DataFrame, keys: list[str], bins: int = 4096) -> DataFrame:
    """``(keys, rank, v)``: the exact value at every rank (from 0, in ascending order) of ``values(keys, v)`` without nulls or NaN.

    ``ranks`` has ``keys, rank`` and the least and greatest value ``lo``, ``hi`` of the key. Each pass counts the values between
    the ends of a rank's bin in ``bins`` finer bins, until its bin holds one number; only counts and ends are shuffled, so no
    task meets the values of a key. Evenly spread doubles take two or three passes, 16-bit numbers two.
    """
    now = ranks.select(*keys, "rank", F.col("rank").alias("r"), "lo", "hi")
    settled = []
    while True:
        seen = Observation()
        found = save_table(_rank_bins(values, now, keys, bins).observe(seen, F.count_if(F.col("lo") < F.col("hi")).alias("open")), "rank-bins")
        settled.append(found.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
        now = found.filter("lo < hi")
        if not seen.get["open"]:
            return reduce(DataFrame.unionByName, settled)


def band_percentiles(
    px: DataFrame, bands: Sequence[str], low: float = 2.0, high: float = 98.0, nodata: float | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per scene and band over valid pixels.

    The values at the two or four ranks that bracket the percentiles are selected by nested histograms, so a scene's task
    reads counts of bins, however many distinct numbers its bands hold.
    """
    if not 0.0 <= low < high <= 100.0:
        raise ValueError("percentiles must satisfy 0 <= low < high <= 100")
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), valid_or_null(b, nodata).alias("v")) for b in bands])
    keys = [SCENE, "band"]
    values = px.select(SCENE, F.explode(pairs).alias("x")).select(SCENE, "x.band", F.col("x.v").cast("double").alias("v")).filter(F.col("v").isNotNull())
    ends = save_table(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "ends")
    places = {"p_low": (F.col("n") - 1) * (low / 100.0), "p_high": (F.col("n") - 1) * (high / 100.0)}
    sides = F.array(*[f(at).cast("bigint") for at in places.values() for f in (F.floor, F.ceil)])
    ranks = ends.withColumn("rank", F.explode(F.array_distinct(sides))).select(*keys, "rank", "lo", "hi")
    found = select_ranks(values, ranks, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def between(at: Column) -> Column:
        under, over = F.col("at")[F.floor(at).cast("bigint")], F.col("at")[F.ceil(at).cast("bigint")]
        return F.when(under == over, under).otherwise((F.ceil(at) - at) * under + (at - F.floor(at)) * over)

    return ends.join(found, keys).select(*keys, *[between(at).alias(k) for k, at in places.items()])


def percentile_normalise(
    px: DataFrame, bands: Sequence[str], low: float = 2.0, high: float = 98.0, nodata: float | None = None
) -> DataFrame:
    """Stretch each band to [0, 1] between its percentiles; nodata becomes 0."""
    long = band_percentiles(px, bands, low, high, nodata)
    one = [F.max(F.when(F.col("band") == b, F.struct("p_low", "p_high"))).alias(f"_s_{b}") for b in bands]
    stats = save_table(long.groupBy(SCENE).agg(*one), "percentiles")

    def stretch(b: str) -> Column:
        v, s = valid_or_null(b, nodata), F.col(f"_s_{b}")
        span = s["p_high"] - s["p_low"]
        scaled = clip((v - s["p_low"]) / (span + EPSILON), 0, 1)
        return F.when(v.isNull() | s.isNull(), 0.0).when(span <= EPSILON, 0.5).otherwise(scaled)

    joined = px.join(stats, SCENE, "left")
    others = [c for c in px.columns if c not in bands]
    return joined.select(*others, *[stretch(b).alias(b) for b in bands])


def min_max_normalise(px: DataFrame, value: str, out: str) -> DataFrame:
    """Scale to [0, 1] per scene; a constant scene becomes 0."""
    ends = save_table(px.groupBy(SCENE).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), "minmax")
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.col(value) - F.col("_lo")) / span).otherwise(0.0)
    return px.join(ends, SCENE).withColumn(out, scaled).drop("_lo", "_hi")


def histogram_bin(value: str) -> Column:
    return F.floor(clip(F.col(value) * 255.0, 0, 255)).cast("int")


def otsu_threshold(px: DataFrame, value: str) -> DataFrame:
    """Bin (0..255) per scene that maximises between-class variance; ties go to the lowest bin.

    Only the 256-bin histogram is windowed.
    """
    return otsu_of_histogram(px.groupBy(SCENE, histogram_bin(value).alias("bin")).agg(F.count("*").alias("n")))


def otsu_of_histogram(hist: DataFrame) -> DataFrame:
    """The threshold bin of counts ``(scene_id, bin, n)``."""
    seen = W.partitionBy(SCENE).orderBy("bin")
    total = W.partitionBy(SCENE)
    mass = hist.withColumn("s", F.col("bin") * F.col("n")).withColumns(
        {
            "w0": F.sum("n").over(seen).cast("double"),
            "s0": F.sum("s").over(seen).cast("double"),
            "w": F.sum("n").over(total).cast("double"),
            "s": F.sum("s").over(total).cast("double"),
        }
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    spread = F.when(w1 > 0, F.col("w0") * w1 / (F.col("w") * F.col("w")) * gap * gap).otherwise(0.0)
    return (
        mass.withColumn("spread", F.round(spread, 9))
        .groupBy(SCENE)
        .agg(F.max_by("bin", F.struct(F.col("spread"), -F.col("bin"))).alias("otsu_bin"))
    )


def otsu_score(px: DataFrame, value: str, thresholds: DataFrame, out: str = "prob") -> DataFrame:
    """Lift pixels above the threshold to at least it, hold the others below half of it."""
    t = F.col("otsu_bin") / 255.0
    lifted = F.when(histogram_bin(value) > F.col("otsu_bin"), F.greatest(F.col(value), t))
    return px.join(thresholds, SCENE).withColumn(out, lifted.otherwise(F.least(F.col(value), t * 0.5)))


def score_stats(px: DataFrame, value: str = "prob") -> DataFrame:
    return px.groupBy(SCENE).agg(
        F.bround(F.avg(value), 4).alias("mean_prob"), F.bround(F.max(value), 4).alias("max_prob")
    )


def cloud_ratio(mask: DataFrame, scenes: DataFrame, limit: float = 0.35, flag: str = "mask") -> DataFrame:
    """Share of non-zero mask pixels per scene; scenes without pixels count as clear."""
    share = mask.groupBy(SCENE).agg(F.avg((F.col(flag) != 0).cast("double")).alias("ratio"))
    ratio = F.coalesce(F.col("ratio"), F.lit(0.0))
    verdict = F.when(ratio > limit, "REJECTED_CLOUD_COVER").otherwise("OK")
    return scenes.select(SCENE).join(share, SCENE, "left").select(SCENE, ratio.alias("ratio"), verdict.alias("status"))


# --- neighbourhoods ---------------------------------------------------------------------------


def blur_weights(ksize: int) -> list[float]:
    """1-D Gaussian kernel whose width follows from its size."""
    fixed = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [2, 7, 14, 18, 14, 7, 2]}
    if ksize in fixed:
        raw = [float(x) for x in fixed[ksize]]
    else:
        sigma = 0.3 * ((ksize - 1) * 0.5 - 1) + 0.8
        raw = [math.exp(-((i - ksize // 2) ** 2) / (2 * sigma * sigma)) for i in range(ksize)]
    return [x / sum(raw) for x in raw]


def _blur_axis(px: DataFrame, value: str, axis: str, size: str, weights: list[float]) -> DataFrame:
    """Weighted mean along one axis; positions past the raster are mirrored about the edge pixel, as often as it takes.

    Missing pixels have no say: the weights of the others are scaled up to one.
    """
    k = len(weights) // 2
    offsets = range(-k, k + 1)
    moved = px.withColumns({f"_n{d + k}": at_offset(value, axis, d) for d in offsets})
    near = F.array(*[F.col(f"_n{d + k}") for d in offsets])
    period = F.greatest(2 * (F.col(size) - 1), F.lit(1))

    def sample(d: int) -> Column:
        place = F.pmod(F.col(axis) + d, period)
        mirrored = F.when(F.col(size) == 1, F.lit(0)).otherwise(F.least(place, period - place))
        return F.element_at(near, mirrored - F.col(axis) + k + 1)

    seen = {d: sample(d) for d in offsets}
    total = reduce(lambda a, b: a + b, [weights[d + k] * seen[d] for d in offsets])
    some = reduce(lambda a, b: a + b, [F.coalesce(weights[d + k] * seen[d], F.lit(0.0)) for d in offsets])
    weight = reduce(lambda a, b: a + b, [F.when(seen[d].isNotNull(), weights[d + k]).otherwise(0.0) for d in offsets])
    return moved.withColumn(value, F.coalesce(total, F.try_divide(some, weight))).drop(*[f"_n{d + k}" for d in offsets])


def gaussian_blur(px: DataFrame, value: str, dims: DataFrame, ksize: int = 5, tile: int = DEFAULT_TILE) -> DataFrame:
    """Separable Gaussian blur of a dense pixel table; even or unit sizes leave it unchanged."""
    if ksize <= 1 or ksize % 2 == 0:
        return px
    weights = blur_weights(ksize)
    sized = px.join(dims.select(SCENE, "n_rows", "n_cols"), SCENE)
    tiles = with_halo(sized, ksize // 2, tile)
    across = _blur_axis(tiles, value, "col", "n_cols", weights)
    return drop_halo(_blur_axis(across, value, "row", "n_rows", weights), tile).drop("n_rows", "n_cols")


def opening(px: DataFrame, flag: str, kernel: int = 3, tile: int = DEFAULT_TILE) -> DataFrame:
    """Binary erosion then dilation with a square kernel, ignoring pixels past the border.

    One halo shuffle, then erode row/column and dilate column/row as local sorts.
    """
    r = kernel // 2
    if r == 0:
        return px
    tiles = with_halo(px, 2 * r, tile)
    for axis, pick in (("col", F.min), ("row", F.min), ("row", F.max), ("col", F.max)):
        tiles = tiles.withColumn(flag, pick(flag).over(along(axis, -r, r)))
    return drop_halo(tiles, tile)


# --- grid cells -------------------------------------------------------------------------------


def grid_density(px: DataFrame, cell: int = 16, flag: str = "active") -> DataFrame:
    """Share of active pixels per square cell; cells at the edge are smaller."""
    return px.groupBy(
        SCENE, F.floor(F.col("row") / cell).cast("int").alias("row"), F.floor(F.col("col") / cell).cast("int").alias("col")
    ).agg(F.avg(flag).alias("density"))
