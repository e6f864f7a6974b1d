"""Alignment of two epochs: best pixel shift by brightness correlation, and resampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradrift.operators.tiling import DEFAULT_TILE, PIXEL_KEYS, SCENE, at_offset, drop_halo, shuffled, with_halo
from terradrift.session import save_table

MIN_CORRELATION = 0.65
MIN_SPREAD = 1e-4


def _name(prefix: str, *steps: int) -> str:
    return prefix + "_".join(str(s).replace("-", "m") for s in steps)


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows where ``b`` is present; NULL when either side is flat."""
    spread = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), spread)


def shift_scores(planes: DataFrame, reach: int = 2, tile: int = DEFAULT_TILE, counts: bool = False) -> DataFrame:
    """Correlation of ``l1[r, c]`` with ``l2[r + dy, c + dx]`` for every shift within ``reach``.

    All shifts are columns made by neighbour lookups inside halo tiles, so the pixels are
    shuffled once and reduced in one aggregate instead of being copied per shift. ``counts`` adds the places ``n`` that both
    planes hold at a shift and ``n_first`` of the first plane.
    """
    steps = range(-reach, reach + 1)
    tiles = with_halo(planes.select(*PIXEL_KEYS, "l1", "l2"), reach, tile)

    tiles = tiles.withColumns({_name("v", dy): at_offset("l2", "row", dy) for dy in steps})
    tiles = tiles.withColumns({_name("s", dy, dx): at_offset(_name("v", dy), "col", dx) for dy in steps for dx in steps})
    scores = [_correlation("l1", _name("s", dy, dx)).alias(_name("s", dy, dx)) for dy in steps for dx in steps]
    spread = F.least(F.stddev_pop("l1"), F.stddev_pop("l2")).alias("spread")
    both = [F.count(F.when(F.col("l1").isNotNull(), F.col(_name("s", dy, dx)))).alias(_name("n", dy, dx)) for dy in steps for dx in steps] if counts else []
    wide = drop_halo(tiles, tile).groupBy(SCENE).agg(spread, F.count("l1").alias("n_first"), *scores, *both)
    listed = F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.col(_name("s", dy, dx)).alias("score"),
                     *([F.col(_name("n", dy, dx)).alias("n")] if counts else []))
            for dy in steps for dx in steps
        ]
    )
    kept = [SCENE, "spread", *(["n_first"] if counts else [])]
    return wide.select(*kept, F.explode(listed).alias("s")).select(*kept, "s.*")


def best_shift(scores: DataFrame, min_correlation: float = MIN_CORRELATION) -> DataFrame:
    """Best shift per scene with a parabola refinement, its score and the verdict.

    Flat scenes score 0; both those and scores under the limit are ``REJECTED_ALIGNMENT``.
    """
    flat = F.col("spread") < MIN_SPREAD
    scored = scores.withColumn("score", F.when(flat, 0.0).otherwise(F.coalesce("score", F.lit(0.0))))
    order = F.struct("score", -(F.abs("dy") + F.abs("dx")), -F.col("dy"), -F.col("dx"))
    top = scored.groupBy(SCENE).agg(F.max_by(F.struct("dy", "dx", "score"), order).alias("best"))
    near = scored.join(top, SCENE)

    def at(dy: int, dx: int) -> Column:
        hit = (F.col("dy") == F.col("best.dy") + dy) & (F.col("dx") == F.col("best.dx") + dx)
        return F.max(F.when(hit, F.col("score")))

    sides = near.groupBy(SCENE, "best").agg(
        at(-1, 0).alias("up"), at(1, 0).alias("down"), at(0, -1).alias("west"), at(0, 1).alias("east")
    )

    def refine(before: str, after: str) -> Column:
        bend = F.col(before) - 2 * F.col("best.score") + F.col(after)
        return F.coalesce(F.when(bend < 0, (F.col(before) - F.col(after)) / (2 * bend)), F.lit(0.0))

    verdict = F.when(F.col("best.score") < min_correlation, "REJECTED_ALIGNMENT").otherwise("OK")
    return sides.select(
        SCENE, F.col("best.dy").alias("dy"), F.col("best.dx").alias("dx"), F.col("best.score").alias("score"),
        (F.col("best.dy") + refine("up", "down")).alias("dy_fine"),
        (F.col("best.dx") + refine("west", "east")).alias("dx_fine"), verdict.alias("status"),
    )


def _halved(plane: DataFrame, level: int) -> DataFrame:
    """Means of a plane ``(scene_id, row, col, v)`` over squares of ``2 ** level`` pixels."""
    if not level:
        return plane
    place = {k: F.floor(F.col(k) / 2**level).cast("int") for k in ("row", "col")}
    return plane.groupBy(SCENE, *[v.alias(k) for k, v in place.items()]).agg(F.avg("v").alias("v"))


def pyramid_shift(
    planes: DataFrame, max_shift: int = 32, min_correlation: float = MIN_CORRELATION, beam: int = 3, tile: int = DEFAULT_TILE, min_cells: int = 64
) -> DataFrame:
    """Best shift per scene as :func:`best_shift`, searched from coarse to fine up to ``max_shift`` pixels along both axes.

    ``planes`` holds ``(scene_id, row, col, l1, l2)``. Level k compares means over squares of ``2 ** k`` pixels; it tries the
    shifts within two squares of every candidate of the level above and keeps the ``beam`` best for the next. The finest level
    starts from the best one, compares pixels and refines by a parabola, so every level has 25 score columns however far the
    scenes are apart. A scene joins in at the first level at which it has ``min_cells`` squares; of the places of a shift
    at least a quarter must be seen.
    """
    top = 0
    while 2 * 2**top < max_shift:
        top += 1
    one, two = (planes.select(*PIXEL_KEYS, F.col(c).alias("v")) for c in ("l1", "l2"))
    known = None
    for level in range(top, -1, -1):
        a = _halved(one.filter(F.col("v").isNotNull()), level)
        b = _halved(two.filter(F.col("v").isNotNull()), level)
        a, b = (save_table(x, "pyramid") for x in (a, b)) if level else (a, b)
        wide = a.groupBy(SCENE).agg(F.count("*").alias("n"))
        if level:
            wide = wide.filter(F.col("n") >= min_cells)
        start = wide.select(SCENE, F.lit(0).alias("base"), F.lit(0).alias("by"), F.lit(0).alias("bx"))
        if known is not None:
            start = start.join(known.select(SCENE).distinct(), SCENE, "left_anti").unionByName(
                known.filter(F.col("base") < (beam if level else 1)).select(SCENE, "base", (2 * F.col("dy")).alias("by"), (2 * F.col("dx")).alias("bx")))
        start = save_table(start, "shift-candidates")
        # Every candidate is a scene of its own: the second plane, moved by the candidate, beside the first.
        name = F.concat_ws("@", SCENE, F.col("base").cast("string"))
        first = a.join(start, SCENE).select(name.alias(SCENE), "row", "col", F.col("v").alias("l1"))
        second = b.join(start, SCENE).select(name.alias(SCENE), (F.col("row") - F.col("by")).alias("row"), (F.col("col") - F.col("bx")).alias("col"), F.col("v").alias("l2"))
        second = second.filter("row >= 0 AND col >= 0")
        pair = first.join(shuffled(second), PIXEL_KEYS, "full" if level else "left")
        scores = shift_scores(pair, 2, tile, counts=True).withColumnRenamed(SCENE, "_name")
        named = start.withColumn("_name", name)
        moved = scores.join(named, "_name").withColumns({"dy": F.col("dy") + F.col("by"), "dx": F.col("dx") + F.col("bx")})
        seen = F.when(F.col("n") * 4 >= F.col("n_first"), F.col("score"))
        scored = save_table(moved.select(SCENE, "spread", "dy", "dx", seen.alias("score")), "shift-scores")
        if not level:
            return best_shift(scored, min_correlation)
        order = [F.desc_nulls_last("score"), F.abs("dy") + F.abs("dx"), F.col("dy"), F.col("dx")]
        rank = F.row_number().over(W.partitionBy(SCENE).orderBy(*order)) - 1
        best = scored.groupBy(SCENE, "dy", "dx").agg(F.max("score").alias("score"))
        known = save_table(best.withColumn("base", rank).filter(F.col("base") < beam).select(SCENE, "base", "dy", "dx"), "shift-beam")


def shift_warp(shifts: DataFrame, fine: bool = True) -> DataFrame:
    """Warp coefficients ``(m00..m12)``, destination to source, of a shift per scene."""
    dx, dy = ("dx_fine", "dy_fine") if fine else ("dx", "dy")
    one, zero = F.lit(1.0), F.lit(0.0)
    m = {"m00": one, "m01": zero, "m02": F.col(dx).cast("double"), "m10": zero, "m11": one, "m12": F.col(dy).cast("double")}
    return shifts.select(SCENE, *[v.alias(k) for k, v in m.items()])


def _reflect(i: Column, n: Column) -> Column:
    """Index mirrored at the raster edge with the edge pixel repeated."""
    period = F.pmod(i, 2 * n)
    return F.when(period < n, period).otherwise(2 * n - 1 - period).cast("int")


def warp(px: DataFrame, dims: DataFrame, matrix: DataFrame, bands: Sequence[str], integer: bool = False) -> DataFrame:
    """Resample bands with bilinear weights; ``matrix`` maps (col, row) of the result to the source.

    Each result pixel asks for its source corners with non-zero weight, so an integer
    shift costs one lookup per pixel. Integer bands are rounded and kept within 16 bits.
    """
    target = px.select(*PIXEL_KEYS).join(matrix, SCENE).join(dims.select(SCENE, "n_rows", "n_cols"), SCENE)
    sx = F.col("m00") * F.col("col") + F.col("m01") * F.col("row") + F.col("m02")
    sy = F.col("m10") * F.col("col") + F.col("m11") * F.col("row") + F.col("m12")
    placed = target.select(*PIXEL_KEYS, "n_rows", "n_cols", sx.alias("sx"), sy.alias("sy")).withColumns(
        {"x0": F.floor("sx"), "y0": F.floor("sy")}
    )
    fx, fy = F.col("sx") - F.col("x0"), F.col("sy") - F.col("y0")
    corners = F.array(
        *[
            F.struct(
                _reflect(F.col("y0") + oy, F.col("n_rows")).alias("sr"),
                _reflect(F.col("x0") + ox, F.col("n_cols")).alias("sc"),
                ((fy if oy else 1 - fy) * (fx if ox else 1 - fx)).alias("w"),
            )
            for oy in (0, 1) for ox in (0, 1)
        ]
    )
    asks = placed.select(*PIXEL_KEYS, F.explode(F.filter(corners, lambda c: c["w"] > 0)).alias("c"))
    source = px.select(F.col(SCENE), F.col("row").alias("sr"), F.col("col").alias("sc"), *bands)
    sums = [F.sum(F.col("w") * F.col(b)).alias(b) for b in bands]
    out = asks.select(*PIXEL_KEYS, "c.*").join(shuffled(source), [SCENE, "sr", "sc"]).groupBy(*PIXEL_KEYS).agg(*sums)
    if not integer:
        return out
    whole = {b: F.least(F.greatest(F.bround(b), F.lit(0.0)), F.lit(65535.0)).cast("int") for b in bands}
    return out.withColumns(whole)


def rms_difference(pairs: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """Root mean square difference per scene, to compare before and after a warp."""
    squares = [(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b)]
    return pairs.groupBy(SCENE).agg(F.sqrt(F.avg(reduce(lambda p, q: p + q, squares) / len(squares))).alias("rmse"))
