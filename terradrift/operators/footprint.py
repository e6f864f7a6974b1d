"""Ground footprint of any polygon geometry: crossings are split, shared edges cancel, holes are nested anew.

A sweep expressed as joins. Edges are cut where they meet another edge of their geometry; of equal pieces only an odd one
stays; the number of pieces below a piece's middle tells which of its sides is inside (odd crossings are inside). Area and
centroid are then sums over pieces, and rings are needed only where the repaired geometry itself is asked for. Edges of a
geometry meet in vertical slabs, about as many as the square root of its edges, so neither step lists all pairs.

Footprints of short outlines that lie in one row go through the same steps where they lie, many at a time in NumPy, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from terradrift.functions.geo import WGS84_B, WGS84_E, WGS84_E2, authalic_zone, hectares
from terradrift.functions.gridref import with_grid_ref
from terradrift.session import save_table

MULTIPOLYGON = "array<array<array<array<double>>>>"
PIECE = ["x1", "y1", "x2", "y2"]
FRAME = ["left", "low", "slab"]
SHORT = 40  # points of an outline that is not swept
_PAIRS = 2_000_000  # pairs looked at together
_SUMS = ["left", "low", "p0", "px", "py", "e0", "ex", "ey"]


def _shuffled(rows: DataFrame) -> DataFrame:
    """A side that grows with the edges: written pieces pack so well that the size of their files says nothing about them."""
    return rows.hint("merge")


def _edges(features: DataFrame, key: str, geometry: str) -> DataFrame:
    """``(key, seg, x1, y1, x2, y2)``: edges from left to right (upwards where vertical) with the frame of their geometry."""
    rings = features.select(F.col(key).alias("key"), F.posexplode(F.flatten(geometry)).alias("r", "ring"))
    rings = rings.withColumn("ring", F.filter("ring", lambda p: p[0].isNotNull() & p[1].isNotNull()))
    nxt = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    steps = F.zip_with("ring", nxt, lambda p, q: F.struct(p[0].alias("ax"), p[1].alias("ay"), q[0].alias("bx"), q[1].alias("by")))
    edge = rings.filter(F.size("ring") > 1).select("key", "r", F.posexplode(steps).alias("s", "e")).select("key", F.struct("r", "s").alias("seg"), "e.*")
    first = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") <= F.col("by")))
    ends = {"x1": ("ax", "bx"), "y1": ("ay", "by"), "x2": ("bx", "ax"), "y2": ("by", "ay")}
    known = edge.filter("ax <> bx OR ay <> by")
    turned = known.select("key", "seg", *[F.when(first, F.col(a)).otherwise(F.col(b)).alias(k) for k, (a, b) in ends.items()])
    frame = turned.groupBy("key").agg(F.min("x1").alias("left"), F.max("x2").alias("right"), F.min(F.least("y1", "y2")).alias("low"), F.count("*").alias("n"))
    slab = ((F.col("right") - F.col("left")) / F.ceil(F.sqrt("n"))).alias("slab")
    return turned.join(_shuffled(frame.select("key", "left", "low", slab)), "key")


def _slab(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.col("slab") > 0, F.floor((x - F.col("left")) / F.col("slab"))).otherwise(F.lit(0)).cast("long")


def _in_slabs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.explode(F.sequence(_slab("x1"), _slab("x2"))))


def _pieces(edges: DataFrame) -> DataFrame:
    """Edges cut at every meeting point, each piece once, pieces that lie on each other an even number of times left out."""
    spread = save_table(_in_slabs(edges), "edge-slabs")
    a = spread.select("key", "at", "left", "slab", *[F.col(c).alias(f"a_{c}") for c in ("seg", *PIECE)])
    b = spread.select("key", "at", *[F.col(c).alias(f"b_{c}") for c in ("seg", *PIECE)])
    c = F.col
    near = (c("a_seg") < c("b_seg")) & (c("a_x1") <= c("b_x2")) & (c("b_x1") <= c("a_x2"))
    near = near & (F.least("a_y1", "a_y2") <= F.greatest("b_y1", "b_y2")) & (F.least("b_y1", "b_y2") <= F.greatest("a_y1", "a_y2"))
    pairs = a.join(_shuffled(b), ["key", "at"]).filter(near & (c("at") == _slab(F.greatest("a_x1", "b_x1"))))
    ax, ay, bx, by = c("a_x2") - c("a_x1"), c("a_y2") - c("a_y1"), c("b_x2") - c("b_x1"), c("b_y2") - c("b_y1")
    gx, gy = c("b_x1") - c("a_x1"), c("b_y1") - c("a_y1")
    turn, off = ax * by - ay * bx, gx * ay - gy * ax
    met = pairs.withColumns({"turn": turn, "off": off, "t": F.try_divide(gx * by - gy * bx, turn), "u": F.try_divide(off, turn)})

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    ends = {k: point(c(f"{k[0]}_x{k[1]}"), c(f"{k[0]}_y{k[1]}")) for k in ("a1", "a2", "b1", "b2")}
    # Ends that touch keep their exact position, so that edges on each other are cut into equal pieces.
    inner = point(F.least(F.greatest(c("a_x1") + c("t") * ax, c("a_x1")), c("a_x2")), c("a_y1") + c("t") * ay)
    cross = F.when(c("t") == 0, ends["a1"]).when(c("t") == 1, ends["a2"]).when(c("u") == 0, ends["b1"]).when(c("u") == 1, ends["b2"]).otherwise(inner)
    hit = (c("turn") != 0) & c("t").between(0, 1) & c("u").between(0, 1)
    aligned = (c("turn") == 0) & (c("off") == 0)
    none = F.lit(None).cast("struct<x: double, y: double>")

    def cuts(seg: str, one: str, two: str) -> list[Column]:
        return [F.struct(c(seg).alias("seg"), F.when(hit, cross).when(aligned, ends[one]).otherwise(none).alias("p")),
                F.struct(c(seg).alias("seg"), F.when(aligned, ends[two]).otherwise(none).alias("p"))]

    listed = F.explode(F.array(*cuts("a_seg", "b1", "b2"), *cuts("b_seg", "a1", "a2"))).alias("c")
    cut = met.select("key", listed).select("key", "c.seg", "c.p").filter("p IS NOT NULL")
    # Each edge travels once, beside its cuts; its own ends are added when all have met.
    edge = F.struct(*PIECE, *FRAME)
    own = edges.select("key", "seg", none.alias("p"), edge.alias("e"))
    every = cut.withColumn("e", F.lit(None).cast(own.schema["e"].dataType)).unionByName(own)
    inside = every.groupBy("key", "seg").agg(F.collect_set("p").alias("p"), F.first("e", ignorenulls=True).alias("e")).select("key", "p", "e.*")
    ends = F.array(point(c("x1"), c("y1")), point(c("x2"), c("y2")))
    inside = inside.withColumn("p", F.array_sort(F.array_union("p", ends)))
    # A point of an aligned edge beyond this one's ends is no cut.
    kept = F.filter("p", lambda p: p.between(point(c("x1"), c("y1")), point(c("x2"), c("y2"))))
    parts = F.transform(F.sequence(F.lit(1), F.size("k") - 1), lambda i: F.struct(c("k")[i - 1].alias("f"), c("k")[i].alias("g")))
    pieces = inside.withColumn("k", kept).filter(F.size("k") > 1).select("key", *FRAME, F.explode(parts).alias("s")).select(
        "key", *FRAME, c("s.f.x").alias("x1"), c("s.f.y").alias("y1"), c("s.g.x").alias("x2"), c("s.g.y").alias("y2"))
    frame = [F.first(k).alias(k) for k in FRAME]
    return pieces.groupBy("key", *PIECE).agg(F.count("*").alias("n"), *frame).filter("n % 2 = 1").drop("n")


def boundary(features: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """Boundary pieces ``(key, x1, y1, x2, y2, below)`` with the number of other pieces below their middle.

    An even number means that the inside lies above the piece (left of it, where it is vertical).
    """
    pieces = save_table(_pieces(save_table(_edges(features, key, geometry), "edges")), "pieces")
    middle = pieces.select("key", *[F.col(c).alias(f"m_{c}") for c in PIECE], ((F.col("x1") + F.col("x2")) / 2).alias("mx"),
                           ((F.col("y1") + F.col("y2")) / 2).alias("my"), _slab((F.col("x1") + F.col("x2")) / 2).alias("at"))
    height = F.col("y1") + (F.col("mx") - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    over = _in_slabs(pieces.filter("x2 > x1").select("key", "left", "slab", *PIECE)).drop("left", "slab")
    same = F.lit(True)
    for c in PIECE:
        same = same & (F.col(c) == F.col(f"m_{c}"))
    hits = middle.join(_shuffled(over), ["key", "at"]).filter((F.col("x1") <= F.col("mx")) & (F.col("mx") < F.col("x2")) & ~same & (height < F.col("my")))
    count = hits.groupBy("key", *[F.col(f"m_{c}").alias(c) for c in PIECE]).agg(F.count("*").alias("below"))
    return pieces.join(_shuffled(count), ["key", *PIECE], "left").withColumn("below", F.coalesce("below", F.lit(0)))


def _latitude(q: Column) -> Column:
    """Latitude in degrees of an authalic zone value, by the series in the eccentricity."""
    pole = 1 / (1 - WGS84_E2) + float(np.arctanh(WGS84_E)) / WGS84_E
    b = F.asin(F.least(F.greatest(q / pole, F.lit(-1.0)), F.lit(1.0)))
    e2, e4, e6 = WGS84_E2, WGS84_E2**2, WGS84_E2**3
    s2 = (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b)
    s4 = (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b)
    return F.degrees(b + s2 + s4 + (761 * e6 / 45360) * F.sin(6 * b))


def _pairs(group: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of members of each group; members lie together."""
    n = count[group]
    i = np.repeat(np.arange(len(group)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[group[i]]


def _short_edges(geometry: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and ``x1, y1, x2, y2`` of every edge, from left to right (upwards where vertical), in the order of their rows."""
    row = np.arange(len(geometry))
    for _ in range(3):
        parent, geometry = pc.list_parent_indices(geometry).to_numpy(), geometry.flatten()
        ring, row = parent, row[parent]
    size = pc.fill_null(pc.list_value_length(geometry), 0).to_numpy(zero_copy_only=False)
    at = np.asarray(geometry.offsets)[:-1][size > 1]
    row, ring = row[size > 1], ring[size > 1]
    value = pc.fill_null(geometry.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    x, y = value[at], value[at + 1]
    there = ~(np.isnan(x) | np.isnan(y))
    x, y, row, ring = x[there], y[there], row[there], ring[there]
    starts = np.nonzero(np.diff(ring, prepend=-1))[0]
    after = np.arange(1, len(ring) + 1)
    if len(ring):
        after[np.append(starts[1:], len(ring)) - 1] = starts
    ax, ay, bx, by = x, y, x[after], y[after]
    known = (ax != bx) | (ay != by)
    turn = (ax > bx) | ((ax == bx) & (ay > by))
    edge = np.stack([np.where(turn, bx, ax), np.where(turn, by, ay), np.where(turn, ax, bx), np.where(turn, ay, by)])
    return row[known], edge[:, known]


def _short_pieces(row: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_pieces`, of edges that lie together by row: row and ends of each piece that lies there an odd number of times."""
    count = np.bincount(row)
    a, b = _pairs(row, np.cumsum(count) - count, count)
    low, high = np.minimum(edge[1], edge[3]), np.maximum(edge[1], edge[3])
    near = (a < b) & (edge[0][a] <= edge[2][b]) & (edge[0][b] <= edge[2][a]) & (low[a] <= high[b]) & (low[b] <= high[a])
    a, b = a[near], b[near]
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = edge[:, a], edge[:, b]
    ax, ay, bx, by, gx, gy = ax2 - ax1, ay2 - ay1, bx2 - bx1, by2 - by1, bx1 - ax1, by1 - ay1
    turn, off = ax * by - ay * bx, gx * ay - gy * ax
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (gx * by - gy * bx) / turn, off / turn
        at = [t == 0, t == 1, u == 0, u == 1]
        # Ends that touch keep their exact position, so that edges on each other are cut into equal pieces.
        cx = np.select(at, [ax1, ax2, bx1, bx2], np.minimum(np.maximum(ax1 + t * ax, ax1), ax2))
        cy = np.select(at, [ay1, ay2, by1, by2], ay1 + t * ay)
        hit = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    aligned = (turn == 0) & (off == 0)
    every = np.arange(len(row))
    of = np.concatenate([every, every, a[hit], b[hit], a[aligned], a[aligned], b[aligned], b[aligned]])
    x = np.concatenate([edge[0], edge[2], cx[hit], cx[hit], bx1[aligned], bx2[aligned], ax1[aligned], ax2[aligned]])
    y = np.concatenate([edge[1], edge[3], cy[hit], cy[hit], by1[aligned], by2[aligned], ay1[aligned], ay2[aligned]])
    x1, y1, x2, y2 = edge[:, of]
    # A point of an aligned edge beyond this one's ends is no cut.
    inside = ((x > x1) | ((x == x1) & (y >= y1))) & ((x < x2) | ((x == x2) & (y <= y2)))
    of, x, y = of[inside], x[inside], y[inside]
    order = np.lexsort((y, x, of))
    of, x, y = of[order], x[order], y[order]
    step = (of[1:] == of[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    piece = np.stack([x[:-1], y[:-1], x[1:], y[1:]])[:, step]
    row = row[of[:-1][step]]
    order = np.lexsort((*piece[::-1], row))
    row, piece = row[order], piece[:, order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (piece[:, 1:] != piece[:, :-1]).any(0)
    first = np.nonzero(fresh)[0]
    odd = first[np.diff(np.append(first, len(row))) % 2 == 1]
    return row[odd], piece[:, odd]


def _authalic(lat: np.ndarray) -> np.ndarray:
    """As :func:`authalic_zone`."""
    s = np.sin(np.radians(lat))
    return s / (1 - WGS84_E2 * s * s) + np.arctanh(WGS84_E * s) / WGS84_E


def _short_sums(geometry: pa.Array) -> np.ndarray:
    """The sums that area and centroids follow from, a column per row; NaN where no piece is left."""
    out = np.full((len(_SUMS), len(geometry)), np.nan)
    row, edge = _short_edges(geometry)
    if not len(row):
        return out
    n = np.bincount(row, minlength=len(geometry))
    left, low = np.full(len(n), np.inf), np.full(len(n), np.inf)
    np.minimum.at(left, row, edge[0])
    np.minimum.at(low, row, np.minimum(edge[1], edge[3]))
    row, piece = _short_pieces(row, edge)
    n = np.bincount(row, minlength=len(geometry))
    first = np.cumsum(n) - n
    x1, y1, x2, y2 = piece
    mx, my, below = (x1 + x2) / 2, (y1 + y2) / 2, np.zeros(len(row), np.int64)
    # Pieces can be many more than edges; rows are taken together up to a number of pairs.
    bounds, work = [0], 0
    for r in np.nonzero(n)[0]:
        if work and work + int(n[r]) ** 2 > _PAIRS:
            bounds.append(int(first[r]))
            work = 0
        work += int(n[r]) ** 2
    for s, e in zip(bounds, [*bounds[1:], len(row)]):
        own = row[s:e] - (row[s] if e > s else 0)
        count = np.bincount(own)
        i, j = (k + s for k in _pairs(own, np.cumsum(count) - count, count))
        with np.errstate(divide="ignore", invalid="ignore"):
            height = y1[j] + (mx[i] - x1[j]) / (x2[j] - x1[j]) * (y2[j] - y1[j])
            hits = (i != j) & (x2[j] > x1[j]) & (x1[j] <= mx[i]) & (mx[i] < x2[j]) & (height < my[i])
        below += np.bincount(i[hits], minlength=len(row))
    sign = np.where(below % 2 == 0, -1.0, 1.0)
    ax, bx = x1 - left[row], x2 - left[row]
    zone = _authalic(low)[row]
    out[0], out[1] = left, low
    for k, (a, b) in ((2, (y1 - low[row], y2 - low[row])), (5, (_authalic(y1) - zone, _authalic(y2) - zone))):
        strip = sign * (bx - ax)
        for i, v in enumerate((strip * (a + b) / 2, strip / 6 * (a * (2 * ax + bx) + b * (ax + 2 * bx)), strip / 6 * (a * a + a * b + b * b))):
            out[k + i] = np.bincount(row, v, len(n))
    out[:, n == 0] = np.nan
    return out


def _short_totals(features: DataFrame) -> DataFrame:
    """``key`` and the sums of each row ``(key, geometry)``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sums = _short_sums(part.column(1))
                columns = [pa.array(v, mask=np.isnan(v)) for v in sums]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["key", *_SUMS])

    schema = StructType([features.schema["key"], *StructType.fromDDL(", ".join(f"{c} double" for c in _SUMS)).fields])
    return features.mapInArrow(add, schema)


def _short_rows(geometry: pa.Array) -> np.ndarray:
    """Which rows have few points, all with coordinates that are numbers or null."""
    short = np.asarray(geometry.is_valid())
    row = np.arange(len(geometry))
    for _ in range(3):
        parent, geometry = pc.list_parent_indices(geometry).to_numpy(), geometry.flatten()
        row = row[parent]
        short[row[~np.asarray(geometry.is_valid())]] = False
    size = pc.fill_null(pc.list_value_length(geometry), 0).to_numpy(zero_copy_only=False)
    short[row[size < 2]] = False
    at, row = np.asarray(geometry.offsets)[:-1][size > 1], row[size > 1]
    value = pc.fill_null(geometry.values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    for i in (0, 1):
        short[row[~(np.abs(value[at + i]) < 1e150)]] = False
    return short & (np.bincount(row, minlength=len(short)) <= SHORT)


def _told_short(features: DataFrame) -> DataFrame:
    """``key`` and whether its outline is ``short`` of each row ``(key, geometry)``."""
    most = SHORT

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = _short_rows(batch.column(1)) if most > 0 else np.zeros(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short)], names=["key", "short"])

    return features.mapInArrow(tell, StructType([features.schema["key"], StructField("short", BooleanType())]))


def _swept_totals(features: DataFrame, key: str, geometry: str) -> DataFrame:
    """``key`` and the sums over the boundary pieces of every geometry, however long and over however many rows; none where no piece is left."""
    pieces = boundary(features, key, geometry)
    c = F.col
    sign = F.when(c("below") % 2 == 0, -1.0).otherwise(1.0)
    ax, bx, ay, by = c("x1") - c("left"), c("x2") - c("left"), c("y1") - c("low"), c("y2") - c("low")
    aq, bq = authalic_zone("y1") - authalic_zone("low"), authalic_zone("y2") - authalic_zone("low")

    def sums(tag: str, y1: Column, y2: Column) -> list[Column]:
        strip = sign * (bx - ax)
        return [F.sum(strip * (y1 + y2) / 2).alias(f"{tag}0"), F.sum(strip / 6 * (y1 * (2 * ax + bx) + y2 * (ax + 2 * bx))).alias(f"{tag}x"),
                F.sum(strip / 6 * (y1 * y1 + y1 * y2 + y2 * y2)).alias(f"{tag}y")]

    total = pieces.groupBy("key").agg(F.first("left").alias("left"), F.first("low").alias("low"), *sums("p", ay, by), *sums("e", aq, bq))
    return features.select(c(key).alias("key")).distinct().join(_shuffled(total), "key", "left")


def footprints(features: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """Ground area and centroids of every geometry ``array<polygon>``, however its rings cross, touch or nest.

    Returns ``key``, ``area_sq_m`` (ellipsoidal), ``area_hectares``, the centroid ``lat``, ``lon`` of the longitude-latitude
    plane, ``lat_area``, ``lon_area`` weighted by area on the ellipsoid, and ``grid_ref`` of the former. A geometry without
    area (null, empty, a line) has area 0 and no centroid; vertices with a null coordinate are left out. Keys are expected once each; repeated keys are one geometry.
    """
    c = F.col
    shape = features.select(c(key).alias("key"), c(geometry).alias("geometry"))
    # Rows of one key are one geometry and have to meet; only keys travel to find them.
    met = _told_short(shape).groupBy("key").agg(F.count("*").alias("n"), F.min("short").alias("short"))
    met = met.filter("n > 1 OR NOT short OR key IS NULL").select("key")
    if met.isEmpty():
        rest, alone = shape.limit(0), shape
    else:
        met = save_table(met, "swept-keys")
        rest = save_table(shape.join(met, shape["key"].eqNullSafe(met["key"]), "left_semi"), "swept")
        alone = shape.filter("key IS NOT NULL").join(met, "key", "left_anti")
    every = _short_totals(alone).unionByName(_swept_totals(rest, "key", "geometry"))
    place = {
        "area_sq_m": F.radians(F.abs("e0")) * (WGS84_B**2 / 2),
        "lon": F.bround(c("left") + F.try_divide("px", "p0"), 6), "lat": F.bround(c("low") + F.try_divide("py", "p0"), 6),
        "lon_area": F.bround(c("left") + F.try_divide("ex", "e0"), 6),
        "lat_area": F.bround(_latitude(authalic_zone("low") + F.try_divide("ey", "e0")), 6),
    }
    every = every.withColumns(place)
    area = F.coalesce("area_sq_m", F.lit(0.0))
    return with_grid_ref(every.withColumn("area_sq_m", area).withColumn("area_hectares", hectares("area_sq_m")), "lat", "lon").select(
        c("key").alias(key), "area_sq_m", "area_hectares", "lat", "lon", "lat_area", "lon_area", "grid_ref")


# --- repaired rings -----------------------------------------------------------------------------------


def _ring_area(ring: list[tuple[float, float]]) -> float:
    x, y = np.array(ring).T
    return float(np.sum((x[:-1] - x[0]) * (y[1:] - y[0]) - (x[1:] - x[0]) * (y[:-1] - y[0]))) / 2


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    p = np.array(ring)
    (ax, ay), (bx, by) = p[:-1].T, p[1:].T
    over = (ay > y) != (by > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool(np.count_nonzero(over & (x < ax + (y - ay) / (by - ay) * (bx - ax))) % 2)


def rings_of(pieces: list[tuple[float, float, float, float, int]]) -> list[list[list[list[float]]]]:
    """Polygons (outer ring, then its holes) of one geometry's boundary pieces; rings that touch stay apart."""
    leaving: dict[tuple, list[tuple]] = {}
    for x1, y1, x2, y2, below in pieces:
        a, b = ((x1, y1), (x2, y2)) if below % 2 == 0 else ((x2, y2), (x1, y1))
        leaving.setdefault(a, []).append(b)
    rings = []
    for start in sorted(leaving):
        while leaving.get(start):
            ring, here = [start], leaving[start].pop()
            while here != start and leaving.get(here):
                back = np.arctan2(ring[-1][1] - here[1], ring[-1][0] - here[0])
                ring.append(here)
                ways = leaving[here]
                # The inside lies to the left: the next edge is the first one clockwise from where the ring came from.
                turn = [(back - np.arctan2(p[1] - here[1], p[0] - here[0])) % (2 * np.pi) or 2 * np.pi for p in ways]
                here = ways.pop(int(np.argmin(turn)))
            if here == start:  # a chain that rounding leaves open holds no area
                rings.append([*ring, start])
    # A ring that meets one of its own points is two rings.
    simple: list[list[tuple]] = []
    for ring in rings:
        stack: list[tuple] = []
        for p in ring:
            if p in stack:
                at = stack.index(p)
                simple.append([*stack[at:], p])
                stack = stack[:at]
            stack.append(p)
    shells = sorted((r for r in simple if _ring_area(r) > 0), key=_ring_area)
    polygons = [[r] for r in shells]
    for hole in (r for r in simple if _ring_area(r) < 0):
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        home = next((p for p in polygons if _holds(p[0], x, y)), None)
        if home is not None:
            home.append(hole)
    return [[[list(p) for p in ring] for ring in polygon] for polygon in polygons]


def repaired(features: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """``(key, geometry)`` with valid polygons: outer rings counter-clockwise, holes clockwise, nested by containment.

    Only the pieces of one geometry meet in a task. A geometry without area has an empty list.
    """
    pieces = boundary(features, key, geometry).select("key", *PIECE, "below")
    kind = pieces.schema["key"].dataType.simpleString()

    def build(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(part[[*PIECE, "below"]].itertuples(index=False, name=None))
        return pd.DataFrame({"key": part["key"].iloc[:1], "geometry": [rings_of(rows)]})

    made = pieces.groupBy("key").applyInPandas(build, f"key {kind}, geometry {MULTIPOLYGON}")
    every = features.select(F.col(key).alias("key")).distinct().join(_shuffled(made), "key", "left")
    return every.select(F.col("key").alias(key), F.coalesce("geometry", F.array().cast(MULTIPOLYGON)).alias("geometry"))
