"""Delaunay edges of a point table, block by block.

An edge belongs to the triangulation when some circle through both ends holds no other
point. All neighbours of a point, its star, follow from the points in the circles through it
and two neighbours in turn, so mostly from points close by.

1. The plane is cut into squares, quartered until each holds few points. Every point goes to its
   own block and to those that see it in their margin, a sixteenth of a block's side. This is the
   one time that points are shuffled.
2. A task finds the stars of its block's own points among those it sees. A point whose circles
   all lie within its margin, as far as there are points at all, is closed: its edges are final.
3. Points left open, and the neighbours of each, are few: they lie along the rim or beside wide
   gaps. They go through the same steps in blocks that hold as many of them, so the blocks grow until one sees all.
   A point's true neighbours are always among those that stay, and a wrong edge would cross the triangles
   between them, so later rounds are exact.

Corners of an exact rectangle keep both diagonals. Of several points at one place only the
one with the smallest id takes part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, StructField, StructType

from terradrift.functions.geo import EARTH_RADIUS_M, tangent_x, tangent_y
from terradrift.operators.stars import Rect, stars
from terradrift.session import save_table

BLOCK_POINTS = 32_768
RIM_POINTS = 4_096  # in blocks of the second round, twice as many each time after
_DEPTH = 28  # the finest squares
_DEEPER = 2  # levels that one count goes further down
_MARGIN = 1 / 16
_TASKS = 2000
_EDGE, _FROM_A, _FROM_B, _POINT = range(4)
_PLACE = ["x", "y"]


def plane_reach(lat: str, lon: str, metres: float, lat0: float, lon0: float) -> Column:
    """Length in the plane about (lat0, lon0) of the longest way from a place to another within ``metres`` on the globe.

    Infinite where a pole or the far meridian of the plane's longitudes is that near.
    """
    angle = metres / EARTH_RADIUS_M
    # Latitudes may pass a pole; the cosine is smallest at the end that is nearer to one.
    polar = F.abs(F.pmod(F.radians(lat), F.lit(math.pi)) - math.pi / 2)
    squeezed = math.sin(min(angle, math.pi) / 2) / F.sin(polar - angle)
    turn = 2 * F.asin(F.least(squeezed, F.lit(1.0)))
    length = EARTH_RADIUS_M * F.sqrt(angle * angle + (turn * math.cos(math.radians(lat0))) ** 2) * (1 + 1e-6)
    apart = (polar > angle) & (squeezed < 1) & (F.abs(F.radians(lon)) + turn < math.pi)
    return F.when(apart, length).otherwise(F.lit(float("inf")))


class _Blocks:
    """Squares ``(level, row, column)`` that share out the plane, and which of them see a place."""

    def __init__(self, cells: list[tuple[int, int, int]], left: float, low: float, extent: float):
        self.left, self.low, self.extent = left, low, extent
        at = sorted((self._code(np.array([cy], np.int64), np.array([cx], np.int64), k)[0], k, cy, cx) for k, cy, cx in cells)
        self.starts = np.array([c[0] for c in at], np.int64)
        self.level, self.row, self.col = (np.array([c[i] for c in at], np.int64) for i in (1, 2, 3))
        self.levels = sorted(set(self.level.tolist()))

    @staticmethod
    def _code(cy: np.ndarray, cx: np.ndarray, level: int) -> np.ndarray:
        """Place of the first finest square of a square on a curve that leaves no square before it is through."""

        def spread(v: np.ndarray) -> np.ndarray:
            v = v.astype(np.uint64) << np.uint64(_DEPTH - level)
            for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
                v = (v | (v << np.uint64(shift))) & np.uint64(mask)
            return v

        return (spread(cx) | (spread(cy) << np.uint64(1))).astype(np.int64)

    def _square(self, v: np.ndarray, start: float, level: int) -> np.ndarray:
        cells = np.floor((v - start) * (2.0**_DEPTH / self.extent)).astype(np.int64)
        return np.clip(cells, 0, 2**_DEPTH - 1) >> (_DEPTH - level)

    def own(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        code = self._code(self._square(y, self.low, _DEPTH), self._square(x, self.left, _DEPTH), _DEPTH)
        return np.searchsorted(self.starts, code, "right") - 1

    def seeing(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of places and the blocks in whose window each lies; a little more than that does no harm."""
        rows, blocks = [], []
        every = np.arange(len(x))
        for k in self.levels:
            m = self.extent / 2.0**k * _MARGIN * (1 + 1e-9)
            here = []
            for dy in (-m, m):
                for dx in (-m, m):
                    cy, cx = self._square(y + dy, self.low, k), self._square(x + dx, self.left, k)
                    found = np.searchsorted(self.starts, self._code(cy, cx, k), "right") - 1
                    hit = (self.level[found] == k) & (self.row[found] == cy) & (self.col[found] == cx)
                    here.append(np.where(hit, found, -1))
            here = np.sort(np.stack(here, 1), 1)
            here[:, 1:][here[:, 1:] == here[:, :-1]] = -1
            hit = here >= 0
            rows.append(np.repeat(every, hit.sum(1)))
            blocks.append(here[hit])
        return np.concatenate(rows), np.concatenate(blocks)

    def window(self, block):
        """Left, right, low and top of what blocks see."""
        side = self.extent / 2.0 ** self.level[block]
        x0, y0, m = self.left + self.col[block] * side, self.low + self.row[block] * side, side * _MARGIN
        return x0 - m, x0 + side + m, y0 - m, y0 + side + m


@dataclass
class _Round:
    """Points, how they are dealt, and what is asked; ``later`` points say how often they stand and whether they are open."""

    points: DataFrame | None
    blocks: _Blocks
    box: Rect
    payload: list[str]
    lat0: float
    lon0: float
    free_only: bool
    later: bool


def _flat(t: pa.Table | pa.RecordBatch, lat0: float, lon0: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in the plane, as :func:`tangent_x` and :func:`tangent_y` have them."""
    x = np.radians(t["lon"].to_numpy() - lon0) * (EARTH_RADIUS_M * math.cos(math.radians(lat0)))
    return x, np.radians(t["lat"].to_numpy() - lat0) * EARTH_RADIUS_M


def _blocks(points: DataFrame, box: tuple, most: int, before: _Blocks | None) -> _Blocks:
    """Squares of at most ``most`` points each, or of the finest level, none smaller than ``before``; only counts of crowded squares' quarters come to the driver."""
    whole = set() if before is None else set(zip(before.level.tolist(), before.row.tolist(), before.col.tolist()))
    left, right, low, top, n = box
    extent = max(right - left, top - low, 1.0) * (1 + 1e-9)
    cell = {c: F.greatest(F.least(F.floor((F.col(v) - start) * (2.0**_DEPTH / extent)), F.lit(2**_DEPTH - 1)), F.lit(0)) for c, v, start in (("iy", "y", low), ("ix", "x", left))}
    placed = points.select(*[c.alias(k) for k, c in cell.items()])

    def at(k: int) -> list[Column]:
        return [F.shiftright(c, _DEPTH - k).cast("long").alias(name) for c, name in (("iy", "cy"), ("ix", "cx"))]

    crowded, done, level = ([(0, 0)], [], 0) if n > most and (0, 0, 0) not in whole else ([], [(0, 0, 0)], 0)
    while crowded:
        deeper = min(level + _DEEPER + (level == 0), _DEPTH)
        inside = placed
        if level:
            wanted = points.sparkSession.createDataFrame(crowded, "cy long, cx long")
            inside = placed.select("*", *at(level)).join(wanted, ["cy", "cx"], "left_semi").select("iy", "ix")
        counts = {(r.cy, r.cx): r["count"] for r in inside.groupBy(*at(deeper)).count().collect()}
        sums = {deeper: counts}
        for k in range(deeper - 1, level, -1):
            sums[k] = {}
            for (cy, cx), c in sums[k + 1].items():
                sums[k][cy >> 1, cx >> 1] = sums[k].get((cy >> 1, cx >> 1), 0) + c
        for k in range(level + 1, deeper + 1):
            split = []
            for cy, cx in crowded:
                for child in ((2 * cy + i, 2 * cx + j) for i in (0, 1) for j in (0, 1)):
                    if sums[k].get(child, 0) > most and k < _DEPTH and (k, *child) not in whole:
                        split.append(child)
                    else:
                        done.append((k, *child))
            crowded = split
        level = deeper
    return _Blocks(done, left, low, extent)


def _members(t: pa.Table, payload: list[str], lat0: float, lon0: float, later: bool) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of one block that stand for their places, in order of places, with the first row and the number of rows of each place."""
    x, y = _flat(t, lat0, lon0)
    t = t.append_column("x", pa.array(x)).append_column("y", pa.array(y))
    if not later:
        t = t.append_column("copies", pa.array(np.ones(len(x), np.int64))).append_column("live", pa.array(np.ones(len(x), np.int8)))
    order = np.lexsort((y, x))
    fresh = np.ones(len(x), bool)
    fresh[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    if fresh.all():
        return t.take(order), np.arange(len(x)), np.ones(len(x), np.int64)
    # Equal rows are counted once for all; later they come from several blocks.
    t = t.group_by([*payload, *_PLACE]).aggregate([("copies", "max" if later else "sum"), ("live", "max"), *([("longest", "max")] if "longest" in t.column_names else [])])
    t = t.rename_columns([c.removesuffix("_max").removesuffix("_sum") for c in t.column_names])
    t = t.take(pc.sort_indices(t, [("x", "ascending"), ("y", "ascending"), (payload[0], "ascending")]))
    x, y = (t[c].to_numpy() for c in _PLACE)
    fresh = np.ones(len(x), bool)
    fresh[1:] = (np.diff(x) != 0) | (np.diff(y) != 0)
    first = np.nonzero(fresh)[0]
    ids = t[payload[0]].to_numpy(zero_copy_only=False)
    keep = ids == ids[first][np.cumsum(fresh) - 1]
    live = np.maximum.reduceat(t["live"].to_numpy(), first)
    t = t.set_column(t.column_names.index("live"), "live", pa.array(live[np.cumsum(fresh) - 1], pa.int8())).filter(pa.array(keep))
    first = np.nonzero(fresh[keep])[0]
    return t, first, np.diff(np.append(first, t.num_rows))


def _solved(t: pa.Table, r: _Round) -> pa.Table:
    """Final edges of a block, and the points that the next round needs."""
    blocks, payload, block = r.blocks, r.payload, t["block"][0].as_py()
    t, first, count = _members(t.drop(["block"]), payload, r.lat0, r.lon0, r.later)
    x, y, live = (t[c].to_numpy()[first] for c in ("x", "y", "live"))
    home = blocks.own(x, y)
    mine = home == block
    todo = np.nonzero(mine & (live > 0))[0]
    longest = t["longest"].to_numpy()[first][todo] if "longest" in t.column_names else None
    window = tuple(float(v) for v in blocks.window(block))
    u, v, free, closed = stars(x, y, todo, window, r.box, longest) if len(todo) else (*[np.zeros(0, int)] * 2, *[np.zeros(0, bool)] * 2)
    shut = np.zeros(len(x), bool)
    shut[todo] = closed
    # A point stays open, too, if it has a neighbour in a block that does not see it.
    out = np.nonzero(~mine[v] & (live[v] > 0))[0]
    x0, x1, y0, y1 = blocks.window(home[v[out]])
    unseen = (x[u[out]] < x0) | (x[u[out]] > x1) | (y[u[out]] < y0) | (y[u[out]] > y1)
    shut[u[out[unseen]]] = False
    ids = t[payload[0]].to_numpy(zero_copy_only=False)[first]
    smaller = ids[u] < ids[v] if len(u) else np.zeros(0, bool)
    smaller = smaller.astype(bool)
    # Inside a block an edge is told by its smaller end, or the other if that stays open. Neighbours that closed before have told theirs.
    inner = mine[v] & (live[v] > 0)
    tell = shut[u] & (live[v] > 0) & (ids[u] != ids[v]).astype(bool) & (~inner | smaller | ~shut[v])
    if r.free_only:
        tell &= free
    a, b = np.where(smaller, u, v)[tell], np.where(smaller, v, u)[tell]
    kind = np.where(inner, _EDGE, np.where(smaller, _FROM_A, _FROM_B))[tell]
    # The next round needs open points and their neighbours.
    stay = np.zeros(len(x), np.int8)
    stay[v[~shut[u]]] = 1
    stay[todo[~shut[todo]]] = 2
    left = np.nonzero(stay)[0]

    def rows(p: np.ndarray, q: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of places, each of one with each of the other."""
        n, m = count[p], np.ones(len(p), np.int64) if q is None else count[q]
        at = np.repeat(np.arange(len(p)), n * m)
        i = np.arange(len(at)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        return at, first[p[at]] + i // m[at], first[p[at] if q is None else q[at]] + i % m[at]

    at, ra, rb = rows(a, b)
    copies = t["copies"].to_numpy()
    if len(copies) and copies.max() > 1:
        times = copies[ra] * copies[rb]
        at, ra, rb = (np.repeat(z, times) for z in (at, ra, rb))
    pt, rp, _ = rows(left, None)
    nothing = np.full(len(rp), -1)
    take_a, take_b = pa.array(np.concatenate([ra, rp])), pa.array(np.concatenate([rb, nothing]), mask=np.concatenate([np.zeros(len(rb), bool), nothing < 0]))
    mark = np.concatenate([kind[at], np.full(len(rp), _POINT)]).astype(np.int8)
    told = np.concatenate([np.zeros(len(ra), np.int8), (stay[left][pt] == 2).astype(np.int8)])
    plain = t.select(payload).combine_chunks()
    columns = {"kind": pa.array(mark), "live": pa.array(told), "copies": t["copies"].take(take_a)}
    columns |= {f"a_{c}": plain[c].take(take_a) for c in payload} | {f"b_{c}": plain[c].take(take_b) for c in payload}
    return pa.table(columns)


def _candidates(r: _Round) -> DataFrame:
    """Rows of kind ``_EDGE``, ``_FROM_A`` or ``_FROM_B``, edges with the points ``a_`` and ``b_``, and ``_POINT``, points ``a_`` that stay."""
    plain, points = replace(r, points=None), r.points

    def deal(batches):
        for batch in batches:
            rows, block = plain.blocks.seeing(*_flat(batch, plain.lat0, plain.lon0))
            dealt = pa.table(batch.take(pa.array(rows)).columns, names=batch.schema.names)
            yield from dealt.append_column("block", pa.array(block.astype(np.int32))).to_batches()

    sides = [StructField(f"{side}_{c}", points.schema[c].dataType) for side in "ab" for c in r.payload]
    dealt = points.mapInArrow(deal, StructType([*points.schema.fields, StructField("block", IntegerType())]))
    schema = StructType([StructField("kind", ByteType()), StructField("live", ByteType()), StructField("copies", LongType()), *sides])
    # Blocks are few but heavy: left to the size of their rows they would share a task.
    return dealt.repartition(min(2 * len(r.blocks.starts), _TASKS), "block").groupBy("block").applyInArrow(lambda t: _solved(t, plain), schema)


def delaunay_pairs(
    nodes: DataFrame, lat0: float, lon0: float, keep: Callable[[DataFrame], DataFrame], kept: Sequence[str], carry: Sequence[str] = (),
    ident: str = "node_id", within_m: float | None = None, free_only: bool = False,
) -> DataFrame:
    """Delaunay edges of all nodes in the plane about (lat0, lon0), as ``keep`` makes them: its columns ``kept``.

    ``keep`` gets pairs with the columns ``ident``, ``lat``, ``lon`` and ``carry`` of both ends after ``a_`` and ``b_``, a before b, and adds
    columns, of which a false ``near`` leaves a pair out. Rows that repeat a node's id and place are each paired. With ``free_only`` edges are left out
    whose smallest circle holds a node by more than a micrometre. With ``within_m`` only pairs that near on the globe are looked at: all
    edges of that length are among the result, but also longer pairs that only far points rule out; ``keep`` leaves those out.
    """
    payload = [ident, "lat", "lon", *carry]
    longest = [] if within_m is None else [plane_reach("lat", "lon", within_m, lat0, lon0).alias("longest")]
    known = F.col(ident).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    rows, marks = nodes.filter(known).select(*payload), []
    place = [tangent_x("lon", lat0, lon0).alias("x"), tangent_y("lat", lat0).alias("y")]
    box = rows.select(*place).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    most, out, blocks = BLOCK_POINTS, None, None
    while True:
        n = box[4] if out is None else rows.count()
        blocks = _blocks(rows.select(*place), (*box[:4], n), most, blocks)
        points = rows.select(*payload, *marks, *longest)
        told = _candidates(_Round(points, blocks, tuple(box[:4]), payload, lat0, lon0, free_only, out is not None))
        edge = F.col("kind") < _POINT
        # The same edge may be told by both of its ends' blocks; the places keep apart nodes of one id.
        twin = F.when(F.col("kind").between(_FROM_A, _FROM_B), F.xxhash64("a_lat", "a_lon", "b_lat", "b_lon")).alias("twin")
        stay = [F.when(~edge, F.col(f"a_{c}")).alias(f"a_{c}") for c in payload]
        made = keep(told).filter(~edge | F.col("near")).select("kind", "live", "copies", twin, *stay, *[F.when(edge, F.col(c)).alias(c) for c in kept])
        made = save_table(made, "delaunay")
        first, second = made.filter(F.col("kind") == _FROM_A), made.filter(F.col("kind") == _FROM_B)
        second = second.join(first.select("twin", *kept[:2]).distinct(), ["twin", *kept[:2]], "left_anti")
        edges = made.filter(F.col("kind") <= _FROM_A).select(*kept).unionByName(second.select(*kept))
        out = edges if out is None else out.unionByName(edges)
        if len(blocks.starts) == 1:
            return out
        rows = made.filter(~edge).groupBy(*[F.col(f"a_{c}").alias(c) for c in payload]).agg(F.max("live").alias("live"), F.max("copies").alias("copies"))
        rows, marks, most = save_table(rows, "open-points"), ["live", "copies"], RIM_POINTS if most == BLOCK_POINTS and not marks else most * 2
        if rows.filter("live = 1").isEmpty():
            return out
