"""Distance joins as equi-joins on grid cells, safe when many points share a place.

Tables carry ``lat``/``lon`` in degrees. A metric says how far two points are apart and
which cells can hold everything within a given distance. Cells holding more than
``HOT_CELL`` points are counted first and treated apart: pair output is salted on both
sides, while nearest/count/exists descend through nested sub-cells whose bounds decide
whole groups at once, so their work follows the number of probes and not of pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradrift.functions.geo import EARTH_RADIUS_M, haversine_m, tangent_x, tangent_y
from terradrift.session import save_table

HOT_CELL = 5_000
# Cells may be wider than the reach, and then fewer of them lie within it, while those a point shares its cell with stay few.
_WIDER = ((8, 8), (4, 32), (2, 128))
_ROUNDING = 1e-6  # of a cell
_SPLIT_BITS = 3  # each level halves a cell three times per axis
_MAX_LEVEL = 6
CELL = ["_cy", "_cx"]


def _steps(part: str, share: float, every: Column | None = None) -> Column:
    """Explodes to the neighbouring cells (-1, 0, 1) within ``share`` of a cell, ``part`` being the position inside the own one."""
    if share >= 1:
        return F.explode(F.lit([-1, 0, 1]))
    every = F.lit(False) if every is None else every
    below, above = (F.col(part) <= share + _ROUNDING) | every, (1 - F.col(part) <= share + _ROUNDING) | every
    near = F.when(below & above, F.lit([-1, 0, 1])).when(below, F.lit([-1, 0])).when(above, F.lit([0, 1])).otherwise(F.lit([0]))
    return F.explode(near)


@dataclass(frozen=True)
class Globe:
    """Great-circle distance; cells are latitude bands cut so that one cell spans the reach.

    Longitude wraps, so the date line needs no special care, and bands at the poles
    become a single cell. A latitude beyond a pole goes on along its meridian.
    """

    def distance(self, lat1, lon1, lat2, lon2) -> Column:
        return haversine_m(lat1, lon1, lat2, lon2)

    def point(self, lat: str, lon: str) -> list[Column]:
        """Earth-centred metres; straight-line distance grows with great-circle distance."""
        phi, lam = F.radians(lat), F.radians(lon)
        return [
            EARTH_RADIUS_M * F.cos(phi) * F.cos(lam), EARTH_RADIUS_M * F.cos(phi) * F.sin(lam), EARTH_RADIUS_M * F.sin(phi)
        ]

    def straight(self, metres: float) -> float:
        return 2 * EARTH_RADIUS_M * math.sin(min(metres / (2 * EARTH_RADIUS_M), math.pi / 2))

    def _band_height(self, size: float) -> float:
        return math.degrees(size / EARTH_RADIUS_M) * (1 + 1e-9)

    def _cells_in_band(self, band: Column, size: float) -> Column:
        height = self._band_height(size)
        edge = F.abs(F.pmod((band + 0.5) * height + 90.0, F.lit(180.0)) - 90.0) + 1.5 * height
        squeezed = math.sin(size / (2 * EARTH_RADIUS_M)) / F.cos(F.radians(F.least(edge, F.lit(89.999))))
        width = F.degrees(2 * F.asin(F.least(squeezed, F.lit(1.0)))) * (1 + 1e-9)
        return F.when(edge >= 89.999, 1.0).otherwise(F.greatest(F.floor(360.0 / width), F.lit(1)).cast("double"))

    def axes(self, lat: str, lon: str, size: float) -> tuple[Column, Column]:
        """Position in units of cells along both axes."""
        v = F.col(lat) / self._band_height(size)
        n = self._cells_in_band(F.floor(v), size)
        return v, F.least((F.pmod(F.col(lon) + 180.0, F.lit(360.0))) / 360.0 * n, n - 1e-9)

    def near_cells(self, points: DataFrame, size: float, lat: str, lon: str, reach: float) -> DataFrame:
        """Band and turn are computed once per point; only cheap arithmetic runs per copy."""
        place = F.col(lat) / self._band_height(size)
        band = F.floor(place)
        counts = F.array(*[self._cells_in_band(band + dy, size) for dy in (-1, 0, 1)])
        turn = F.pmod(F.col(lon) + 180.0, F.lit(360.0)) / 360.0
        once = points.withColumns({"_band": band, "_turn": turn, "_counts": counts, "_fy": place - band})
        rows = once.select("*", _steps("_fy", reach / size).alias("_dy")).withColumn("_n", F.col("_counts")[F.col("_dy") + 1])
        spot = F.least(F.col("_turn") * F.col("_n"), F.col("_n") - 1e-9)
        rows = rows.withColumns({"_here": F.floor(spot), "_fx": spot - F.floor(spot)})
        # The angle a distance spans grows no slower than its sine, so this share of a cell holds the reach.
        share = 1.0 if reach >= size else math.sin(reach / (2 * EARTH_RADIUS_M)) / math.sin(size / (2 * EARTH_RADIUS_M))
        copies = rows.select("*", _steps("_fx", share, F.col("_n") < 3).alias("_dx"))
        # A band of one or two cells has fewer distinct neighbours.
        real = (F.col("_n") >= 3) | (F.col("_dx") == 0) | ((F.col("_n") == 2) & (F.col("_dx") == 1))
        return copies.filter(real).select(
            *points.columns, (F.col("_band") + F.col("_dy")).alias("_cy"),
            F.pmod(F.col("_here") + F.col("_dx"), F.col("_n").cast("long")).alias("_cx"),
        )


@dataclass(frozen=True)
class Plane:
    """Distance in the plane touching the sphere at (lat0, lon0)."""

    lat0: float
    lon0: float

    def point(self, lat: str, lon: str) -> list[Column]:
        return [tangent_x(lon, self.lat0, self.lon0), tangent_y(lat, self.lat0), F.lit(0.0)]

    def distance(self, lat1, lon1, lat2, lon2) -> Column:
        dx = tangent_x(lon1, self.lat0, self.lon0) - tangent_x(lon2, self.lat0, self.lon0)
        dy = tangent_y(lat1, self.lat0) - tangent_y(lat2, self.lat0)
        return F.sqrt(dx * dx + dy * dy)

    def straight(self, metres: float) -> float:
        return metres

    def axes(self, lat: str, lon: str, size: float) -> tuple[Column, Column]:
        size = size * (1 + 1e-9)
        return tangent_y(lat, self.lat0) / size, tangent_x(lon, self.lat0, self.lon0) / size

    def near_cells(self, points: DataFrame, size: float, lat: str, lon: str, reach: float) -> DataFrame:
        ay, ax = self.axes(lat, lon, size)
        once = points.withColumns({"_y0": F.floor(ay), "_x0": F.floor(ax), "_fy": ay - F.floor(ay), "_fx": ax - F.floor(ax)})
        rows = once.select("*", _steps("_fy", reach / size).alias("_dy")).select("*", _steps("_fx", reach / size).alias("_dx"))
        return rows.select(
            *points.columns, (F.col("_y0") + F.col("_dy")).alias("_cy"), (F.col("_x0") + F.col("_dx")).alias("_cx")
        )


GLOBE = Globe()


def with_cell(points: DataFrame, size: float, metric=GLOBE, lat: str = "lat", lon: str = "lon") -> DataFrame:
    ay, ax = metric.axes(lat, lon, size)
    return points.withColumns({"_cy": F.floor(ay), "_cx": F.floor(ax)})


def with_near_cells(
    points: DataFrame, size: float, metric=GLOBE, lat: str = "lat", lon: str = "lon", reach: float | None = None
) -> DataFrame:
    """One copy of each point per cell that can hold something within ``reach`` of it, by default the size of a cell."""
    return metric.near_cells(points, size, lat, lon, size if reach is None else reach)


def _cell_size(points: DataFrame, radius_m: float, metric, lat: str, lon: str, hot_cell: int) -> tuple[float, bool]:
    """The size of cells for a reach of ``radius_m``, and whether some cell may hold more than ``hot_cell`` points.

    One count of points per wide cell tells both. Sparse points get cells wider than the reach, so that most probes meet
    one or two cells instead of nine.
    """
    widest = _WIDER[0][0] * radius_m
    if not 0 < widest <= EARTH_RADIUS_M / 4:
        return radius_m, True
    counts = with_cell(points, widest, metric, lat, lon).groupBy(*CELL).agg(F.count(lat).cast("double").alias("_n"))
    most, squares, rows = counts.agg(F.max("_n"), F.sum(F.col("_n") * F.col("_n")), F.sum("_n")).first()
    if not rows:
        return radius_m, False
    if most > hot_cell:
        return radius_m, True
    return radius_m * next((m for m, limit in _WIDER if squares / rows <= limit), 1), False


def _hot_cells(celled: DataFrame, limit: int) -> DataFrame | None:
    """Cells holding more than ``limit`` rows with their count ``_n``; None when there are none."""
    counts = celled.groupBy(*CELL).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    return save_table(counts, "hot-cells") if counts.take(1) else None


def distance_join(
    left: DataFrame,
    right: DataFrame,
    radius_m: float,
    metric=GLOBE,
    left_pos: tuple[str, str] = ("lat", "lon"),
    right_pos: tuple[str, str] = ("r_lat", "r_lon"),
    hot_cell: int = HOT_CELL,
) -> DataFrame:
    """All pairs within ``radius_m`` with their ``distance_m``; column names must not clash.

    The left side is copied to the cells in its reach, so pass the smaller table first. A crowded
    cell is cut into a grid of salts: each left row meets every right salt once, and tasks
    stay bounded although the pairs, which are the result, may be many.
    """
    size, crowded = _cell_size(right, radius_m, metric, *right_pos, hot_cell)
    probes = with_near_cells(left, size, metric, *left_pos, reach=radius_m)
    points = with_cell(right, size, metric, *right_pos)
    hot_right = _hot_cells(points, hot_cell) if crowded else None
    if hot_right is None:
        joined = probes.join(points, CELL)
    else:
        crowded_left = probes.groupBy(*CELL).agg(F.count("*").alias("_nl")).filter(F.col("_nl") > hot_cell)
        crowds = (
            hot_right.withColumnRenamed("_n", "_nr")
            .join(crowded_left, CELL, "left")
            .select(
                *CELL, F.ceil(F.col("_nr") / hot_cell).cast("int").alias("_sr"),
                F.ceil(F.coalesce("_nl", F.lit(1)) / hot_cell).cast("int").alias("_sl"),
            )
        )
        crowds = save_table(crowds, "crowds")
        one = F.lit(1)

        def salted(df: DataFrame, own: str, other: str, own_count: str, other_count: str) -> DataFrame:
            sized = df.join(crowds, CELL, "left")
            own_salt = F.floor(F.rand(7) * F.coalesce(own_count, one)).cast("int")
            all_salts = F.sequence(F.lit(0), F.coalesce(other_count, one) - 1)
            return sized.withColumn(own, own_salt).withColumn(other, F.explode(all_salts)).drop("_sr", "_sl")

        # The salt of a row must survive a task retry, so salted rows are written first.
        left_rows = save_table(salted(probes, "_a", "_b", "_sl", "_sr"), "salted")
        right_rows = save_table(salted(points, "_b", "_a", "_sr", "_sl"), "salted")
        joined = left_rows.join(right_rows, [*CELL, "_a", "_b"]).drop("_a", "_b")
    # The cells cover several times the circle; the latitude band drops a third for one subtraction.
    band = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    close = joined.filter(F.abs(F.col(left_pos[0]) - F.col(right_pos[0])) <= band)
    dist = metric.distance(*left_pos, *right_pos)
    return close.drop(*CELL).withColumn("distance_m", dist).filter(F.col("distance_m") <= radius_m)


# --- bounds of whole groups of points ---------------------------------------------------------


def _boxed_levels(points: DataFrame, size: float, metric) -> DataFrame:
    """Add straight-line coordinates and the finest sub-cell of each point."""
    ay, ax = metric.axes("_lat", "_lon", size)
    scale = float(1 << (_SPLIT_BITS * _MAX_LEVEL))
    xyz = dict(zip(("_x", "_y", "_z"), metric.point("_lat", "_lon")))
    return points.withColumns({**xyz, "_fy": F.floor(ay * scale), "_fx": F.floor(ax * scale)})


def _sub_cell(axis: str, level: int) -> Column:
    return F.shiftright(axis, _SPLIT_BITS * (_MAX_LEVEL - level))


def _summaries(points: DataFrame, level: int) -> DataFrame:
    """Point count and bounding box of every sub-cell of one level."""
    spans = [f(c).alias(f"{c}{tag}") for c in ("_x", "_y", "_z") for f, tag in ((F.min, "0"), (F.max, "1"))]
    return points.groupBy(
        *CELL, _sub_cell("_fy", level).alias("_sy"), _sub_cell("_fx", level).alias("_sx")
    ).agg(F.count("*").alias("_n"), *spans)


def _bounds(px=("_px", "_py", "_pz")) -> tuple[Column, Column]:
    """Smallest and largest possible straight distance from a probe to a summarised box."""
    near, far = F.lit(0.0), F.lit(0.0)
    for p, c in zip(px, ("_x", "_y", "_z")):
        lo, hi = F.col(p) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(p)
        gap = F.greatest(-lo, -hi, F.lit(0.0))
        reach = F.greatest(F.abs(lo), F.abs(hi))
        near, far = near + gap * gap, far + reach * reach
    return F.sqrt(near), F.sqrt(far)


def _renamed(points: DataFrame, ident: str) -> DataFrame:
    return points.select(F.col(ident).alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))


def _probes(left: DataFrame, ident: str, radius_m: float, size: float, metric) -> DataFrame:
    xyz = dict(zip(("_px", "_py", "_pz"), metric.point("lat", "lon")))
    base = left.select(F.col(ident).alias("_pid"), "lat", "lon").withColumns(xyz)
    return with_near_cells(base, size, metric, reach=radius_m)


_PROBE = ["_pid", "lat", "lon", "_px", "_py", "_pz"]
_SUB = [*CELL, "_sy", "_sx"]


def _descend(probes: DataFrame, points: DataFrame, decide, hot_cell: int):
    """Refine crowded cells level by level.

    ``decide(candidates)`` gets every (probe, sub-cell) with bounds ``_near``/``_far`` and
    returns (settled rows or None, rows to look into). Sub-cells with few points are handed
    over for point tests; others are split further. Returns the list of settled tables and
    the (probe, point) candidates that remain.
    """
    settled, tests = [], []
    frontier = probes
    join_keys = CELL
    for level in range(1, _MAX_LEVEL + 1):
        boxes = _summaries(points, level)
        if level > 1:
            boxes = boxes.withColumns(
                {"_qy": F.shiftright("_sy", _SPLIT_BITS), "_qx": F.shiftright("_sx", _SPLIT_BITS)}
            )
        near, far = _bounds()
        met = frontier.join(boxes, join_keys).withColumns({"_near": near, "_far": far})
        done, open_rows = decide(met)
        if done is not None:
            settled.append(save_table(done, "settled"))
        open_rows = save_table(open_rows.select(*_PROBE, *_SUB, "_n"), "open")
        few = open_rows if level == _MAX_LEVEL else open_rows.filter(F.col("_n") <= hot_cell)
        at_level = points.withColumns({"_sy": _sub_cell("_fy", level), "_sx": _sub_cell("_fx", level)})
        tests.append(few.drop("_n").join(at_level.select(*_SUB, "_id", "_lat", "_lon"), _SUB))
        frontier = open_rows.filter(F.col("_n") > hot_cell).select(
            *_PROBE, *CELL, F.col("_sy").alias("_qy"), F.col("_sx").alias("_qx")
        )
        join_keys = [*CELL, "_qy", "_qx"]
        if level == _MAX_LEVEL or frontier.isEmpty():
            break
    return settled, tests


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def nearest_join(
    left: DataFrame, right: DataFrame, radius_m: float, left_id: str, right_id: str, metric=GLOBE, hot_cell: int = HOT_CELL
) -> DataFrame:
    """Nearest right point of each left point within ``radius_m``: ``(left_id, right_id, distance_m)``.

    Equal distances go to the smaller right id, hence of several points at one exact place
    only the smallest id can win. Where cells are crowded the others are dropped up front.
    """
    places = _renamed(right, right_id)
    size, crowded = _cell_size(places, radius_m, metric, "_lat", "_lon", hot_cell)
    if crowded:
        places = save_table(places.groupBy("_lat", "_lon").agg(F.min("_id").alias("_id")), "places")
        size, crowded = _cell_size(places, radius_m, metric, "_lat", "_lon", hot_cell)
    places = with_cell(places, size, metric, "_lat", "_lon")
    probes = _probes(left, left_id, radius_m, size, metric)
    hot = _hot_cells(places, hot_cell) if crowded else None
    dist = metric.distance("lat", "lon", "_lat", "_lon")

    def best(pairs: DataFrame) -> DataFrame:
        close = pairs.select("_pid", "_id", dist.alias("_d")).filter(F.col("_d") <= radius_m)
        return close.groupBy("_pid").agg(F.min(F.struct("_d", "_id")).alias("_b"))

    if hot is None:
        found = best(probes.join(places, CELL))
    else:
        calm = probes.join(hot, CELL, "left_anti").join(places.join(hot, CELL, "left_anti"), CELL)
        crowd = _boxed_levels(places.join(hot.select(*CELL), CELL, "left_semi"), radius_m, metric)
        crowd = save_table(crowd, "crowd")
        reach = metric.straight(radius_m) * (1 + 1e-9)

        def decide(met: DataFrame):
            # Candidates of one probe: at most nine cells times the split, so the window is small.
            bound = F.min("_far").over(W.partitionBy("_pid"))
            keep = F.col("_near") <= F.least(F.col("_bound") * (1 + 1e-9) + 1e-6, F.lit(reach))
            return None, met.filter(F.col("_near") <= reach).withColumn("_bound", bound).filter(keep)

        _, tests = _descend(probes.join(hot.select(*CELL), CELL, "left_semi"), crowd, decide, hot_cell)
        cols = ["_pid", "lat", "lon", "_id", "_lat", "_lon"]
        found = best(_union([calm.select(*cols)] + [t.select(*cols) for t in tests]))
    return found.select(
        F.col("_pid").alias(left_id), F.col("_b._id").alias(right_id), F.col("_b._d").alias("distance_m")
    )


def count_within(
    left: DataFrame, right: DataFrame, radius_m: float, left_id: str, right_id: str, metric=GLOBE, hot_cell: int = HOT_CELL
) -> DataFrame:
    """Number of right points within ``radius_m`` of each left point that has any: ``(left_id, n)``.

    A left point is not counted as its own neighbour (equal ids).
    """
    points = _renamed(right, right_id)
    size, crowded = _cell_size(points, radius_m, metric, "_lat", "_lon", hot_cell)
    points = with_cell(points, size, metric, "_lat", "_lon")
    probes = _probes(left, left_id, radius_m, size, metric)
    hot = _hot_cells(points, hot_cell) if crowded else None
    dist = metric.distance("lat", "lon", "_lat", "_lon")

    def tally(pairs: DataFrame) -> DataFrame:
        close = pairs.filter((dist <= radius_m) & (F.col("_pid") != F.col("_id")))
        return close.groupBy("_pid").agg(F.count("*").alias("_k"))

    if hot is None:
        counts = tally(probes.join(points, CELL))
    else:
        points = save_table(points, "points")
        crowd = save_table(
            _boxed_levels(points.join(hot.select(*CELL), CELL, "left_semi"), radius_m, metric), "crowd"
        )
        reach = metric.straight(radius_m)
        slack = reach * 1e-9

        def decide(met: DataFrame):
            inside = met.filter(F.col("_far") <= reach - slack).groupBy("_pid").agg(F.sum("_n").alias("_k"))
            rim = met.filter((F.col("_far") > reach - slack) & (F.col("_near") <= reach + slack))
            return inside, rim

        calm = probes.join(hot, CELL, "left_anti").join(points.join(hot, CELL, "left_anti"), CELL)
        settled, tests = _descend(probes.join(hot.select(*CELL), CELL, "left_semi"), crowd, decide, hot_cell)
        # A settled group may hold the probe's own point; take it out unless it was tested singly.
        rim_pairs = _union(tests)
        whole = _union(settled).groupBy("_pid").agg(F.sum("_k").alias("_k"))
        mine = left.select(F.col(left_id).alias("_pid"), "lat", "lon")
        own = crowd.select(F.col("_id").alias("_pid"), "_lat", "_lon").join(mine, "_pid").filter(dist <= radius_m)
        own_tested = rim_pairs.filter(F.col("_pid") == F.col("_id")).select("_pid")
        minus = own.join(own_tested, "_pid", "left_anti").select("_pid", F.lit(-1).cast("long").alias("_k"))
        counts = (
            _union([tally(calm), tally(rim_pairs), whole, minus]).groupBy("_pid").agg(F.sum("_k").alias("_k"))
        )
    return counts.filter(F.col("_k") > 0).select(F.col("_pid").alias(left_id), F.col("_k").alias("n"))


def has_within(
    left: DataFrame, right: DataFrame, radius_m: float, left_id: str, right_id: str, metric=GLOBE, hot_cell: int = HOT_CELL
) -> DataFrame:
    """Left rows with at least one other right point within ``radius_m``."""
    near = count_within(left, right, radius_m, left_id, right_id, metric, hot_cell)
    return left.join(near.select(left_id), left_id, "left_semi")


def radius_query(nodes: DataFrame, lat: float, lon: float, radius_m: float, metric=GLOBE) -> DataFrame:
    """Nodes within ``radius_m`` of one place; the latitude band is a pushable predicate."""
    pad = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    d = metric.distance("lat", "lon", F.lit(lat), F.lit(lon))
    return nodes.filter(F.col("lat").between(lat - pad, lat + pad)).withColumn("distance_m", d).filter(
        F.col("distance_m") <= radius_m
    )


def bbox_query(nodes: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
    """Nodes inside a box, all sides included."""
    return nodes.filter(F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon))


def zone_join(nodes: DataFrame, zones: DataFrame, metric=GLOBE) -> DataFrame:
    """Nodes inside zones of individual radius; adds ``zone_name`` and ``distance_m``.

    Zones are joined level by level: those whose radius lies between two powers of two share one cell size, so a wide zone
    does not coarsen the cells of the others. There are as many joins as levels in use, a few dozen at most. Zones with a
    null or negative radius hold nothing.
    """
    level = F.ceil(F.log2(F.greatest("radius_m", F.lit(1.0)))).cast("int")
    centres = zones.select("zone_name", F.col("lat").alias("z_lat"), F.col("lon").alias("z_lon"), "radius_m", level.alias("_level"))
    centres = save_table(centres.filter("radius_m >= 0"), "zones")
    levels = [r[0] for r in centres.select("_level").distinct().collect()] or [0]

    def at(k: int) -> DataFrame:
        mine = centres.filter(F.col("_level") == k).drop("_level")
        pairs = distance_join(mine, nodes, float(2**k), metric, left_pos=("z_lat", "z_lon"), right_pos=("lat", "lon"))
        return pairs.filter(F.col("distance_m") <= F.col("radius_m")).drop("z_lat", "z_lon", "radius_m")

    return _union([at(k) for k in sorted(levels)])


def _top(pairs: DataFrame, owner: str, order: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(owner).orderBy(*order))
    return pairs.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")


def nearest_k(points: DataFrame, ident: str, k: int, max_distance_m: float, metric=GLOBE) -> DataFrame:
    """``(ident, other, distance_m)``: of every point the ``k`` nearest others within ``max_distance_m``, ties to the smaller id.

    The search widens in steps of four. A point starts at the finest step at which its cell holds more than ``k`` places, and
    stops as soon as ``k`` places lie within the step's radius; so each place meets a bounded number of starting points,
    whatever the density, and no list of all pairs within reach is made. Points at one exact place search as one.
    """
    me = points.select(F.col(ident).alias("_id"), "lat", "lon").filter("_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    me = save_table(me.join(me.groupBy("lat", "lon").agg(F.min("_id").alias("_spot")), ["lat", "lon"]), "knn-points")
    spots = save_table(me.filter("_id = _spot").select("_spot", "lat", "lon").distinct(), "knn-spots")
    members = save_table(_top(me.select("_id", "_spot").distinct(), "_spot", ["_id"], k + 1), "knn-members")
    steps = [float(max_distance_m)]
    while len(steps) < 12:
        fullest = with_cell(spots, steps[-1], metric).groupBy(*CELL).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (fullest or 0) <= 32 * (k + 1):
            break
        steps.append(steps[-1] / 4)
    others = spots.select(F.col("_spot").alias("_other"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    waiting, settled = spots, []
    for i, radius in reversed(list(enumerate(steps))):
        asking = waiting
        if i:
            full = with_cell(spots, radius, metric).groupBy(*CELL).agg(F.count("*").alias("n")).filter(F.col("n") > k)
            asking = with_cell(waiting, radius, metric).join(full, CELL, "left_semi").drop(*CELL)
        near = distance_join(asking, others, radius, metric).filter("_spot <> _other").select("_spot", "_other", "distance_m")
        best = save_table(_top(near, "_spot", ["distance_m", "_other"], k), "knn-best")
        done = best.groupBy("_spot").agg(F.count("*").alias("n")).filter(F.col("n") >= (k if i else 1)).select("_spot")
        settled.append(best.join(done, "_spot", "left_semi"))
        if i:
            waiting = save_table(waiting.join(done, "_spot", "left_anti"), "knn-waiting")
    mine = members.withColumnsRenamed({"_id": "_other_id", "_spot": "_other"})
    around = _union(settled).join(mine, "_other").select("_spot", "_other_id", "distance_m")
    own = members.select("_spot", F.col("_id").alias("_other_id"), F.lit(0.0).alias("distance_m"))
    listed = save_table(_top(around.unionByName(own), "_spot", ["distance_m", "_other_id"], k + 1), "knn-lists")
    pairs = me.select("_id", "_spot").distinct().join(listed, "_spot").filter("_id <> _other_id")
    best = _top(pairs, "_id", ["distance_m", "_other_id"], k)
    return best.select(F.col("_id").alias(ident), F.col("_other_id").alias("other"), "distance_m")
