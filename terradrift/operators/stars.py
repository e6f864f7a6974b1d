"""Triangulation neighbours of points that lie in one task's memory, in NumPy.

The star of a point are its neighbours in turn. A point at ``p`` from it is looked at as ``p / |p|^2``: neighbours are the corners
(and points on the sides) of the hull of these and the point itself, so a point outside the hull of those found so far is missing,
and the one farthest outside is a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points looked at together, how far around them as a share of their extent, and how many of the nearest are tested.
_PASSES = ((192, 0.4, 24), (48, 1.5, 64))
_NEAREST = 10
_TOGETHER = 512
_TIE = 1e-7
_AROUND = np.cos(np.arange(32) * np.pi / 16), np.sin(np.arange(32) * np.pi / 16)

Rect = tuple[float, float, float, float]  # left, right, bottom, top


def _tested(rx: np.ndarray, ry: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the points ``(rx, ry)`` about each row's point those beside which a circle through both stays free of the first of them,
    ``(tx, ty)``, and those whose smallest such circle does.

    Padding is at (0, 0), which bounds nothing.
    """
    ex, ey, same = rx[:, :, None], ry[:, :, None], np.eye(rx.shape[1], tx.shape[1], dtype=bool)[None]
    tx, ty = tx[:, None, :], ty[:, None, :]
    length2 = ex * ex + ey * ey
    length = np.sqrt(length2)
    power, turn = tx * tx + ty * ty - (ex * tx + ey * ty), ex * ty - ey * tx
    slack = length2 * 1e-12
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = power / (2 * turn) * length
    upper = np.where(turn > slack, centre, np.inf).min(2)
    lower = np.where(turn < -slack, centre, -np.inf).max(2)
    between = ((power < 0) & (np.abs(turn) <= slack) & ~same).any(2)
    power[np.broadcast_to(same, power.shape)] = np.inf
    nearest = np.sqrt(np.maximum((power + length2 / 4).min(2), 0))
    length = length[:, :, 0]
    keep = ~between & (lower <= upper + length * 1e-9)
    return keep, keep & ~(nearest < length / 2 * (1 - 1e-9) - 1e-6)


def _kept(rx: np.ndarray, ry: np.ndarray):
    """Neighbours among the points ``(rx, ry)`` about each row's point, the nearest first: their places, which of these are filled, and free edges.

    The few that stand beside the nearest include all neighbours, so these are then tested against each other only.
    """
    first, _ = _tested(rx, ry, rx[:, :_NEAREST], ry[:, :_NEAREST])
    some = np.argsort(~first, 1, kind="stable")[:, : max(int(first.sum(1).max(initial=0)), 1)]
    valid = np.take_along_axis(first, some, 1)
    sx, sy = (np.where(valid, np.take_along_axis(r, some, 1), 0) for r in (rx, ry))
    keep, free = _tested(sx, sy, sx, sy)
    return some, sx, sy, keep & valid, free & valid


def _circle(px, py, qx, qy):
    """Centre of the circle through (0, 0), p and q, and whether q lies less than half a turn after p."""
    turn, p2, q2 = px * qy - py * qx, px * px + py * py, qx * qx + qy * qy
    proper = turn > 1e-12 * np.sqrt(p2 * q2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (p2 * qy - q2 * py) / (2 * turn), (q2 * px - p2 * qx) / (2 * turn), proper


def _beside(g: tuple, dx, dy, left: bool, strict: np.ndarray):
    """Extent of the part of rectangles ``g`` about (0, 0) that lies to one side of the line through (0, 0), or on it if not ``strict``."""
    x0, x1, y0, y1 = g
    far = np.maximum(np.maximum(np.abs(x0), np.abs(x1)), np.maximum(np.abs(y0), np.abs(y1)))
    least = np.where(strict, 1e-12, -1e-12) * np.hypot(dx, dy) * far
    lo_x, hi_x, lo_y, hi_y = (np.full(np.broadcast(dx, x0).shape, v) for v in (np.inf, -np.inf, np.inf, -np.inf))
    some = np.zeros(lo_x.shape, bool)

    def meet(x, y, where):
        nonlocal lo_x, hi_x, lo_y, hi_y
        lo_x, hi_x = np.where(where, np.minimum(lo_x, x), lo_x), np.where(where, np.maximum(hi_x, x), hi_x)
        lo_y, hi_y = np.where(where, np.minimum(lo_y, y), lo_y), np.where(where, np.maximum(hi_y, y), hi_y)

    for x in (x0, x1):
        for y in (y0, y1):
            side = dx * y - dy * x
            inside = (side > least) if left else (side < -least)
            some |= inside
            meet(x, y, inside)
    with np.errstate(divide="ignore", invalid="ignore"):
        for x in (x0, x1):
            y = dy / dx * x
            meet(x, y, some & (y >= y0) & (y <= y1))
        for y in (y0, y1):
            x = dx / dy * y
            meet(x, y, some & (x >= x0) & (x <= x1))
    return lo_x, hi_x, lo_y, hi_y


def _open_extent(g: tuple, px, py, qx, qy):
    """Extent, in rectangles ``g``, of where a point could stand that would be a neighbour between p and q, and how far off at most."""
    cx, cy, proper = _circle(px, py, qx, qy)
    x0, x1, y0, y1 = g
    with np.errstate(invalid="ignore", over="ignore"):
        r = np.hypot(cx, cy)
        dx, dy = np.maximum(np.maximum(x0 - cx, cx - x1), 0), np.maximum(np.maximum(y0 - cy, cy - y1), 0)
        rounding = 1e-14 * r * r
        hx, hy = np.sqrt(np.maximum((r - dy) * (r + dy), 0) + rounding), np.sqrt(np.maximum((r - dx) * (r + dx), 0) + rounding)
        circle = np.maximum(cx - hx, x0), np.minimum(cx + hx, x1), np.maximum(cy - hy, y0), np.minimum(cy + hy, y1)
    wide = ~proper
    if wide.any():
        row, col = np.nonzero(wide)
        g = tuple(c[row, 0] for c in g)
        px, py, qx, qy = px[wide], py[wide], qx[wide], qy[wide]
        # Beyond more than half a turn a point may also stand on the line, behind.
        half = (np.abs(px * qy - py * qx) <= 1e-12 * np.hypot(px, py) * np.hypot(qx, qy)) & (px * qx + py * qy < 0)
        a, b = _beside(g, px, py, True, half), _beside(g, qx, qy, False, half)
        for c, v in zip(circle, (np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), np.minimum(a[2], b[2]), np.maximum(a[3], b[3]))):
            c[wide] = v
    return *circle, np.where(wide, np.inf, 2 * r)


def _turned(rx, ry, keep):
    """Neighbours of each row in turn, those after each, and which places are filled."""
    degree = keep.sum(1)
    order = np.argsort(np.where(keep, np.arctan2(ry, rx), np.inf), 1, kind="stable")[:, : max(int(degree.max(initial=0)), 1)]
    px, py = np.take_along_axis(rx, order, 1), np.take_along_axis(ry, order, 1)
    at = np.arange(order.shape[1])[None]
    after = np.where(at + 1 < degree[:, None], at + 1, 0)
    filled = at < degree[:, None]
    return px, py, np.take_along_axis(px, after, 1), np.take_along_axis(py, after, 1), filled


def _groups(px: np.ndarray, py: np.ndarray, todo: np.ndarray, size: int) -> Iterator[np.ndarray]:
    stack = [todo]
    while stack:
        part = stack.pop()
        if len(part) <= size:
            if len(part):
                yield part
            continue
        along = px if np.ptp(px[part]) >= np.ptp(py[part]) else py
        half = len(part) // 2
        order = np.argpartition(along[part], half)
        stack += [part[order[:half]], part[order[half:]]]


def _within(ext, rect: Rect, ux, uy):
    x0, x1, y0, y1 = ext[:4]
    inside = (x0 >= rect[0] - ux) & (x1 <= rect[1] - ux) & (y0 >= rect[2] - uy) & (y1 <= rect[3] - uy)
    return inside | (x0 > x1) | (y0 > y1)


def _about(rect: Rect, ux, uy, longest):
    x0, x1, y0, y1 = rect[0] - ux, rect[1] - ux, rect[2] - uy, rect[3] - uy
    if longest is None:
        return x0, x1, y0, y1
    return np.maximum(x0, -longest), np.minimum(x1, longest), np.maximum(y0, -longest), np.minimum(y1, longest)


def stars(x: np.ndarray, y: np.ndarray, todo: np.ndarray, window: Rect, box: Rect, longest: np.ndarray | None = None):
    """Edges ``(u, v, free)`` at the points ``todo`` among the given ones, and which of ``todo`` no point outside ``window`` can change.

    The points are all that lie in ``window``, all points at all lie in ``box``. ``free`` edges have an empty smallest circle. With
    ``longest`` only edges of that length at each point of ``todo`` matter.
    """
    if len(x) < 2:
        return *[np.zeros(0, int)] * 2, np.zeros(0, bool), np.ones(len(todo), bool)
    tight = (float(x.min()), float(x.max()), float(y.min()), float(y.max()))
    limit = None if longest is None else np.full(len(x), np.inf)
    if limit is not None:
        limit[todo] = longest
    us, vs, frees, closed = [], [], [], np.zeros(len(x), bool)

    def settle(u, nn, keep, free, turned):
        """Note the edges of whole stars and whether they stay."""
        px, py, qx, qy, filled = turned
        row, col = np.nonzero(keep)
        us.append(u[row])
        vs.append(nn[row, col])
        frees.append(free[row, col])
        ux, uy = x[u][:, None], y[u][:, None]
        ext = _open_extent(_about(box, ux, uy, None if limit is None else limit[u][:, None]), px, py, qx, qy)
        closed[u] = (_within(ext, window, ux, uy) | ~filled).all(1) & filled.any(1)

    left = todo
    for size, margin, k in _PASSES:
        missing, held = [], []

        def judge():
            """Settle those of the points held whose circles lie among the points looked at."""
            u, nn, reach, ground = (np.concatenate(a, -1 if i == 3 else 0) for i, a in enumerate(zip(*held)))
            held.clear()
            order, rx, ry, keep, free = _kept(x[nn] - x[u][:, None], y[nn] - y[u][:, None])
            nn = np.take_along_axis(nn, order, 1)
            turned = _turned(rx, ry, keep)
            ux, uy = x[u][:, None], y[u][:, None]
            far = None if limit is None else limit[u][:, None]
            ext = _open_extent(_about(tight, ux, uy, far), *turned[:4])
            span = np.minimum(np.hypot(np.maximum(np.abs(ext[0]), np.abs(ext[1])), np.maximum(np.abs(ext[2]), np.abs(ext[3]))), ext[4])
            span = np.where((ext[0] > ext[1]) | (ext[2] > ext[3]), 0, span if far is None else np.minimum(span, far))
            whole = (_within(ext, ground[:, :, None], ux, uy) & (span * (1 + 1e-9) <= reach[:, None])) | ~turned[4]
            whole = whole.all(1)
            missing.append(u[~whole])
            if whole.any():
                settle(u[whole], nn[whole], keep[whole], free[whole], tuple(t[whole] for t in turned))

        for u in _groups(x, y, left, size):
            x0, x1, y0, y1 = x[u].min(), x[u].max(), y[u].min(), y[u].max()
            more = max(x1 - x0, y1 - y0) * margin or max(tight[1] - tight[0], tight[3] - tight[2]) / 256
            wanted = min(2 * k, len(x))
            while True:
                near = np.nonzero((x >= x0 - more) & (x <= x1 + more) & (y >= y0 - more) & (y <= y1 + more))[0]
                if len(near) >= wanted:
                    break
                more *= 2
            ground = np.repeat([[x0 - more], [x1 + more], [y0 - more], [y1 + more]], len(u), 1)
            d2 = (x[near][None] - x[u][:, None]) ** 2 + (y[near][None] - y[u][:, None]) ** 2
            d2[near[None] == u[:, None]] = np.inf
            some = min(k, len(near) - 1)
            pick = np.argpartition(d2, sorted({min(_NEAREST, some) - 1, some - 1}), 1)[:, :some]
            reach = np.full(len(u), np.inf) if some == len(near) - 1 else np.sqrt(np.take_along_axis(d2, pick, 1).max(1))
            if held and held[0][1].shape[1] != some:
                judge()
            held.append((u, near[pick], reach, ground))
            if sum(len(h[0]) for h in held) >= _TOGETHER:
                judge()
        if held:
            judge()
        left = np.concatenate(missing) if missing else left[:0]
    for u in left:
        rx, ry = x - x[u], y - y[u]
        nn = _star(rx, ry, int(u), _about(tight, x[u], y[u], None))
        order, sx, sy, keep, free = _kept(rx[nn][None], ry[nn][None])
        settle(np.array([u]), nn[order], keep, free, _turned(sx, sy, keep))
    none = np.zeros(0, int)
    joined = [np.concatenate(a) if a else none for a in (us, vs, frees)]
    return joined[0], joined[1], joined[2].astype(bool), closed[todo]


def _star(rx: np.ndarray, ry: np.ndarray, u: int, ground: tuple) -> np.ndarray:
    """Points among which all neighbours of point ``u`` are, by looking at all points; the nearest first."""
    r2 = rx * rx + ry * ry
    r2[u] = np.inf
    some = min(_PASSES[-1][2], len(rx) - 1)
    ix, iy = rx / r2, ry / r2
    found = [*np.argpartition(r2, some - 1)[:some].tolist(), *np.argmax(np.outer(ix, _AROUND[0]) + np.outer(iy, _AROUND[1]), 0).tolist()]
    found = list(dict.fromkeys(i for i in found if i != u))
    seen, every = {u, *found}, None
    while True:
        nn = np.array(found)
        nn = nn[np.argsort(r2[nn], kind="stable")]
        _, sx, sy, keep, _ = _kept(rx[nn][None], ry[nn][None])
        px, py, qx, qy, filled = (a[0] for a in _turned(sx, sy, keep))
        if every is None:  # only points where circles are can be missing
            ext = _open_extent(tuple(np.array([[v]]) for v in ground), *(a[None] for a in (px, py, qx, qy)))
            lo_x, hi_x, lo_y, hi_y = (f(e[0][filled]) for f, e in zip((np.min, np.max, np.min, np.max), ext))
            more = 1e-6 * max(hi_x - lo_x, hi_y - lo_y, 0.0)
            every = np.nonzero((rx >= lo_x - more) & (rx <= hi_x + more) & (ry >= lo_y - more) & (ry <= hi_y + more))[0]
        cx, cy, proper = _circle(px, py, qx, qy)
        outside, fresh = np.zeros(len(every), bool), []
        ex, ey, e2 = ix[every], iy[every], r2[every]
        for g in np.nonzero(filled)[0]:
            if proper[g]:
                over = 2 * (cx[g] * ex + cy[g] * ey) - 1
                fresh += every[np.abs(over) <= _TIE].tolist()
                over = [np.where(over > _TIE, over, 0)]
                outside |= over[0] > 0
            else:
                over = []
                for dx, dy, sign in ((px[g], py[g], 1), (qx[g], qy[g], -1)):
                    d = np.hypot(dx, dy)
                    off = sign * (dx * ey - dy * ex) / d
                    level = 1e-12 / np.sqrt(e2)
                    over.append(np.where(off > level, off, 0))
                    # Behind, on the line, the nearest is a neighbour.
                    behind = (np.abs(off) <= level) & (dx * ex + dy * ey < 0)
                    if behind.any():
                        at = np.nonzero(behind)[0]
                        fresh.append(int(every[at[np.argmin(e2[at])]]))
                    outside |= (off > level) | behind
            for o in over:
                if o.any():
                    fresh.append(int(every[np.argmax(o)]))
        fresh = [i for i in dict.fromkeys(fresh) if i not in seen]
        if not fresh:
            break
        seen.update(fresh)
        found += fresh
        every = every[outside]
    found = np.array(found, int)
    return found[np.argsort(r2[found], kind="stable")]
