"""Triangulation in blocks: many small blocks and rounds give the stars of one, and few rows are written."""

import numpy as np
import pytest
from helpers import haversine

from terradrift.operators import graph, triangulate
from terradrift.operators.stars import stars


def edges_of(x, y):
    """Pairs beside which some circle through both holds no other point; and whether their smallest circle does."""
    out = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            ex, ey = x[j] - x[i], y[j] - y[i]
            length = np.hypot(ex, ey)
            px, py = np.delete(x - (x[i] + x[j]) / 2, [i, j]), np.delete(y - (y[i] + y[j]) / 2, [i, j])
            along, side = (px * ex + py * ey) / length, (py * ex - px * ey) / length
            power, on = along**2 + side**2 - length**2 / 4, np.abs(side) <= length * 1e-12
            if (on & (power < 0)).any():
                continue
            with np.errstate(all="ignore"):
                centre = power / (2 * side)
            if centre[(side < 0) & ~on].max(initial=-np.inf) <= centre[(side > 0) & ~on].min(initial=np.inf) + length * 1e-9:
                out[i, j] = not (np.hypot(px, py) < length / 2 * (1 - 1e-9) - 1e-6).any()
    return out


def sets():
    rng = np.random.default_rng(31)
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    return {
        "spread": rng.random((150, 2)) * 1000, "strip": rng.random((150, 2)) * [100, 5000], "grid": np.array([(i, j) for i in range(12) for j in range(9)]) * 100.0,
        "circle": np.stack([np.cos(t), np.sin(t)], 1) * 1000, "line": np.array([(3.0 * i, 2.0 * i) for i in range(40)] + [(-1500.0, -1000.0)]),
        "dense": np.vstack([rng.random((60, 2)) * 500, 300 + rng.random((40, 2)) * 1e-4]), "two": np.array([[0.0, 0.0], [1.0, 1.0]]),
    }


@pytest.mark.parametrize("kind", list(sets()))
def test_stars_equal_brute_force(kind):
    x, y = sets()[kind].T.copy()
    box = (x.min(), x.max(), y.min(), y.max())
    u, v, free, closed = stars(x, y, np.arange(len(x)), box, box)
    want = edges_of(x, y)
    assert closed.all() and {(a, b) for a, b in zip(u.tolist(), v.tolist()) if a < b} == set(want)
    assert {(a, b) for a, b, f in zip(u.tolist(), v.tolist(), free) if a < b and f} == {e for e, f in want.items() if f}


def test_small_blocks_and_many_rounds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(triangulate, "BLOCK_POINTS", 40, raising=False)
    monkeypatch.setattr(triangulate, "RIM_POINTS", 60, raising=False)
    rng = np.random.default_rng(32)
    p = np.vstack([rng.random((260, 2)) * [0.05, 0.03], rng.random((60, 2)) * 0.002 + 0.01, np.array([(i, j) for i in range(6) for j in range(6)]) * 0.0005 + 0.06]) + [34.0, 75.0]
    rows = [(f"n{(i * 7919) % 10007:05d}", "Structure", float(a), float(b), "2024-01-15") for i, (a, b) in enumerate(p)]
    schema = "node_id string, class string, lat double, lon double, epoch string"
    twice = [rows[0], ("zz", "Road", *rows[1][2:]), ("null", "Road", None, 75.0, None)]  # a row again, another node at a place, one without a place
    nodes = spark.createDataFrame(rows + twice, schema).repartition(3)
    x, y = np.radians(p[:, 1] - 75.0) * 6371000 * np.cos(np.radians(34.0)), np.radians(p[:, 0] - 34.0) * 6371000
    found, times = edges_of(x, y), lambda i, j: 2 if 0 in (i, j) else 1
    for network, wanted in ((graph.triangulated_network, found), (graph.gabriel_network, [e for e, f in found.items() if f])):
        near = [(i, j) for i, j in wanted if haversine(*p[i], *p[j]) <= 1500]
        want = sorted(tuple(sorted((rows[i][0], rows[j][0]))) for i, j in near for _ in range(times(i, j)))
        assert sorted((r["source_id"], r["target_id"]) for r in network(nodes, 1500.0, 34.0, 75.0).collect()) == want


def test_few_rows_are_written(spark, monkeypatch):
    """Each row written or shuffled counts on disk: once as much as the points and their edges, not a hundredfold."""
    counted, save = [], triangulate.save_table

    def counting(df, name, *a):
        out = save(df, name, *a)
        counted.append(out.count())
        return out

    monkeypatch.setattr(triangulate, "save_table", counting)
    monkeypatch.setattr(graph, "save_table", counting)
    rng, n = np.random.default_rng(33), 3000
    nodes = spark.createDataFrame([(f"n{i}", "Road", float(a), float(b), 0) for i, (a, b) in enumerate(rng.random((n, 2)) * 0.1 + [34, 75])],
                                  "node_id string, class string, lat double, lon double, epoch int")
    assert graph.triangulated_network(nodes, 5000.0, 34.0, 75.0).count() > 2.9 * n and sum(counted) < 5 * n
    counted.clear()
    assert graph.gabriel_network(nodes, 5000.0, 34.0, 75.0).count() > 1.5 * n and sum(counted) < 5 * n
