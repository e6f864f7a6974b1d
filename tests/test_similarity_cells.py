"""Cell-pruned similarity search against brute force: clusters, ties, odd vectors, share of cells opened."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradrift.operators import similarity_cells
from terradrift.operators.similarity_cells import build_cells, top_similar, visited_similar

ITEM = "item_id long, item_vec array<double>, v int, cell int, block int"
QUERY = "query_id string, query_vec array<double>, q int"


def brute(queries, items, k):
    ok = [(i, np.array(v) / np.linalg.norm(v)) for i, v in items if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in queries:
        if v is None or not any(v):
            continue
        u = np.array(v) / np.linalg.norm(v)
        rows = sorted((-round(float(u @ w), 10), i) for i, w in ok)[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(rows)}
    return out


def data(spread, n=1500, dim=8):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, dim))
    x = np.repeat(centre, n // 12, 0) + rng.normal(size=(n // 12 * 12, dim)) * spread
    items = [(i, v.tolist()) for i, v in enumerate(x)]
    items += [(5000 + i, [1.0] + [0.0] * (dim - 1)) for i in range(40)]  # one vector many times
    items += [(6000, None), (6001, [0.0] * dim), (6002, [None] * dim), (6003, [float("nan")] * dim), (6004, [float("inf")] * dim)]
    queries = [(f"q{i}", (v + rng.normal(size=dim) * spread).tolist()) for i, v in enumerate(centre)]
    queries += [("tie", [3.0] + [0.0] * (dim - 1)), ("none", None), ("zero", [0.0] * dim), ("far", (-centre.sum(0)).tolist())]
    return queries, items


@pytest.mark.parametrize("spread", [0.05, 2.0])
@pytest.mark.parametrize("k", [1, 7])
def test_equals_brute_force(spark, spread, k, monkeypatch):
    monkeypatch.setattr(similarity_cells, "CHUNK", 50)
    monkeypatch.setattr(similarity_cells, "QUERY_BLOCK", 3)
    queries, items = data(spread)
    got = top_similar(
        spark.createDataFrame([(*q, 1) for q in queries], QUERY), spark.createDataFrame([(*i, 1, 2, 3) for i in items], ITEM), k).collect()
    want = brute(queries, items, k)
    assert {(r["query_id"], r["rank"]): r["item_id"] for r in got} == {at: i for at, (i, _) in want.items()}
    assert all(r["score"] == pytest.approx(want[r["query_id"], r["rank"]][1], abs=1e-9) for r in got)


def test_clustered_items_open_few_cells(spark):
    queries, items = data(0.05, 6000)
    index = build_cells(spark.createDataFrame([(*i, 1, 2, 3) for i in items], ITEM))
    _, visits = visited_similar(spark.createDataFrame([(*q, 1) for q in queries[:12]], QUERY), index, 5)
    share = visits.count() / (12 * index.cells.count())
    assert index.cells.count() > 30 and share < 0.35


def test_fewer_items_than_asked_and_none(spark):
    queries = spark.createDataFrame([("a", [1.0, 0.0], 1)], QUERY)
    items = spark.createDataFrame([(1, [1.0, 1.0], 1, 2, 3), (2, [0.0, 1.0], 1, 2, 3)], ITEM)
    assert [(r["item_id"], r["rank"]) for r in top_similar(queries, items, 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert top_similar(queries, items.limit(0), 5).count() == 0
    assert top_similar(queries.limit(0), items, 5).count() == 0
    assert top_similar(queries, items.withColumn("item_vec", F.lit(None).cast("array<double>")), 5).count() == 0
