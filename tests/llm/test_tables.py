"""Top-k search and mixing against plain counterparts."""

import hashlib
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from terradrift.llm.kdtree import top_k
from terradrift.llm.mixing import mix, node_path

VEC = "vec_id long, embedding array<float>"


def brute_top(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(1024 * float(np.float32(x))) for x in v]
            ok[i] = max(ok.get(i, q), q)
    out = {}
    for i, v in ok.items():
        if i % 10 == 0:
            held = {j: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))) for j, w in ok.items() if j != i and len(w) == len(v)}
            out |= {(i, r + 1): (j, s) for r, (j, s) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


def test_top_k_matches_brute_force_with_ties_and_odd_vectors(frame):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(150)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # one vector many times
    rows += [(310, None), (320, []), (330, [None, 1.0]), (340, [float("nan")] * 5), (350, [float("inf")] * 5), (None, [1.0] * 5), (360, [1.0, 2.0]),
             (370, [3.0, 4.0]), (380, [1e30] * 5), (390, [3e6, -2e6, 1.0, 0.5, 7e5]), (10, rows[10][1])]
    df = frame(rows, VEC).selectExpr("*", "1 AS shard", "2 AS v", "3 AS block")
    got = top_k(df, F.col("vec_id") % 10 == 0, k=7, shard_rows=40, leaf_rows=4, strand_shards=2, block_queries=5).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute_top(rows, 7)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_shortage_goes_to_siblings_before_ancestors(frame):
    rows = [(i, "a" if i < 60 else "b", "x" if i < 10 else "y", " ".join(["w"] * 10)) for i in range(120)]
    docs = frame(rows, "doc_id long, d string, l string, text string").withColumn("epochs", F.lit(99))
    weights = frame([(node_path("a"), 1), (node_path("b"), 1), (node_path("a", "x"), 3), (node_path("a", "y"), 1)], "path string, weight long")
    got = mix(docs, ["d", "l"], weights, share=(1, 1), max_epochs=2).collect()
    tokens = defaultdict(int)
    for r in got:
        tokens[r["d"], r["l"]] += 10 * r["epochs"]
    # 1200 tokens, half to each side; x wants 450 of a's 600 but holds 200 in two epochs, so y takes the other 400.
    assert tokens == {("a", "x"): 200, ("a", "y"): 400, ("b", "y"): 600}
    assert {r["epochs"] for r in got if r["l"] == "x"} == {2}


def test_prefix_is_the_seeded_order(frame):
    rows = [(i, "s", " ".join(["w"] * (i % 7))) for i in range(200)]
    docs = frame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"] for r in mix(docs, ["source"], frame([], "path string, weight long"), share=(1, 3), seed=4).collect()}
    total, start, want = sum(i % 7 for i in range(200)), 0, set()
    for i in sorted(range(200), key=lambda i: hashlib.md5(f"4:0:{i}".encode()).hexdigest()):
        if start < total // 3:
            want.add(i)
        start += i % 7
    assert got == want


def test_mixing_nulls_repeats_and_nothing(frame):
    rows = [(None, None, "a b c"), (1, None, None), (1, "", "x y"), (1, "", "x y"), (2, "s", "w " * 50_000)]
    docs = frame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS leaf", "2 AS tokens", "3 AS row")
    got = mix(docs, ["source"], frame([(node_path("s"), 0)], "path string, weight long"), max_epochs=3).collect()
    assert {r["source"] for r in got} == {None, ""} and all(r["epochs"] == 3 for r in got if r["source"] == "")
    assert mix(docs.limit(0), ["source"], frame([], "path string, weight long")).count() == 0
