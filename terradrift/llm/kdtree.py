"""Exact top-k by inner product with one KD-tree per shard.

Vectors are quantised to integers and dealt to shards by a hash of their id. Each shard builds a balanced KD-tree:
median splits on the widest axis of a node's tight bounding box, leaves of ``leaf_rows`` vectors. A query visits the
nodes of a tree best-first, ordered by the largest inner product its box allows, and stops at the first box below the
kth score known so far. That score is propagated: a first round searches one shard per query block, then every strand
of shards starts from the kth score of that round and hands it on from shard to shard.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradrift.session import save_table

#: Doubles hold every integer up to this bound, so their products and sums are exact below it.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
HITS = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, key: str, value: str, scale: int = 1024) -> DataFrame:
    """``(vec_id, dim, v)`` with ``v`` = floor(scale * x) as doubles.

    Left out: null keys, null vectors, empty vectors, vectors holding a null or a non-finite component. An id given
    several times counts once, with its greatest vector in array order.
    """
    x = F.col(value).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = vectors.filter(F.col(key).isNotNull() & F.col(value).isNotNull() & (F.size(value) > 0)).filter(~bad)
    # Beyond 2^52 a double is an integer already, and Spark's floor would stop at the range of a long.
    v = F.transform(x, lambda e: F.when(F.abs(e * scale) >= float(1 << 52), e * scale).otherwise(F.floor(e * scale).cast("double")))
    once = ok.groupBy(F.col(key).cast("bigint").alias("vec_id")).agg(F.max(v).alias("v"))
    return once.select("vec_id", F.size("v").alias("dim"), "v")


def build_tree(ids: np.ndarray, points: np.ndarray, leaf_rows: int) -> dict[str, np.ndarray]:
    """Flat KD-tree: per node its box, smallest id, slice of the reordered points and children (-1 for a leaf)."""
    order = np.argsort(ids, kind="stable")
    lo, hi, least, start, end, child = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        part = order[a:b]
        box_lo, box_hi = points[part].min(0), points[part].max(0)
        me = len(lo)
        for column, x in ((lo, box_lo), (hi, box_hi), (least, ids[part].min()), (start, a), (end, b), (child, (-1, -1))):
            column.append(x)
        if b - a > leaf_rows:
            axis = int(np.argmax(box_hi - box_lo))
            order[a:b] = part[np.argsort(points[part, axis], kind="stable")]
            middle = (a + b) // 2
            child[me] = (node(a, middle), node(middle, b))
        return me

    node(0, len(ids))
    return {
        "lo": np.array(lo), "hi": np.array(hi), "least": np.array(least), "start": np.array(start), "end": np.array(end),
        "child": np.array(child), "ids": ids[order], "points": points[order],
    }


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _products(points: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact integer inner products; beyond 2^53 in Python integers, beyond a long held at its ends."""
    if float((np.abs(points) @ np.abs(query)).max(initial=0.0)) < _EXACT:
        return (points @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    return [max(-_LONG - 1, min(_LONG, sum(int(a) * b for a, b in zip(row, whole)))) for row in points]


def best_first(tree: dict[str, np.ndarray], query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int]],
               floor: int) -> int:
    """Update ``best``, a heap of ``(score, -vec_id)`` of at most ``k`` rows; returns the leaves visited.

    ``floor`` is a kth score known from elsewhere: boxes that cannot reach it hold nothing of use.
    """
    bound = np.where(query > 0, tree["hi"], tree["lo"]) @ query
    if float(np.abs(bound).max()) >= _EXACT:
        bound = bound + np.abs(bound) * 1e-9 + 1  # rounding must not hide a box
    bound = np.minimum(bound, float(_LONG))
    heap, visited = [(-bound[0], 0)], 0
    while heap:
        top, at = heapq.heappop(heap)
        if -top < floor:
            break
        if len(best) == k:
            kth, kth_id = best[0][0], -best[0][1]
            if -top < kth:
                break
            if -top == kth and tree["least"][at] > kth_id:
                continue
        left, right = tree["child"][at]
        if left >= 0:
            heapq.heappush(heap, (-bound[left], int(left)))
            heapq.heappush(heap, (-bound[right], int(right)))
            continue
        visited += 1
        a, b = tree["start"][at], tree["end"][at]
        for vec_id, score in zip(tree["ids"][a:b].tolist(), _products(tree["points"][a:b], query)):
            if vec_id == query_id or score < floor:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -vec_id))
            elif (score, -vec_id) > best[0]:
                heapq.heapreplace(best, (score, -vec_id))
    return visited


def _search(blocks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """Per (strand, block): the trees of the strand one after the other, the kth score handed on between them."""

    def strand(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        loaded = [_unpacked(t) for t in left.sort_values("shard")["tree"]]
        for packed in right["packed"] if loaded else ():
            block = _unpacked(packed)
            for query_id, query, floor in zip(block["ids"].tolist(), block["points"], block["floor"].tolist()):
                best: list[tuple[int, int]] = []
                for tree in loaded:
                    best_first(tree, query_id, query, k, best, floor)
                rows += [(query_id, -vec_id, score) for score, vec_id in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["strand", "block"]
    return trees.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(strand, HITS)


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", value: str = "embedding", k: int = 10, scale: int = 1024,
          shard_rows: int = 4096, leaf_rows: int = 64, strand_shards: int = 4, block_queries: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best other vectors, ties to the smaller id.

    ``is_query`` is a boolean column over ``vec_id``. Only vectors of a query's own length are its candidates. A query
    with fewer candidates than ``k`` returns all of them, one without any returns no row; an empty table returns no rows.
    Scores beyond the range of a long stand at its ends, before ties are broken.
    A group holds at most ``strand_shards`` trees and one block of queries, whatever the size of the table.
    """
    points = save_table(quantised(vectors, key, value, scale), "kd-points")
    total = points.count()
    shards = max(1, -(-total // shard_rows))
    strands = max(1, -(-shards // strand_shards))
    n_queries = points.filter(is_query).count()
    n_blocks = max(1, -(-n_queries // block_queries))

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()), leaf_rows)
        return pd.DataFrame({"shard": [int(key[0])], "dim": [int(key[1])], "tree": [_packed(**tree)]})

    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard")
    trees = save_table(
        points.groupBy(shard, "dim").applyInPandas(grow, "shard int, dim int, tree binary"), "kd-trees"
    ).withColumn("strand", F.col("shard") % strands)

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        floor = np.array([-_LONG - 1 if pd.isna(x) else int(x) for x in part["floor"]], dtype=np.int64)
        packed = _packed(ids=part["vec_id"].to_numpy(), points=np.stack(part["v"].to_numpy()), floor=floor)
        return pd.DataFrame({"block": [int(key[0])], "dim": [int(key[1])], "packed": [packed]})

    def blocks_of(queries: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_blocks)).cast("int").alias("block")
        return save_table(queries.groupBy(block, "dim").applyInPandas(gather, "block int, dim int, packed binary"), "kd-blocks")

    def paired(blocks: DataFrame, blocks_at, trees: DataFrame, trees_at) -> tuple[DataFrame, DataFrame]:
        """Trees of one length meet blocks of that length: the length is part of the block's name."""
        name = F.concat_ws(":", "block", "dim")
        return (
            blocks.select(blocks_at.alias("strand"), name.alias("block"), "packed"),
            trees.withColumn("block", trees_at).select("strand", name.alias("block"), "shard", "tree"),
        )

    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    queries = points.filter(is_query)
    # First round: block b searches shard b mod shards for a first kth score.
    first_blocks = blocks_of(queries.withColumn("floor", F.lit(None).cast("string")))
    seed, seed_trees = paired(first_blocks, F.col("block") % shards, trees.withColumn("strand", F.col("shard")), every_block)
    seed_trees = seed_trees.filter(F.col("shard") == F.split_part("block", F.lit(":"), F.lit(1)).cast("int") % shards)
    hits = save_table(_search(seed, seed_trees, k), "kd-seed")
    floors = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
    floors = floors.select(F.col("query_id").alias("vec_id"), F.col("kth").cast("string").alias("floor"))
    # Second round: every block against every strand of shards, starting from that score.
    blocks = blocks_of(queries.join(floors, "vec_id", "left"))
    every_strand = F.explode(F.sequence(F.lit(0), F.lit(strands - 1)))
    left, right = paired(blocks, every_strand, trees, every_block)
    found = _search(left, right, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
