"""Exact top-k by cosine similarity over cells of directions, pruned with the triangle inequality on the sphere.

Items belong to the nearest of a bounded set of centres. A cell knows the widest angle between its centre and an item; no item of
it can be closer to a query than the angle to the centre less that width. A query first visits the cells with the best
bounds that hold k items, takes the kth score found as its limit, and then visits only the cells whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradrift.functions.pixel import unit
from terradrift.session import save_table

#: Centres are items, as many as the square root of their number, so at most this many vectors reach the driver.
MAX_CENTRES = 2048
CHUNK = 4096
QUERY_BLOCK = 2048
#: Scores are compared at this many decimals, so that equal vectors tie wherever they are multiplied.
DECIMALS = 12
_SLACK = 1e-7


@dataclass(frozen=True)
class CellIndex:
    """Items by cell and chunk, the cells' sizes and widths, and the centres (a matrix of unit vectors)."""

    items: DataFrame
    cells: DataFrame
    centres: np.ndarray


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _directed(rows: DataFrame, ident: str, vec: str, name: str) -> DataFrame:
    """``(name, v)``: unit vectors of rows that have a direction."""
    x = F.col(vec).cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    some = rows.filter(F.col(ident).isNotNull() & F.col(vec).isNotNull()).filter(~odd & F.exists(x, lambda e: e != 0))
    return some.select(F.col(ident).alias(name), unit(x).alias("v"))


def build_cells(items: DataFrame, item_id: str = "item_id", item_vec: str = "item_vec", max_centres: int = MAX_CENTRES) -> CellIndex:
    """Assign every item to the nearest centre. Items without a direction (null, zero or non-finite) are left out.

    Centres are the items with the smallest hashes of their ids: a bounded sample that steers cost only.
    """
    spark = items.sparkSession
    unit_items = save_table(_directed(items, item_id, item_vec, "item"), "unit-items")
    n = unit_items.count()
    wanted = max(1, min(max_centres, int(np.sqrt(n))))
    chosen = unit_items.orderBy(F.xxhash64("item"), "item").limit(wanted).select("v").toPandas()["v"]
    centres = np.array([np.asarray(v) for v in chosen]) if len(chosen) else np.zeros((0, 1))
    shared, dim = spark.sparkContext.broadcast(centres), centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            near = v @ shared.value.T
            cell = near.argmax(axis=1)
            wide = np.arccos(np.clip(near[np.arange(len(v)), cell], -1, 1))
            yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("width", pa.array(wide))

    kind = unit_items.schema["item"].dataType.simpleString()
    placed = save_table(unit_items.mapInArrow(assign, f"item {kind}, v array<double>, cell int, width double"), "cell-items")
    cells = save_table(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("width").alias("width")), "cells")
    sized = placed.join(cells.select("cell", F.ceil(F.col("n") / CHUNK).alias("chunks")), "cell")
    # Within a cell items are dealt to chunks of about 4096 by the hash of their id.
    return CellIndex(sized.withColumn("chunk", F.pmod(F.xxhash64("item"), "chunks").cast("int")).drop("width", "chunks"), cells, centres)


def _visits(asked: DataFrame, index: CellIndex) -> DataFrame:
    """``(q, cell, bound, before)``: every cell's greatest possible score, and the items of cells with better bounds."""
    known = index.cells.toPandas().sort_values("cell")  # one row per centre
    ids, size, width = known["cell"].to_numpy(np.int32), known["n"].to_numpy(np.int64), known["width"].to_numpy()
    shared = asked.sparkSession.sparkContext.broadcast((index.centres[ids], size, width))
    kind, dim = asked.schema["q"].dataType.simpleString(), index.centres.shape[1]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, size, width = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                angle = np.arccos(np.clip(_matrix(part.column("v"), dim) @ centres.T, -1, 1))
                best = np.cos(np.maximum(angle - width - _SLACK, 0.0)) + _SLACK
                order = np.argsort(-best, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                rows = np.repeat(np.arange(part.num_rows), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("q").take(pa.array(rows)), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(best, order, 1).ravel()), pa.array(before.ravel())],
                    ["q", "cell", "bound", "before"])

    return asked.mapInArrow(bound, f"q {kind}, cell int, bound double, before bigint")


def _scored(index: CellIndex, asked: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """``(q, item, score)``: the best k of every visited chunk for every query that visits its cell."""
    cuts = index.cells.select("cell", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CHUNK).cast("int") - 1)).alias("chunk"))
    mine = visits.select("q", "cell").join(cuts, "cell").join(asked, "q")
    needed = mine.select("cell", "chunk", "block").distinct()
    items = index.items.join(needed, ["cell", "chunk"]).select(
        F.col("cell").alias("i_cell"), F.col("chunk").alias("i_chunk"), F.col("block").alias("i_block"), "item", F.col("v").alias("w"))
    q_kind, i_kind = asked.schema["q"].dataType.simpleString(), index.items.schema["item"].dataType.simpleString()

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"q": [], "item": [], "score": []}
        if len(left) and len(right):
            right = right.sort_values("item", kind="stable")
            names, w = right["item"].to_numpy(), np.stack(right["w"].to_numpy())
            for start in range(0, len(left), 256):
                part = left.iloc[start : start + 256]
                score = np.round(np.stack(part["v"].to_numpy()) @ w.T, DECIMALS)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out["q"] += np.repeat(part["q"].to_numpy(), top.shape[1]).tolist()
                out["item"] += names[top].ravel().tolist()
                out["score"] += np.take_along_axis(score, top, 1).ravel().tolist()
        return pd.DataFrame(out)

    met = mine.groupBy("cell", "chunk", "block").cogroup(items.groupBy("i_cell", "i_chunk", "i_block"))
    return met.applyInPandas(multiply, f"q {q_kind}, item {i_kind}, score double")


def top_similar(
    queries: DataFrame, items: DataFrame | CellIndex, k: int, query_id: str = "query_id", item_id: str = "item_id",
    query_vec: str = "query_vec", item_vec: str = "item_vec",
) -> DataFrame:
    """The k most similar items per query: ``(query_id, item_id, score, rank)``, ties by item id; exact.

    ``items`` may be an index made before. Queries and items without a direction have no rows. Groups hold at most about 4096
    items of a cell and 2048 queries, whichever cell or query is popular.
    """
    return visited_similar(queries, items, k, query_id, item_id, query_vec, item_vec)[0]


def visited_similar(
    queries: DataFrame, items: DataFrame | CellIndex, k: int, query_id: str = "query_id", item_id: str = "item_id",
    query_vec: str = "query_vec", item_vec: str = "item_vec",
) -> tuple[DataFrame, DataFrame]:
    """:func:`top_similar` and the visits ``(q, cell)`` behind it, to report the share of cells a search opens."""
    index = items if isinstance(items, CellIndex) else build_cells(items, item_id, item_vec)
    asked = save_table(_directed(queries, query_id, query_vec, "q"), "unit-queries")
    blocks = asked.count() // QUERY_BLOCK + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    listed = save_table(_visits(asked.select("q", "v"), index), "visits")
    order = W.partitionBy("q").orderBy(F.desc("score"), "item")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = listed.filter(F.col("before") < k)
    seeds = save_table(best(_scored(index, asked, first, k)), "seed-scores")
    limit = seeds.groupBy("q").agg(F.min("score").alias("limit"))
    more = listed.filter(F.col("before") >= k).join(limit, "q").filter(F.col("bound") >= F.col("limit"))
    found = best(seeds.drop("rank").unionByName(_scored(index, asked, more, k)))
    result = found.select(F.col("q").alias(query_id), F.col("item").alias(item_id), "score", "rank")
    return result, first.select("q", "cell").unionByName(more.select("q", "cell"))
