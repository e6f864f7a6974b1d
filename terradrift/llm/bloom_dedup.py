"""Exact dedup in two passes over a Bloom filter of counters: only possibly repeated texts are shuffled.

The first pass counts texts in a filter whose counters stop at two; filters of different tasks add up, so a text is possibly
repeated if all its counters reached two, wherever its copies lie. The second pass tests every row against that filter: a row
that fails is unique and goes straight to the result; the others, repeats and a few false hits, are grouped by their digest.
A filter that is too full costs shuffled rows, never a wrong result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import hash_mix, text_or_empty
from terradrift.session import save_table

#: Counters of one block; all counters of a text lie in one block, and a block's number takes the leading bits of the hash.
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
COUNTERS_PER_ROW = 16
#: Counters of a text: as many as fit the 64 bits of its hash in steps of 16.
PROBES = 4
#: Hashes counted in a task before its part of the filter is passed on.
FLUSH_ROWS = 1 << 20
MARKS = ("keep_id", "group_size", "kept", "text_sha256")


def case_folded(text: str = "text") -> Column:
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    return F.translate(text_or_empty(text), string.ascii_uppercase, string.ascii_lowercase)


def places(hashes: np.ndarray, n_blocks: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and sorted counter numbers (rows by probes) of 64-bit hashes; ``n_blocks`` is a power of two."""
    bits = n_blocks.bit_length() - 1
    block = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    mixed = hash_mix(hashes)
    slots = np.stack([(mixed >> np.uint64(16 * i)) & np.uint64(BLOCK - 1) for i in range(probes)], 1).astype(np.int64)
    slots.sort(axis=1)
    return block, slots


def count_hashes(hashes: np.ndarray, n_blocks: int, probes: int) -> dict[str, list]:
    """One row per touched block: counters met once and counters met at least twice, as 16-bit numbers."""
    block, slots = places(hashes, n_blocks, probes)
    own_repeat = np.zeros(slots.shape, bool)
    own_repeat[:, 1:] = slots[:, 1:] == slots[:, :-1]
    at, n = np.unique(((block[:, None] << BLOCK_BITS) | slots)[~own_repeat], return_counts=True)
    starts = np.flatnonzero(np.diff(at >> BLOCK_BITS, prepend=-1))
    low, twice = (at & (BLOCK - 1)).astype("<u2"), n > 1
    out: dict[str, list] = {"block": [], "once": [], "twice": []}
    for a, b in zip(starts, [*starts[1:], len(at)]):
        out["block"].append(int(at[a] >> BLOCK_BITS))
        out["once"].append(low[a:b][~twice[a:b]].tobytes())
        out["twice"].append(low[a:b][twice[a:b]].tobytes())
    return out


def add_counters(once: list[bytes], twice: list[bytes]) -> bytes:
    """Bitmap of the counters of one block that reach two when the tasks' counts are added."""
    n = np.bincount(np.frombuffer(b"".join(once), "<u2"), minlength=BLOCK)
    n += 2 * np.bincount(np.frombuffer(b"".join(twice), "<u2"), minlength=BLOCK)
    return np.packbits(n >= 2).tobytes()


def repeat_filter(hashes: DataFrame, n_blocks: int, probes: int) -> np.ndarray:
    """Bitmap (blocks by bytes) of counters that reached two over all rows of ``hashes``, a table of one long column.

    Tasks pass on sorted counter numbers, ``2 * probes`` bytes a row; a block's counts are added in one task, which reads at
    most 64 Ki numbers from each part. The driver gets the bitmap only: ``n_blocks * 8`` KiB, whatever the rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = count_hashes(np.concatenate(held), n_blocks, probes)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int64()), pa.array(rows["once"], pa.binary()), pa.array(rows["twice"], pa.binary())],
                                              ["block", "once", "twice"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": part["block"].iloc[:1], "bits": [add_counters(list(part["once"]), list(part["twice"]))]})

    counted = hashes.mapInArrow(count, "block bigint, once binary, twice binary")
    bits = np.zeros((n_blocks, BLOCK // 8), np.uint8)
    for r in counted.groupBy("block").applyInPandas(add, "block bigint, bits binary").toLocalIterator():
        bits[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def filter_size(rows: int, max_filter_bytes: int) -> tuple[int, int]:
    """Blocks (a power of two) and probes for so many rows; the bitmap stays within ``max_filter_bytes``."""
    n_blocks = 1
    while n_blocks * BLOCK < rows * COUNTERS_PER_ROW and 2 * n_blocks * BLOCK // 8 <= max_filter_bytes:
        n_blocks *= 2
    return n_blocks, max(1, min(PROBES, round(n_blocks * BLOCK / max(rows, 1) * np.log(2))))


def mark_repeats(rows: DataFrame, digest: str, key: str, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` with ``keep_id``, ``group_size`` and ``kept``: of rows with equal digests the one with the largest key stays.

    ``digest`` is a binary column without nulls. ``rows`` is read three times: to count, to fill the filter and to test. Rows
    outside the filter are not shuffled. Groups of at least a 100,000th of the suspects (10,000 rows or more) are settled by
    a broadcast of their totals, of which there are at most 100,000; the others meet their totals by a join on the digest.
    A null key stays only if no row of its group has one; of rows that tie in digest and key one stays.
    """
    # Packed, so that no column of the caller can meet one of the operator's own.
    columns = [c for c in rows.columns if c not in MARKS[:3]]
    packed = rows.select(F.struct(*columns).alias("own"), F.col(digest).alias("digest"), F.col(key).alias("key"))
    hashed = F.xxhash64("digest")
    n_blocks, probes = filter_size(rows.count(), max_filter_bytes)
    shared = rows.sparkSession.sparkContext.broadcast(repeat_filter(packed.select(hashed.alias("h")), n_blocks, probes))

    def tested(h: pa.Array) -> pa.Array:
        block, slots = places(h.to_numpy(zero_copy_only=False).view(np.uint64), n_blocks, probes)
        return pa.array(((shared.value[block[:, None], slots >> 3] >> (7 - (slots & 7))) & 1).all(axis=1))

    possibly = F.arrow_udf(tested, "boolean")(hashed)
    unique = packed.filter(~possibly).select("own.*", F.col("key").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))

    # Written once, so that the row numbers that break ties cannot change when a task is repeated.
    suspects = save_table(packed.filter(possibly).withColumn("row", F.monotonically_increasing_id()), "suspects")
    totals = suspects.groupBy("digest").agg(F.max(F.struct("key", "row")).alias("top"), F.count("*").alias("n")).filter("n > 1")
    totals = save_table(totals, "suspect-groups")
    large = max(10_000, suspects.count() // 100_000)
    apart = F.broadcast(totals.filter(F.col("n") >= large))

    def settled(part: DataFrame) -> DataFrame:
        lone = F.col("n").isNull()
        return part.select(
            "own.*", F.when(lone, F.col("key")).otherwise(F.col("top.key")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
            (lone | (F.col("top.row") == F.col("row"))).alias("kept"),
        )

    in_large = suspects.join(apart, "digest")
    rest = suspects.join(apart.select("digest"), "digest", "left_anti").join(totals.filter(F.col("n") < large), "digest", "left")
    return unique.unionByName(settled(in_large)).unionByName(settled(rest))


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (lowercase hex).

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty, and empty texts are one
    group. Of equal texts the row with the largest key stays. Repeated rows are members like any other, one of them stays;
    a null key comes last. Columns of ``docs`` with the names of the results are replaced, all others are kept. Whole texts
    are hashed; an empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in MARKS]
    rows = docs.select(*others, F.unhex(F.sha2(case_folded(text), 256)).alias("_bloom_digest"))
    marked = mark_repeats(rows, "_bloom_digest", key, max_filter_bytes)
    return marked.withColumn("text_sha256", F.lower(F.hex("_bloom_digest"))).drop("_bloom_digest")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    held = docs.select(F.struct(*docs.columns).alias("_bloom_own"), F.col(key).alias("_bloom_key"), F.col(text).alias("_bloom_text"))
    return mark_duplicates(held, "_bloom_key", "_bloom_text", max_filter_bytes).filter("kept").select("_bloom_own.*")
