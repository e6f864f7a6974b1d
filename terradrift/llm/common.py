"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as in the contracts: blank and the control characters 9 to 13.
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(n)


def one_label(labels: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """``(key, y)``: one 0/1 label per key. Repeated keys take the majority, ties the 1; null labels are left out."""
    known = labels.filter(F.col(key).isNotNull() & F.col(name).isNotNull())
    return known.groupBy(F.col(key).alias("doc_id")).agg((F.avg(F.col(name).cast("double")) >= 0.5).cast("int").alias("y"))


def single_threaded() -> None:
    """Keep numpy to one thread inside a task: Spark already runs one task per core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


def small_side(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Broadcast hint for a written table of at most ``max_rows`` narrow rows; a longer one is joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def measured(texts: pa.Array, measure: Callable[[str], object], rows: int = 256) -> list:
    """``measure`` of every text; only ``rows`` texts are Python strings at a time, a null counts as empty."""
    out: list = []
    for at in range(0, len(texts), rows):
        out += [measure(t or "") for t in texts.slice(at, rows).to_pylist()]
    return out


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's way to give back free pages, where it has one (glibc)."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Free memory goes back to the system. A worker outlives its task, and later steps share its executor's memory."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory of one is given back before the next is read."""
    for batch in batches:
        if batch.num_rows:
            yield batch
        del batch
        give_back()


#: Bytes of a batch of texts on its way to Python. An executor holds each several times: written, sent, read.
BATCH_BYTES = 2 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Steps run inside get their texts in batches of about ``BATCH_BYTES``, by bytes and not by rows only; the setting is put back after."""
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_KEY)
        else:
            spark.conf.set(_BATCH_KEY, before)


def in_text_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same operator on documents; the steps it runs itself are run in :func:`text_batches`."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        with text_batches(docs.sparkSession):
            return operator(docs, *args, **options)

    return run


def hash_mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_power_tables: dict[int, np.ndarray] = {}


def hash_powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to ``n`` of an odd base modulo 2^64, from a table that grows as texts do."""
    known = _power_tables.get(int(base))
    if known is None or len(known) <= n:
        size = max(2 * n, 4096) + 1
        with np.errstate(over="ignore"):
            known = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)]))
        _power_tables[int(base)] = known
    return known[: n + 1]


def hash_inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))
