"""Text and feature vectors: hash embedding, negative conditioning, similarity ranking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.functions.pixel import dot, norm, unit
from terradrift.functions.text import words
from terradrift.operators.similarity_cells import top_similar  # noqa: F401  (part of this module's interface)

DIM = 512
BETA = 0.65


def _hashed(df: DataFrame, key: str, text: str, dim: int, anchors: Mapping[str, str] | None) -> DataFrame:
    """Summed signs per (key, place). A text without words keeps one row with a NULL place."""
    tokens = df.select(key, F.explode_outer(words(text)).alias("w"))
    if anchors:
        named = F.create_map(*[F.lit(x) for pair in anchors.items() for x in pair])
        tokens = tokens.withColumn("w", F.coalesce(named[F.col("w")], F.col("w")))
    code = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.floor(code / (2 * dim)) % 2 == 0, 1.0).otherwise(-1.0)
    return tokens.groupBy(key, (code % dim).cast("int").alias("idx")).agg(F.sum(sign).alias("value"))


def token_coordinates(df: DataFrame, key: str, text: str, dim: int = DIM, anchors: Mapping[str, str] | None = None) -> DataFrame:
    """Signed feature-hash coordinates of a text: ``(key, idx, value)``, zero sums dropped.

    Each word adds +1 or -1 at one place. ``anchors`` maps words to the text hashed in their
    stead, which makes synonyms share a place. A text's words sit in one partition, so at
    most ``dim`` rows per text are shuffled.
    """
    return _hashed(df, key, text, dim, anchors).filter("idx IS NOT NULL AND value <> 0")


def embed_text(df: DataFrame, key: str, text: str, dim: int = DIM, anchors: Mapping[str, str] | None = None) -> DataFrame:
    """Unit vector ``array<double>`` per text; a text without words gets the first axis."""
    entries = F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "value")))
    sparse = _hashed(df, key, text, dim, anchors).groupBy(key).agg(F.map_from_entries(entries).alias("m"))
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    zeros = F.map_from_arrays(places, F.array_repeat(F.lit(0.0), dim))
    merged = F.map_entries(F.map_zip_with("m", zeros, lambda k, a, b: F.coalesce(a, b)))
    listed = sparse.select(key, F.transform(F.array_sort(merged), lambda e: e["value"]).alias("v"))
    first = F.transform(places, lambda i: (i == 0).cast("double"))
    return listed.select(key, F.when(norm("v") > 0, unit("v")).otherwise(first).alias("vector"))


def condition(positive, negative, beta: float = BETA) -> Column:
    """Move a unit vector away from another: ``(e - beta*n)`` rescaled to length 1.

    Without a negative vector, or when nothing is left, the vector itself is returned.
    """
    pos = F.col(positive) if isinstance(positive, str) else positive
    neg = F.col(negative) if isinstance(negative, str) else negative
    moved = F.zip_with(pos, neg, lambda a, b: a.cast("double") - beta * b.cast("double"))
    plain = F.transform(pos, lambda x: x.cast("double"))
    return F.when(neg.isNull() | (norm(moved) < 1e-6), plain).otherwise(unit(moved))


def cosine(u, v) -> Column:
    return F.try_divide(dot(u, v), norm(u) * norm(v))
