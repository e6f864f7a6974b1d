"""Quality scores from document statistics.

A Gaussian kernel over standardised statistics is approximated by random Fourier features; ridge regression is fitted
from normal equations that every partition sums for its rows, and isotonic regression over out-of-fold ridge scores
turns them into probabilities. Only statistics of the text enter a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import measured, one_label, released, single_threaded, text_or_empty
from terradrift.session import save_table

STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "letters", "upper", "digits", "space", "newlines", "stops",
    "symbols", "bars", "other_marks", "distinct_words", "top_word", "repeat_next", "symbol_words", "word_entropy",
    "log_lines", "mean_line", "repeat_lines", "short_lines", "ended_lines", "long_words",
)
_CLASS = np.full(128, 7, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 stop, 6 symbol, 7 other, 8 bar
for _chars, _index in (
    ("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\r\v\f", 3), ("\n", 4),
    (".,;:!?'\"()-", 5), ("#$%&*@^~+=<>_\\/`", 6), ("|{}[]", 8),
):
    _CLASS[[ord(c) for c in _chars]] = _index
_SYMBOLS = frozenset("#$%&*@^~+=<>_\\/`|{}[]")


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``; an empty text gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.bincount(_CLASS[codes[codes < 128]], minlength=9)
    n = len(codes)
    share = kinds / n
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    counts = np.fromiter(Counter(words).values(), dtype=np.float64) if words else np.ones(1)
    p = counts / counts.sum()
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    return [
        math.log1p(n), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        float(share[0] + share[1] + (n - kinds.sum()) / n), float(share[1]), float(share[2]), float(share[3]), float(share[4]),
        float(share[5]), float(share[6]), float(share[8]), float(share[7]), len(counts) / m, float(counts.max()) / m,
        sum(map(eq, words, words[1:])) / m, sum(not _SYMBOLS.isdisjoint(w) for w in words) / m,
        float(-(p * np.log(p)).sum()) / math.log1p(m), math.log1p(k), math.log1p(n / k), 1 - len(set(lines)) / k,
        sum(len(x) < 30 for x in lines) / k, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / k, float((lengths > 20).mean()),
    ]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return fourier(z, self.frequencies, self.phases)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        if not len(self.knots):
            return np.full(len(raw), float(self.values[0]) if len(self.values) else 0.5)
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def fourier(z: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    wave = np.cos(z @ frequencies + phases) * math.sqrt(2.0 / len(phases))
    return np.hstack([wave, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators: knots at the mean ``x`` of each block."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b in zip(x[order], y[order]):
        blocks.append([1.0, float(b), float(a)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, sy, sx = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + sy, blocks[-1][2] + sx]
    fit = np.array(blocks).reshape(-1, 3)
    return fit[:, 2] / fit[:, 0], fit[:, 1] / fit[:, 0]


def with_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``stats``, an array per row."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            stats = pa.array(measured(batch.column(0), statistics), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], stats], names=[*keep, "stats"])

    return docs.select(text_or_empty(text).alias("body"), *keep).mapInArrow(measure, f"{fields}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str = "doc_id", text: str = "text",
        max_rows: int = 20_000, n_features: int = 256, ridge: float = 1e-2, folds: int = 5, seed: int = 11) -> Model:
    """Fit on labelled rows for which ``learn`` (over ``doc_id``) holds.

    ``max_rows`` bounds the training sample: the labelled ids with the smallest seeded hash, and of their rows, where ids
    repeat, those with the smallest seeded hash of id and text. Without any labelled row the model scores 0.5 everywhere.
    """
    picked = one_label(labels, label, key).filter(learn)
    picked = save_table(picked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows), "quality-sample")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body_text"))
    # Bounded by max_rows, so it may be sent to every executor.
    rows = rows.join(F.broadcast(picked), "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(folds)).cast("int").alias("fold"), F.col("y").alias("y"), "body_text", F.xxhash64("doc_id", "body_text", F.lit(seed + 2)).alias("at")
    )
    # An id given many times brings all its rows; the bound holds for rows. Only statistics are ordered, not texts.
    sample = with_statistics(rows, "body_text", ["fold", "y", "at"]).orderBy("at").limit(max_rows)
    sample = save_table(sample.repartition(8, "at"), "quality-statistics")
    moments = sample.select("y", F.posexplode("stats")).groupBy("pos").agg(
        F.avg("col").alias("mean"), F.stddev_pop("col").alias("sd")).orderBy("pos").collect()
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    mean = np.array([m["mean"] for m in moments]) if moments else np.zeros(d)
    scale = np.array([m["sd"] if m["sd"] > 1e-9 else 1.0 for m in moments]) if moments else np.ones(d)
    # Kernel width: distances of standardised rows have a mean square of about twice the number of statistics.
    frequencies = rng.normal(0.0, 1.0 / math.sqrt(d), size=(d, n_features))
    phases = rng.uniform(0.0, 2 * math.pi, size=n_features)
    model = Model(mean, scale, frequencies, phases, np.zeros(n_features + 1), np.zeros(0), np.array([0.5]))
    if not moments:
        return model

    def normal_equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single_threaded()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = model.features(np.stack(batch["stats"].to_numpy()))
            target = batch["y"].to_numpy(dtype=float)[:, None]
            for f in np.unique(batch["fold"]):
                rows_of = (batch["fold"] == f).to_numpy()
                part = np.hstack([z[rows_of].T @ z[rows_of], z[rows_of].T @ target[rows_of]])
                sums[int(f)] = sums.get(int(f), 0) + part
        for f, total in sums.items():
            yield pd.DataFrame({"fold": f, "i": np.arange(len(total)), "row": list(total)})

    add = F.aggregate  # rows of the sums are added position by position
    parts = sample.coalesce(8).mapInPandas(normal_equations, "fold int, i int, row array<double>")
    summed = parts.groupBy("fold", "i").agg(F.collect_list("row").alias("rows")).select(
        "fold", "i", add(F.slice("rows", 2, 1 << 20), F.element_at("rows", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("row"))
    by_fold: dict[int, np.ndarray] = {}
    for r in summed.orderBy("fold", "i").collect():
        by_fold.setdefault(r["fold"], []).append(r["row"])
    by_fold = {f: np.array(v) for f, v in by_fold.items()}
    total = sum(by_fold.values())

    def solve(normal: np.ndarray) -> np.ndarray:
        a = normal[:, :-1] + ridge * max(1.0, normal[-1, -2]) / n_features * np.eye(len(normal))
        return np.linalg.solve(a, normal[:, -1])

    weights = solve(total)
    local = sample.select("fold", "y", "stats").toPandas()  # at most the documented sample
    z = model.features(np.stack(local["stats"].to_numpy()))
    outside = np.zeros(len(local))
    for f, part in by_fold.items():
        rows_of = (local["fold"] == f).to_numpy()
        outside[rows_of] = z[rows_of] @ (solve(total - part) if len(by_fold) > 1 else weights)
    knots, values = isotonic(outside, local["y"].to_numpy(dtype=float))
    return model._replace(weights=weights, knots=knots, values=values)


def score_column(model: Model, text: str) -> Column:
    """Score of a text column. Only the texts go to Python and only scores come back; the other columns stay where they are."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        single_threaded()
        for batch in batches:
            yield pa.array(model.score(np.array(measured(batch, statistics)).reshape(-1, len(STATISTICS))), pa.float64())
            pa.default_memory_pool().release_unused()

    return scored(text_or_empty(text))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)``: one row per row of ``docs``, whole texts, no shuffle.

    Null and empty texts have all statistics 0 and get the score of such a text. Null keys and repeated rows are kept;
    other columns are not read.
    """
    scored = docs.select(F.col(key).alias("doc_id"), score_column(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score reaches ``threshold``, with all their columns; nothing is shuffled."""
    return docs.filter(score_column(model, text) >= threshold)
