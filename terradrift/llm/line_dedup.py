"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are near when at most one character is inserted, deleted or replaced. Every line emits all its
one-character deletions as hashed keys; equal keys meet in an aggregate that keeps the earliest line per key, so a
key shared by millions of lines costs one row. Before that, the same idea at block size thins the lines out: a line
emits itself without its i-th block, and only lines that share such a key with a different line
go on, for several block counts. An edit lies within one block, so no near pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import hash_inverse, hash_mix, hash_powers, in_text_batches, released, small_side, text_or_empty
from terradrift.session import save_table

_U = np.uint64
_BASE = _U(0xD6E8FEB86659FD93)
_INVERSE = hash_inverse(_BASE)
_mixed, _powers = hash_mix, hash_powers
BLOCKS = (4, 16, 64)


def normalised(line: str) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join(line.lower().split())


class Hashed:
    """Polynomial hashes of all parts of some strings, from one pass over their characters."""

    def __init__(self, strings: list[str]):
        self.n = np.array([len(s) for s in strings], dtype=np.int64)
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        with np.errstate(over="ignore"):
            values = _mixed(codes * _U(2) + _U(1))
            self.sums = np.concatenate([[_U(0)], np.cumsum(values * _powers(_BASE, len(codes))[:-1])])
            self.back = _powers(_INVERSE, len(codes))
            self.forth = _powers(_BASE, int(self.n.max(initial=0)) + 1)

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the characters from ``a`` to ``b``; joined parts hash as :meth:`joined` says."""
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.back[a]

    def joined(self, left: np.ndarray, left_n: np.ndarray, right: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return left + self.forth[left_n] * right


def _key(*parts) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = _U(len(parts))
        for i, p in enumerate(parts):
            total = _mixed(total + np.asarray(p).astype(np.uint64) * _U(2 * i + 3))
    return total.astype(np.int64)


def block_keys(strings: Hashed, blocks: int) -> np.ndarray:
    """Per string the hashes of it without its i-th block, once for its own length and once for a length one less.

    For a base length b the i-th key covers the first c(i) and the last b - c(i+1) characters, c(i) = i * b div blocks.
    Strings of lengths b and b, or b and b + 1, within one edit agree in at least one key of base b.
    """
    columns = []
    for base in (strings.n, np.maximum(strings.n - 1, 0)):
        for i in range(blocks):
            left, right = i * base // blocks, base - (i + 1) * base // blocks
            columns.append(_key(base, np.full(len(base), i), strings.part(strings.start, strings.start + left),
                                strings.part(strings.end - right, strings.end)))
    return np.stack(columns, axis=1)


def deletion_keys(strings: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(string, key, role)`` of all variants: r for a replaced character (position and rest), d for a deletion, s for the string."""
    owner = np.repeat(np.arange(len(strings.n)), strings.n)
    at = np.arange(len(owner))
    place = at - strings.start[owner]
    rest = strings.joined(strings.part(strings.start[owner], at), place, strings.part(at + 1, strings.end[owner]))
    replaced = _key(rest, place + 1, strings.n[owner])
    deleted = _key(rest, np.zeros_like(place), strings.n[owner] - 1)
    own = _key(strings.part(strings.start, strings.end), np.zeros_like(strings.n), strings.n)
    roles = np.repeat(np.array(["r", "d", "s"]), [len(owner), len(owner), len(own)])
    return np.concatenate([owner, owner, np.arange(len(own))]), np.concatenate([replaced, deleted, own]), roles


def _lines(docs: DataFrame, text: str, min_chars: int, with_keys: int = 0) -> DataFrame:
    """One row per line of ``min_chars`` or more: ``(pos, h, h2)`` and either ``keys`` of that many blocks or ``norm``.

    ``pos`` orders lines: null ids last, rows that share an id by their text's hash, then the line number.
    """
    body = text_or_empty(text)
    rows = docs.select(body.alias("body"), F.col("doc_id"), F.xxhash64(body).alias("text_hash"))
    last = "keys array<bigint>" if with_keys else "norm string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                owner, number, strings = [], [], []
                for i, t in enumerate(part.column(0).to_pylist()):
                    for k, line in enumerate(t.split("\n")):
                        if len(line) >= min_chars and len(norm := normalised(line)) >= min_chars:
                            owner.append(i)
                            number.append(k)
                            strings.append(norm)
                hashed = Hashed(strings)
                whole = hashed.part(hashed.start, hashed.end)
                columns = [part.column(1).take(pa.array(owner, pa.int64())), part.column(2).take(pa.array(owner, pa.int64())),
                           pa.array(number, pa.int32()), pa.array(_key(whole, hashed.n)), pa.array(_key(hashed.n, whole, whole >> _U(7)))]
                if with_keys:
                    keys = block_keys(hashed, with_keys)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())))
                else:
                    columns.append(pa.array(strings, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "line_no", "h", "h2", last.split()[0]])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {id_type}, text_hash bigint, line_no int, h bigint, h2 bigint, {last}")
    doc = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_hash").alias("doc")
    return out.select(F.struct(doc, "line_no").alias("pos"), "h", "h2", last.split()[0])


def _keyed(lines: DataFrame, keep: str, blocks: int | None) -> DataFrame:
    """``(keep, key[, role])``: block keys, or all deletion keys, of column ``norm``; ``keep`` is a long."""
    fields = f"{keep} bigint, key bigint" + ("" if blocks else ", role string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashed = Hashed(part.column(1).to_pylist())
                if blocks:
                    keys = block_keys(hashed, blocks)
                    ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], names=[keep, "key"])
                else:
                    owner, keys, roles = deletion_keys(hashed)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(keys), pa.array(roles)], names=[keep, "key", "role"])

    return lines.select(keep, "norm").mapInArrow(run, fields)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """``(doc, dropped)``: per document with repeated lines the array of their numbers, from 0.

    A line is dropped if an equal line, or one within one edit, occurs earlier; lines are compared after
    :func:`normalised` and ordered by document id and line number. Lines under ``min_chars`` normalised characters are
    never dropped. Rows with equal id and text are one document; null ids come last.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body_text"))
    lines = save_table(_lines(docs, "body_text", min_chars, with_keys=BLOCKS[0]), "line-keys")
    # Equal lines: the first position of each, kept only where there are several.
    firsts = lines.groupBy("h", "h2").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    several = save_table(firsts.filter(F.col("first") != F.col("last")).select("h", "h2", "first"), "line-copies")
    equal = lines.select("pos", "h", "h2").join(small_side(several), ["h", "h2"]).filter(F.col("pos") != F.col("first")).select("pos")

    # Lines that agree with a different line outside one block.
    def sharing(pairs: DataFrame) -> DataFrame:
        shared = pairs.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter(F.col("a") != F.col("b"))
        return save_table(pairs.join(shared.select("key"), "key", "left_semi").select("h").distinct(), "line-near")

    near = sharing(lines.select("h", F.explode("keys").alias("key")))
    kept = _lines(docs, "body_text", min_chars).join(small_side(near), "h", "left_semi")
    distinct = save_table(kept.groupBy("h", "h2").agg(F.min("pos").alias("first"), F.first("norm").alias("norm")), "line-distinct")
    for blocks in BLOCKS[1:]:
        near = sharing(save_table(_keyed(distinct, "h", blocks), "line-blocks"))
        distinct = save_table(distinct.join(small_side(near), "h", "left_semi"), "line-distinct")

    # The earliest line per deletion key: replaced characters among lines of a length, deletions against whole lines.
    # Ids given after a global sort rise with the first position, so one number stands for it.
    ranked = save_table(distinct.orderBy("first").withColumn("rank", F.monotonically_increasing_id()), "line-ranked")
    emitted = save_table(_keyed(ranked, "rank", None), "line-deletions")

    def earliest(role: str) -> Column:
        return F.min(F.when(F.col("role") == role, F.col("rank"))).alias(role)

    groups = emitted.groupBy("key").agg(*[earliest(r) for r in "rds"], F.count("*").alias("n")).filter("n > 1")
    other = F.when(F.col("role") == "r", F.col("r")).when(F.col("role") == "d", F.col("s")).otherwise(F.col("d"))
    candidates = emitted.join(groups, "key").select("rank", other.alias("other")).filter("other < rank").distinct()
    leader = ranked.select(F.col("rank").alias("other"), F.col("norm").alias("other_norm"))
    verified = candidates.join(leader, "other").join(ranked.select("rank", "h", "h2", "norm"), "rank").filter(
        F.levenshtein("norm", "other_norm", 1) >= 0).select("h", "h2").distinct()
    verified = save_table(verified, "line-close")
    close = lines.select("pos", "h", "h2").join(small_side(verified), ["h", "h2"], "left_semi").select("pos")
    gone = equal.unionByName(close).distinct()
    return gone.groupBy(F.col("pos.doc").alias("doc")).agg(F.sort_array(F.collect_set("pos.line_no")).alias("dropped"))


@in_text_batches
def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20,
                drop_emptied: bool = False, count_as: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all other columns stay, ``count_as`` names a count of dropped lines.

    Null texts stay null, texts without repeated lines stay as they are. With ``drop_emptied`` a document that lost
    lines and has no other text left is dropped; one that was empty from the start stays.
    """
    dropped = save_table(repeated_lines(docs, key, text, min_chars), "line-dropped").select(
        F.col("doc").alias("_doc"), F.col("dropped").alias("_dropped"))
    doc = F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("text_hash"))
    # A null id must meet its own row: the parts are compared one by one, null-safe.
    joined = docs.withColumn("_own", doc).join(
        small_side(dropped), F.col("_own.text_hash").eqNullSafe(F.col("_doc.text_hash")) & F.col("_own.id").eqNullSafe(F.col("_doc.id")), "left")
    split = F.split(F.col(text), "\n")
    left = F.filter(split, lambda x, i: ~F.array_contains(F.col("_dropped"), i))
    rest = F.when(F.col("_dropped").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    out = joined.withColumn(text, rest)
    if drop_emptied:
        out = out.filter(F.col("_dropped").isNull() | (F.length(F.trim(F.regexp_replace(text, "\\s+", " "))) > 0))
    count = [] if count_as is None else [F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("bigint").alias(count_as)]
    return out.select(*docs.columns, *count)
