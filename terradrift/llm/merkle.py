"""Merkle manifest of a dataset: ternary trees per group, a tree over their roots, and proofs by octopus multiproofs.

Leaves are numbered in their group's order, trees grow in blocks of 3^7 leaves, and proofs are made per partition of leaves:
a partition works out the smallest set of node coordinates that its leaves do not yield themselves, fetches those nodes once,
derives the interiors that its proofs share, and expands each leaf's own proof from them. The roots of the groups' trees are
the leaves of the upper tree, whose proofs are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradrift.session import save_table

FAN = 3
#: Levels that one task derives at once: blocks of 3^7 = 2187 nodes.
BLOCK_LEVELS = 7
BLOCK = FAN**BLOCK_LEVELS
PART_ROWS = 4096
NODE = "tree string, level int, idx bigint, hash string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(name: str | Column) -> Column:
    """A field as ``bytes:value``, or ``-`` for null, so that concatenated fields cannot be confused."""
    value = (F.col(name) if isinstance(name, str) else name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*fields: str | Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def widths(n: int) -> list[int]:
    """Number of nodes on each level of a tree of ``n`` leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


# --- numbering and building ---------------------------------------------------------------------


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of a sorted stream as ``(key values, columns)`` per group of equal leading ``keys`` columns."""
    now, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_pylist() for c in batch.columns]
        start, rows = 0, list(zip(*columns[:keys]))
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            part = [c[start:i] for c in columns[keys:]]
            if rows[start] == now:
                for mine, new in zip(held, part):
                    mine += new
            else:
                if held is not None:
                    yield now, held
                now, held = rows[start], part
            start = i
    if held is not None:
        yield now, held


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos``, their place from 0 within ``tree`` by ``order`` (nulls first), and the sizes ``(tree, n)``.

    Rows are range-partitioned, counted per partition and shifted by the counts of the partitions before; a tree that holds
    most rows is spread like any other. Rows that tie are numbered in some order.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    ranged = ranged.select(F.spark_partition_id().alias("_part"), "*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pc.run_end_encode(batch.column(at))
            starts = np.concatenate([[0], names.run_ends.to_numpy()])
            local = np.arange(batch.num_rows)
            for name, a, b in zip(names.values.to_pylist(), starts[:-1], starts[1:]):
                n = n if name == last else 0
                local[a:b] += n - a
                last, n = name, n + int(b - a)
            yield batch.append_column("_local", pa.array(local))

    at = ranged.columns.index(tree)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    placed = save_table(ranged.mapInArrow(count, f"{schema}, _local bigint"), "merkle-placed")
    parts = placed.groupBy(tree, "_part").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(tree).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = save_table(parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "merkle-offsets")
    pos = (F.col("_before") + F.col("_local")).alias("pos")
    out = placed.join(offsets.select(tree, "_part", "_before"), [tree, "_part"]).select(*rows.columns, pos)
    return out, offsets.groupBy(tree).agg(F.sum("_n").alias("n"))


def _climb(hashes: list[str], first: int, levels: int) -> Iterator[tuple[int, int, str]]:
    """``(levels up, index, hash)`` above consecutive nodes that start at a multiple of the block."""
    for up in range(1, levels + 1):
        hashes = [_sha("".join(hashes[i : i + FAN])) for i in range(0, len(hashes), FAN)]
        first //= FAN
        for i, h in enumerate(hashes):
            yield up, first + i, h


def tree_nodes(leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """All nodes ``(tree, level, idx, hash)`` of the trees with leaves ``(tree, pos, hash)``; level 0 holds the leaves.

    While several nodes remain, every three consecutive ones become one (the last run may have fewer). A round shuffles the
    nodes of one level by blocks of 2187 and derives seven levels, so the rows of rounds shrink by that factor.
    """
    leaf_nodes = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "hash")
    deepest = sizes.agg(F.max("n")).first()[0] or 0
    made, now, base = [leaf_nodes], leaf_nodes, 0
    wide = sizes.select("tree", F.col("n").alias("_w"))
    while deepest > 1:

        def derive(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for (tree, block), (idx, hashes, width) in _grouped(batches, 2):
                out += [(tree, base + up, i, h) for up, i, h in _climb(hashes, idx[0], min(BLOCK_LEVELS, len(widths(width[0])) - 1))]
                if len(out) >= 16_384:
                    yield _node_batch(out)
                    out = []
            if out:
                yield _node_batch(out)

        block = F.expr(f"idx DIV {BLOCK}").alias("block")
        dealt = now.join(wide.filter("_w > 1"), "tree").select("tree", block, "idx", "hash", "_w")
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        above = save_table(dealt.mapInArrow(derive, NODE), "merkle-nodes")
        made.append(above)
        base += BLOCK_LEVELS
        now = above.filter(F.col("level") == base)
        wide = wide.select("tree", F.expr(f"CAST((_w + {BLOCK - 1}) DIV {BLOCK} AS BIGINT)").alias("_w"))
        deepest = -(-deepest // BLOCK)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    tree, level, idx, hashes = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(hashes, pa.string())],
                                      ["tree", "level", "idx", "hash"])


# --- proofs -----------------------------------------------------------------------------------------


def missing_coordinates(leaves: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Smallest set of ``(level, index)`` that the proofs of ``leaves`` (any positions) need beyond what they yield themselves."""
    known, out = np.unique(leaves), []
    for level, width in enumerate(widths(n)[:-1]):
        parents = np.unique(known // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        asked = np.setdiff1d(children[children < width], known, assume_unique=True)
        out += [(level, int(i)) for i in asked]
        known = parents
    return out


def expanded(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> tuple[str, dict[int, list[tuple[str, str]]]]:
    """Root, and per leaf the siblings before and after it on every level, from the leaves of a partition and the nodes it fetched."""
    levels = [dict(leaves)]
    size = widths(n)
    for (level, i), h in fetched.items():
        while len(levels) <= level:
            levels.append({})
        levels[level][i] = h
    steps: list[dict[int, tuple[str, str]]] = []
    own = sorted(leaves)
    for level, width in enumerate(size[:-1]):
        here, beside, parents = levels[level], {}, {}
        for i in own:
            a, b = i - i % FAN, min(i - i % FAN + FAN, width)
            run = [here[j] for j in range(a, b)]
            beside[i] = ("".join(run[: i - a]), "".join(run[i - a + 1 :]))
            if i // FAN not in parents:
                parents[i // FAN] = _sha("".join(run))
        steps.append(beside)
        if len(levels) <= level + 1:
            levels.append({})
        levels[level + 1].update(parents)
        own = list(parents)
    root = levels[len(size) - 1][0]
    tails: dict[int, list[tuple[str, str]]] = {0: []}
    for beside in reversed(steps):
        tails = {i: [s, *tails[i // FAN]] for i, s in beside.items()}
    return root, {i: tails[i] for i in leaves}


def folded(leaf: str, steps: list[tuple[str, str]]) -> str:
    """Root that a leaf and its proof give."""
    for before, after in steps:
        leaf = _sha(before + leaf + after)
    return leaf


def prove(wanted: DataFrame, nodes: DataFrame, sizes: DataFrame, part_rows: int = PART_ROWS, above: DataFrame | None = None,
          steps: bool = False) -> DataFrame:
    """Proofs of the leaves ``wanted``: ``(tree, pos, hash, alt, carried)``, any part of the leaves of ``nodes``.

    Returns ``carried``, ``pos``, ``hash``, the tree's root ``subroot``, the upper ``root``, ``proof_sha256`` (of all siblings
    in order), ``folded_root`` (from ``alt`` where it is not null, else from the leaf) and, on request, ``steps``: per level
    the siblings ``before`` and ``after``. ``above`` holds ``(tree, root, steps)`` of an upper tree whose leaves are the roots.
    """
    part = F.expr(f"pos DIV {part_rows}").alias("part")
    asked = wanted.join(sizes, "tree").groupBy("tree", part, "n").agg(F.collect_set("pos").alias("pos"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(tree, p, level, i) for tree, p, n, at in zip(*[c.to_pylist() for c in batch.columns]) for level, i in missing_coordinates(np.array(at), n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64()))],
                                                 ["tree", "part", "level", "idx"])

    requests = save_table(asked.mapInArrow(ask, "tree string, part bigint, level int, idx bigint"), "merkle-requests")
    # One stream per partition of leaves: first the proof of its root and the tree's size, then the nodes it asked for, then its leaves.
    no_text, no_steps = F.lit(None).cast("string"), F.lit(None).cast("array<struct<before: string, after: string>>")
    heads = asked.select("tree", "part", "n")
    if above is not None:
        heads = heads.join(above.select("tree", F.col("root").alias("_root"), F.col("steps").alias("_steps")), "tree")
    carried = wanted.schema["carried"].dataType
    head = heads.select("tree", "part", F.lit(0).alias("kind"), F.lit(0).alias("level"), F.col("n").alias("idx"),
                        (F.col("_root") if above is not None else no_text).alias("hash"), no_text.alias("alt"),
                        F.lit(None).cast(carried).alias("carried"), (F.col("_steps") if above is not None else no_steps).alias("steps"))
    found = requests.join(nodes, ["tree", "level", "idx"]).select(
        "tree", "part", F.lit(1).alias("kind"), "level", "idx", "hash", no_text.alias("alt"), F.lit(None).cast(carried).alias("carried"), no_steps.alias("steps"))
    own = wanted.select("tree", part, F.lit(2).alias("kind"), F.lit(0).alias("level"), F.col("pos").alias("idx"), "hash", "alt", "carried", no_steps.alias("steps"))
    stream = head.unionByName(found).unionByName(own).repartition("tree", "part").sortWithinPartitions("tree", "part", "kind")
    kind = wanted.schema["carried"].dataType.simpleString()
    step_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), (kinds, level, idx, hashes, alt, extra, upper) in _grouped(batches, 2):
            n, root = idx[0], hashes[0]
            beyond = [(s["before"], s["after"]) for s in upper[0] or []]
            split = kinds.index(2)
            fetched = {(level[i], idx[i]): hashes[i] for i in range(1, split)}
            subroot, proofs = expanded(dict(zip(idx[split:], hashes[split:])), fetched, n)
            out: list[list] = [[] for _ in range(5)]
            for i in range(split, len(kinds)):
                path = proofs[idx[i]] + beyond
                row = (extra[i], _sha("".join(x for s in path for x in s)), folded(hashes[i] if alt[i] is None else alt[i], path), idx[i], hashes[i])
                for column, x in zip(out, row):
                    column.append(x)
            size = len(out[0])
            listed = [[{"before": a, "after": b} for a, b in proofs[p] + beyond] for p in out[3]] if steps else [None] * size
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * size, pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string()), pa.array(out[0]).cast(carried_type),
                 pa.array([subroot] * size, pa.string()), pa.array([subroot if root is None else root] * size, pa.string()),
                 pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(listed, step_type)],
                ["tree", "pos", "hash", "carried", "subroot", "root", "proof_sha256", "folded_root", "steps"])

    from pyspark.sql.pandas.types import to_arrow_type

    carried_type = to_arrow_type(carried)
    return stream.mapInArrow(expand, f"tree string, pos bigint, hash string, carried {kind}, subroot string, root string, proof_sha256 string, "
                                     "folded_root string, steps array<struct<before: string, after: string>>")


# --- the manifest -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Trees of a dataset. ``leaves``: ``(tree, pos, hash, alt, carried)``; ``groups``: subroot, size and upper proof per group."""

    leaves: DataFrame
    nodes: DataFrame
    sizes: DataFrame
    groups: DataFrame

    def proofs(self, wanted: Column | None = None, steps: bool = False) -> DataFrame:
        """Proofs of all leaves, or of those that satisfy ``wanted``."""
        leaves = self.leaves if wanted is None else self.leaves.filter(wanted)
        return prove(leaves, self.nodes, self.sizes, above=self.groups, steps=steps)


def build_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id",
                   group: str = "source", tampered: Callable[[], Column] | None = None) -> Manifest:
    """Hash every row of ``docs`` to a leaf and build the tree of each group and the tree over the groups' roots.

    A leaf hashes ``fields`` in order, a null as ``-``. Leaves of a group ascend by ``key``, nulls first; rows that tie
    in it ascend by their hash, so repeated rows are leaves of their own. Groups are ordered bytewise, the null group first
    and apart from the empty name. ``tampered`` gives another leaf hash to test (null: none). Texts are read once; other
    columns are not read. An empty table has no groups and no root.
    """
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    alt = F.lit(None).cast("string") if tampered is None else tampered()
    hashed = save_table(docs.select(name.alias("tree"), leaf_hash(*fields).alias("hash"), alt.alias("alt"), F.col(key).alias("carried")), "merkle-leaves")
    placed, sizes = numbered(hashed, "tree", ["carried", "hash", "alt"])
    leaves, sizes = save_table(placed, "merkle-numbered"), save_table(sizes, "merkle-sizes")
    nodes = tree_nodes(leaves, sizes)

    depth = F.expr("CAST(0 AS INT)")
    for level in range(1, 41):  # 3^40 exceeds a long
        depth = F.when(F.col("n") > FAN ** (level - 1), F.lit(level)).otherwise(depth)
    tops = nodes.join(sizes.select("tree", depth.alias("level")), ["tree", "level"]).filter("idx = 0")
    upper = tops.select(F.lit("").alias("tree"), F.col("hash"), F.lit(None).cast("string").alias("alt"), F.col("tree").alias("carried"))
    ranked, one = numbered(upper, "tree", ["carried"])
    ranked, one = save_table(ranked, "merkle-subroots"), save_table(one, "merkle-sizes")
    proven = prove(ranked, tree_nodes(ranked, one), one, steps=True)
    groups = save_table(proven.select(F.col("carried").alias("tree"), F.col("hash").alias("subroot"), "root", "steps"), "merkle-groups")
    return Manifest(leaves, nodes, sizes, groups)
