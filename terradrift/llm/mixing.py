"""Mixing sources to target weights by hierarchical budgets.

A token budget runs down a tree (for example domain, language, source). At each node the children share by weight; a
child cannot take more than its subtree holds over all epochs, and what it cannot take goes to its siblings first. Only
when a whole family is exhausted does the rest go to the siblings of its parent, because a parent never gets more than
its subtree holds. A leaf repeats its documents in whole epochs and fills the rest with the prefix of a seeded
permutation of the next epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradrift.llm.common import small_side, text_or_empty
from terradrift.session import save_table

_BUCKET_DIGITS = 4  # hexadecimal digits of the order key that name a bucket: at most 65,536 per leaf


def words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def _paths(levels: list[str]) -> list[Column]:
    """Text names of a row's nodes from the root's children down to its leaf; null is a value of its own."""
    parts = [F.when(F.col(f"`{c}`").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(f"`{c}`").cast("string"))) for c in levels]
    return [F.concat_ws("\x1f", *parts[: i + 1]) for i in range(len(parts))]


def node_path(*values: str | None) -> str:
    """Name of a tree node as used in a weight table."""
    return "\x1f".join("null" if v is None else f"={v}" for v in values)


def share_out(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``(path, budget)`` of all nodes from ``nodes (path, parent, capacity, weight)`` and ``parents (path, budget)``.

    Water filling per family in one sorted pass: in order of capacity per weight a child is full while its fair part of
    what is left reaches its capacity; the others divide the rest by weight, rounded down. Weight 0 gets nothing.
    A family's rows are tree nodes, never documents.
    """
    rows = nodes.join(parents.select(F.col("path").alias("parent"), F.col("budget").alias("total")), "parent")
    open_ = rows.filter("weight > 0")
    family = Window.partitionBy("parent").orderBy(F.col("capacity") / F.col("weight"), "path")
    before = family.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy("parent")
    open_ = open_.withColumns({
        "left_tokens": F.col("total") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    open_ = open_.withColumn("full", F.col("left_tokens") * F.col("weight") >= F.col("capacity") * F.col("left_weight"))
    # Nearly equal quotients may be sorted either way; a child counts as full only if all before it are.
    open_ = open_.withColumn("full", F.min("full").over(family.rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(everyone), F.lit(0))
    weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    open_ = open_.withColumns({"rest": F.col("total") - taken, "rest_weight": weight})
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(rest * weight) div rest_weight"))
    return open_.select("path", budget.cast("bigint").alias("budget")).unionByName(
        rows.filter("weight <= 0").select("path", F.lit(0).cast("bigint").alias("budget")))


def leaf_budgets(leaves: DataFrame, depth: int, weights: DataFrame, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``(path, tokens, budget)`` per leaf from ``leaves (p1..pn, tokens)``."""
    top = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * share[0]).alias("want"), (F.coalesce(F.sum("tokens"), F.lit(0)) * max_epochs).alias("most"))
    budgets = top.select(F.lit("").alias("path"), F.least(F.expr(f"want div {int(share[1])}"), "most").cast("bigint").alias("budget"))
    for d in range(1, depth + 1):
        parent = F.lit("") if d == 1 else F.col(f"p{d - 1}")
        nodes = leaves.groupBy(F.col(f"p{d}").alias("path"), parent.alias("parent")).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        weighted = nodes.join(weights.select("path", "weight"), "path", "left").fillna({"weight": 1})
        budgets = save_table(share_out(weighted, budgets), "mix-budgets")
    return leaves.select(F.col(f"p{depth}").alias("path"), "tokens").join(budgets, "path")


def mix(docs: DataFrame, levels: list[str], weights: DataFrame, share: tuple[int, int] = (1, 1), max_epochs: int = 2, seed: int = 17,
        key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """Selected rows of ``docs`` with a last column ``epochs``, how often each is used.

    ``levels`` name the tree's columns from the top, ``weights (path, weight)`` holds integer weights by
    :func:`node_path`, 1 where a node is missing. The budget is ``share`` (numerator, denominator) of all tokens, at most
    ``max_epochs`` times the corpus. In epoch e a leaf's order is the MD5 of ``seed:e:key``; a row is in the prefix
    if the rows before it stay under the budget, so the last one may run over it by less than its own length.
    Rows that share a key come together. Null level values form nodes of their own, a null key sorts as empty text,
    texts without words add no tokens and are taken with their neighbours; a leaf without any tokens is left out.
    An existing column ``epochs`` is replaced.
    """
    depth, names = len(levels), [c for c in docs.columns if c != "epochs"]
    tokens = words() if tokens is None else tokens
    key_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    paths = _paths(levels)
    rows = save_table(docs.select(*[p.alias(f"p{i + 1}") for i, p in enumerate(paths)], key_text.alias("key_text"), tokens.alias("tokens")), "mix-rows")
    leaves = save_table(rows.groupBy(*[f"p{i + 1}" for i in range(depth)]).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    plan = leaf_budgets(leaves, depth, weights, share, max_epochs).filter("tokens > 0").select(
        F.col("path").alias("leaf"), F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("part"))
    plan = save_table(plan, "mix-plan")

    def order(key_column: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), key_column))

    # Prefix of the permutation: bucket sums find the one bucket per leaf where it ends, only that one is sorted.
    dealt = rows.select(F.col(f"p{depth}").alias("leaf"), "key_text", "tokens").join(small_side(plan.filter("part > 0")), "leaf")
    dealt = dealt.select("leaf", "part", "tokens", order(F.col("key_text")).alias("at")).withColumn("bucket", F.left("at", F.lit(_BUCKET_DIGITS)))
    sums = dealt.groupBy("leaf", "bucket", "part").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("bucket"))
    ends = sums.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("tokens"))
    ends = save_table(ends.filter("begin < part AND end >= part").select("leaf", "bucket", "begin"), "mix-ends")
    last = dealt.join(small_side(ends), ["leaf", "bucket"]).groupBy("leaf", "part", "begin", "at").agg(F.sum("tokens").alias("tokens"))
    start = F.col("begin") + F.coalesce(
        F.sum("tokens").over(Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = last.withColumn("start", start).filter("start < part").groupBy("leaf").agg(F.max("at").alias("cut"))
    chosen = save_table(plan.join(cuts, "leaf", "left").filter("whole > 0 OR cut IS NOT NULL"), "mix-chosen")

    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), paths[-1].alias("leaf"), key_text.alias("key_text"))
    picked = inner.join(small_side(chosen), "leaf").select(
        "row", (F.col("whole") + F.when(order(F.col("key_text")) <= F.col("cut"), 1).otherwise(0)).cast("int").alias("epochs"))
    return picked.filter("epochs > 0").select("row.*", "epochs")
