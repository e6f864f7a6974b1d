"""Connected components of an edge table, one path for every size.

Alternates the two star steps: every vertex first tells its larger neighbours about the smallest one it knows, then its
smaller neighbours. Both steps are a minimum per vertex and a join; no group is ever collected. The edges shrink to one
star per component, and the loop ends only when a round changes nothing. A round is one job and writes one table: between
its steps repeated edges may stay, as each comes from an edge of its own and the second step's minimum does not see them.
The last table's count bounds a round's rows, so the many small rounds at the end run in few tasks, whatever the number of
shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terradrift.session import save_table

#: Up to so many narrow rows a step's tasks are counted by rows, as the tasks of a small table cost more than their rows.
FEW, PER_TASK = 100_000, 5_000


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, at most ``most`` ids and their smallest, for the map side of a join; few are kept in few tasks and broadcast."""
    return F.broadcast(_few_tasks(rows, most)) if most <= FEW else rows


def _few_tasks(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, in tasks of about ``PER_TASK`` when there are at most ``most`` and that is few; else as they are dealt."""
    return rows.coalesce(1 + most // PER_TASK) if most <= FEW else rows


def _both_ways(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, by: list[str], most: int) -> DataFrame:
    """``(larger neighbour, smallest of the neighbourhood)`` for every vertex; no more rows than edges, repeats among them."""
    ways = _both_ways(edges, by)
    least = ways.groupBy(*by, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    larger = ways.filter(F.col("b") > F.col("a")).join(_dealt(least, 2 * most), [*by, "a"])
    return larger.select(*by, F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, by: list[str], most: int) -> DataFrame:
    """``(smaller neighbour or the vertex itself, smallest)`` among the neighbours not above a vertex."""
    down = edges.select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _dealt(down.groupBy(*by, "a").agg(F.min("b").alias("m")), most)
    moved = down.join(least, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
    return _few_tasks(moved.unionByName(least.select(*by, "a", F.col("m").alias("b"))).filter("a <> b").distinct(), 2 * most)


def _written(edges: DataFrame, by: list[str]) -> tuple[DataFrame, tuple]:
    """The edge table, written, and its count and two order-free digests, taken in the same pass."""
    one, two = F.xxhash64(*by, "a", "b"), F.xxhash64(F.lit(1), *by, "b", "a")
    seen = Observation()
    marks = [F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(two % 1_000_003).alias("s")]
    saved = save_table(edges.observe(seen, *marks), "links")
    return saved, tuple(seen.get[k] for k in ("n", "x", "s"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", by: list[str] | None = None) -> DataFrame:
    """``(by.., id, root)`` of every vertex that has an edge; ``root`` is the smallest id of its component, its own included.

    Ids may be of any ordered type; with ``by`` they are names within those columns. Edges with a null end and loops say
    nothing and are left out; repeated edges and both directions are allowed. Vertices without an edge to another are not listed.
    """
    by = by or []
    pairs = edges.select(*by, F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now, mark = _written(pairs.select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), by)
    while mark[0]:
        before = mark
        now, mark = _written(_small_star(_large_star(now, by, mark[0]), by, mark[0]), by)
        if mark == before:
            break
    # Unchanged by both steps: every edge joins a vertex to its root, and a vertex has one edge.
    return now.select(*by, F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        now.select(*by, F.col("b").alias("id"), F.col("b").alias("root")).distinct())
