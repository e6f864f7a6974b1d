"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed word shingles in one common order, by hash, the most frequent ones last. Two sets of a Jaccard similarity t share a token in the
first n - ceil(t * n) + 1 of each. Tokens that few documents have in that prefix generate pairs directly. A document
whose prefix holds frequent tokens, so that it would cost many candidates, gets a longer prefix and must match more of
it at once: of all tokens of both sets at most (1 - t) of the union differ, so the shared tokens, in order, are cut into
few runs and one run has ``run`` tokens or more. The runs of the longer prefix replace single tokens there.

Documents with equal sets are one class. A first round links every document to the earliest one of its best bucket;
afterwards only buckets that still join different components are worked on. Candidates pass a bound on the overlap from
small histograms and are verified on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import hash_inverse, hash_mix, hash_powers, in_text_batches, measured, released, small_side, text_or_empty
from terradrift.operators.linking import connected_components
from terradrift.session import save_table

_U = np.uint64
_TOKEN_BITS = 44  # of the 64 bits of a shingle, those that travel in the candidate search; whole hashes are verified
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = hash_inverse(_BASE)
_mixed, _powers = hash_mix, hash_powers
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``words`` words; of the whole sequence when it has fewer."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = np.concatenate([[False], ~_SEPARATOR[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw) - 1))])
        word = _mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))
        k = min(words, len(word))
        # Words are scrambled already, so a weighted sum needs one more scramble only.
        total = word[: len(word) - k + 1] * _U(2 * k + 1)
        for i in range(1, k):
            total = total * _BASE + word[i : len(word) - k + 1 + i]
    return np.unique(_mixed(total))


def least_overlap(a, b, t: tuple[int, int]):
    """Smallest overlap of sets of sizes ``a`` and ``b`` with similarity at least t[0] / t[1]."""
    return -((-t[0] * (a + b)) // (t[0] + t[1]))


def histogram(tokens: np.ndarray) -> bytes:
    """Counts, at most 255, of the tokens over a power of two of buckets, about half as many as tokens."""
    size = 64
    while size * 2 < len(tokens):
        size *= 2
    return np.minimum(np.bincount((tokens & _U(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    """No less than the overlap of the sets behind two histograms; a full bucket counts as unlimited."""
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (a, b))
    x, y = (np.where(v == 255, 1 << 40, v) for v in (x, y))
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, size).sum(0), y.reshape(-1, size).sum(0)).sum())


def prefix_length(n: int, t: tuple[int, int], run: int = 1) -> int:
    """Tokens of a set of ``n`` that hold ``run`` shared tokens in a row with any partner, in the common order.

    The partner has at most n * t1 / t0 tokens; of both together at most d differ, which cut the shared tokens into at most
    d + 1 runs, so (d + 1) * (run - 1) + 1 shared tokens hold a run. Of the own tokens at most n - ceil(t * n) are not shared.
    """
    own = n - -(-t[0] * n // t[1])
    if run == 1:
        return own + 1
    largest = n * t[1] // t[0]
    differ = max((t[1] - t[0]) * (n + largest) // (t[0] + t[1]), own)
    return min(n, own + (differ + 1) * (run - 1) + 1)


@lru_cache(maxsize=1 << 16)
def sure_run(m: int, t: tuple[int, int], run: int) -> int:
    """Longest run, at most ``run``, that every linked pair whose smaller set has ``m`` tokens must share."""
    larger = np.arange(m, m * t[1] // t[0] + 1)
    shared = least_overlap(m, larger, t)
    pieces = m + larger - 2 * shared + 1
    return max(1, min(run, int((-(-shared // pieces)).min())))


@lru_cache(maxsize=1 << 16)
def runs_of(n: int, t: tuple[int, int], run: int) -> tuple[int, ...]:
    """Run lengths a set of ``n`` tokens has to emit: one for each size the smaller set of a pair can have."""
    return tuple(sorted({sure_run(m, t, run) for m in range(-(-t[0] * n // t[1]), n + 1)}))


def overlaps(tokens: np.ndarray, owner: np.ndarray, one: np.ndarray, n: int) -> np.ndarray:
    """Overlap of set ``one`` with each of ``n`` sets whose tokens, sorted, are ``tokens`` with their ``owner``."""
    a, b = np.searchsorted(tokens, one, "left"), np.searchsorted(tokens, one, "right")
    length = b - a
    at = np.repeat(a - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    return np.bincount(owner[at], minlength=n)


def _sorted_postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order]


class Join:
    """The join's parameters and steps over documents ``(doc_id, body)`` with unique meaning per id."""

    def __init__(self, docs: DataFrame, words: int, threshold: tuple[int, int], block: int):
        self.docs, self.words, self.t, self.block = docs, words, threshold, block
        self.common = np.zeros(0, dtype=np.int64)  # tokens that come last in the common order

    def _per_text(self, docs: DataFrame, keep: str, schema: str, make) -> DataFrame:
        """Rows that ``make(values of keep, sets)`` yields as column lists; ``docs`` has ``body`` first."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in released(batches):
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    sets = measured(batch.column(0), lambda text: shingle_set(text, words))
                    yield make(batch, sets)

        return docs.select("body", *keep.split(", ")).mapInArrow(run, schema)

    def profiles(self) -> DataFrame:
        """``(doc_id, n, digest, hist)`` of every document."""

        def make(batch, sets):
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([histogram(s) for s in sets], pa.binary())],
                names=["doc_id", "n", "digest", "hist"])

        return save_table(self._per_text(self.docs, "doc_id", "doc_id bigint, n bigint, digest binary, hist binary", make), "jaccard-profiles")

    def prefixes(self, docs: DataFrame, run: int, bucket: str) -> DataFrame:
        """``(doc_id, token)`` of the prefix: single tokens, or hashes of ``run`` tokens in a row."""
        t, shift, common = self.t, _U(64 - _TOKEN_BITS), self.common

        def ordered(s: np.ndarray) -> np.ndarray:
            if not len(common):
                return s
            token = (s >> shift).astype(np.int64)
            last = common[np.minimum(np.searchsorted(common, token), len(common) - 1)] == token
            return np.concatenate([s[~last], s[last]]) if last.any() else s

        def make(batch, sets):
            tokens, counts = [np.zeros(0, dtype=np.int64)], []
            for s in map(ordered, sets):
                found = 0
                for r in runs_of(len(s), t, run) if len(s) else ():
                    part = s[: prefix_length(len(s), t, r)]
                    with np.errstate(over="ignore"):
                        key = part if run == 1 else np.full(max(len(part) - r + 1, 0), _U(r))
                        for i in range(r if run > 1 else 0):
                            key = _mixed(key + part[i : len(part) - r + 1 + i] * _U(2 * i + 3))
                    tokens.append((key >> shift).astype(np.int64))
                    found += len(key)
                counts.append(found)
            ids = batch.column(1).take(pa.array(np.repeat(np.arange(len(sets)), counts)))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(tokens), pa.int64())], names=["doc_id", bucket])

        return self._per_text(docs, "doc_id", f"doc_id bigint, {bucket} bigint", make)

    def verified(self, pairs: DataFrame, profiles: DataFrame, name: str) -> DataFrame:
        """Links ``(a, b)`` among candidate ``pairs (a, b)``: size and histogram bounds, then the exact overlap."""
        t = self.t
        n, hist = profiles.select("doc_id", "n"), profiles.select("doc_id", "hist")
        sized = pairs.join(n.toDF("a", "an"), "a").join(n.toDF("b", "bn"), "b").filter(
            (F.col("an") * t[1] >= F.col("bn") * t[0]) & (F.col("bn") * t[1] >= F.col("an") * t[0]))
        sized = sized.join(hist.toDF("a", "ah"), "a").join(hist.toDF("b", "bh"), "b")

        def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                ok = [overlap_bound(p, q) >= least_overlap(m, n, t) for p, q, m, n in zip(x["ah"], x["bh"], x["an"], x["bn"])]
                yield x.loc[np.array(ok, dtype=bool), ["a", "b"]]

        close = save_table(sized.mapInPandas(bounded, "a bigint, b bigint").distinct(), f"jaccard-{name}")
        # One group holds a leader b and at most about ``block`` partners; a leader of more is dealt to several.
        salts = close.groupBy("b").agg(F.ceil(F.count("*") / F.lit(self.block)).cast("int").alias("salts"))
        dealt = close.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
        dealt = save_table(dealt.select("a", "b", "salt"), f"jaccard-{name}-dealt")
        partners = dealt.select(F.col("a").alias("doc_id"), F.col("b").alias("leader"), "salt", F.lit(False).alias("leads"))
        leaders = dealt.select(F.col("b").alias("doc_id"), F.col("b").alias("leader"), "salt", F.lit(True).alias("leads")).distinct()
        wanted = partners.unionByName(leaders)
        sets = self._sets(self.docs.join(small_side(wanted), "doc_id"), "doc_id, leader, salt, leads", "doc_id bigint, leader bigint, salt int, leads boolean")

        def judge(group: pd.DataFrame) -> pd.DataFrame:
            links = []
            parts = [np.frombuffer(s, dtype=np.uint64) for s in group["tokens"]]
            tokens, owner = _sorted_postings(parts)
            size = np.array([len(p) for p in parts])
            ids, leads = group["doc_id"].to_numpy(), group["leads"].to_numpy(dtype=bool)
            for i in np.flatnonzero(leads):
                shared = overlaps(tokens, owner, parts[i], len(parts))
                ok = (shared >= least_overlap(size, size[i], t)) & (ids != ids[i])
                links += [(int(a), int(ids[i])) for a in ids[ok]]
            return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

        return save_table(sets.groupBy("leader", "salt").applyInPandas(judge, "a bigint, b bigint"), f"jaccard-{name}-links")

    def _sets(self, docs: DataFrame, keep: str, fields: str) -> DataFrame:
        def make(batch, sets):
            return pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*keep.split(", "), "tokens"])

        return self._per_text(docs, keep, f"{fields}, tokens binary", make)

    def blocks(self, members: DataFrame) -> DataFrame:
        """Links within groups ``members (doc_id, grp, n)``: blocks of about ``block`` sets, every pair of blocks once.

        A pair of blocks returns a spanning forest of its links, never all of them. Blocks hold sets of like size, so that
        pairs of blocks too far apart in size need not meet.
        """
        t = self.t
        # Sizes within one step of the ratio share a size class; a link joins equal or neighbouring classes.
        band = F.floor(F.log("n") / float(np.log(t[1] / t[0]))).cast("int")
        sized = members.withColumn("band", band)
        count = sized.groupBy("grp", "band").agg(F.ceil(F.count("*") / F.lit(self.block)).cast("int").alias("k"))
        count = save_table(count, "jaccard-bands")
        above = count.select("grp", (F.col("band") - 1).alias("band"), F.col("k").alias("k_up"))
        below = count.select("grp", (F.col("band") + 1).alias("band"), F.col("k").alias("k_down"))
        placed = sized.join(count, ["grp", "band"]).join(above, ["grp", "band"], "left").join(below, ["grp", "band"], "left")
        placed = placed.withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))

        def name(band1, i, band2, j):
            return F.concat_ws(":", band1.cast("string"), i.cast("string"), band2.cast("string"), j.cast("string"))

        own = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: name(F.col("band"), F.least("i", j), F.col("band"), F.greatest("i", j)))
        up = F.when(F.col("k_up").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("k_up") - 1), lambda j: name(F.col("band"), F.col("i"), F.col("band") + 1, j)))
        down = F.when(F.col("k_down").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("k_down") - 1), lambda j: name(F.col("band") - 1, j, F.col("band"), F.col("i"))))
        none = F.array().cast("array<string>")
        meets = F.concat(own, F.coalesce(up, none), F.coalesce(down, none))
        rows = save_table(placed.select("doc_id", "grp", F.explode(meets).alias("meet")), "jaccard-meets")
        sets = self._sets(self.docs.join(small_side(rows), "doc_id"), "doc_id, grp, meet", "doc_id bigint, grp bigint, meet string")

        def forest(group: pd.DataFrame) -> pd.DataFrame:
            parts = [np.frombuffer(s, dtype=np.uint64) for s in group["tokens"]]
            tokens, owner = _sorted_postings(parts)
            size, ids = np.array([len(p) for p in parts]), group["doc_id"].to_numpy()
            root = np.arange(len(parts))
            links = []
            for i in range(len(parts)):
                linked = np.flatnonzero(overlaps(tokens, owner, parts[i], len(parts)) >= least_overlap(size, size[i], t))
                for r in np.unique(root[linked]):
                    if r != root[i]:
                        links.append((int(ids[i]), int(ids[linked[root[linked] == r][0]])))
                        root[root == r] = root[i]
            return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

        return save_table(sets.groupBy("grp", "meet").applyInPandas(forest, "a bigint, b bigint"), "jaccard-block-links")


def _buckets(rows: DataFrame, bucket: str, name: str) -> DataFrame:
    """Rows of buckets that hold different documents, with the bucket's smallest document and row count."""
    stats = rows.groupBy(bucket).agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count("*").alias("df"))
    stats = stats.filter("leader < last").select(bucket, "leader", "df")
    return save_table(rows.join(stats, bucket), name)


def _still_open(members: DataFrame, bucket: str, roots: DataFrame, name: str) -> DataFrame:
    """Members with their component of buckets that join at least two components."""
    rooted = members.join(roots.toDF("doc_id", "root"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id"))
    mixed = rooted.groupBy(bucket).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select(bucket)
    return save_table(rooted.join(mixed, bucket).select(bucket, "doc_id", "comp", "df"), name)


def _run_links(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``(a, b)``: every document ``a`` of a run that still joins different components with the run's smallest document ``b``."""
    stats = rows.join(small_side(components), "doc_id").groupBy("run").agg(
        F.min("doc_id").alias("b"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    return rows.join(stats.filter("c1 < c2").select("run", "b"), "run").select(F.col("doc_id").alias("a"), "b")


@in_text_batches
def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: tuple[int, int] = (4, 5),
                      frequent: int = 64, common: int = 200_000, run: int = 3, block: int = 1024) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least the threshold, a
    fraction. A to Z are lowered, words are what stands between blanks and the characters 9 to 13. A text of fewer words is
    one shingle; null, empty or blank texts have none, link with nothing and are their own component. ``component_id`` is
    the smallest id reachable by links. Rows that share an id are versions of one document and share its component; a
    null id takes no part and has a null component.

    The at most ``common`` most frequent tokens with more than ``frequent`` documents in plain prefixes come last in the common
    order; every task gets their list, which that number bounds. ``frequent`` is also the most documents a
    token may have to generate pairs directly, ``run`` the tokens in a row that count beyond it. All of them steer the cost, none the result.
    """
    every = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("body"))
    join = Join(every, words, threshold, block)
    profiles = join.profiles()
    known = profiles.filter("doc_id IS NOT NULL AND n > 0")
    classes = save_table(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last"), "jaccard-classes")
    copies = known.join(small_side(classes), "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    copies = save_table(copies, "jaccard-copies")
    # An id leaves the search only if every version of it is a copy of another id's: a version of its own may have links of its own.
    copied = copies.select(F.col("a").alias("doc_id")).distinct()
    versions = known.join(small_side(copied), "doc_id", "left_semi").join(small_side(classes.select("digest", "rep")), "digest", "left")
    gone = versions.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("rep") != F.col("doc_id"), F.lit(False))).alias("all")).filter("all")
    gone = save_table(gone.select("doc_id"), "jaccard-gone")
    once = every.filter("doc_id IS NOT NULL").join(small_side(gone), "doc_id", "left_anti")
    join.docs = once
    sizes = known.join(small_side(gone), "doc_id", "left_anti")

    counted = join.prefixes(once, 1, "token").groupBy("token").count()
    often = counted.filter(F.col("count") > frequent).orderBy(F.desc("count"), "token").limit(common).select("token")
    join.common = np.array(sorted(r[0] for r in often.collect()), dtype=np.int64)

    # First round: every document with the earliest one of the bucket leader it shares most tokens with.
    rows = save_table(join.prefixes(once, 1, "token"), "jaccard-prefixes")
    members = _buckets(rows, "token", "jaccard-members")
    votes = members.filter("doc_id <> leader").groupBy("doc_id", "leader").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("leader")).alias("minus"))).alias("best"))
    links = join.verified(best.select(F.col("doc_id").alias("a"), (-F.col("best.minus")).alias("b")), sizes, "first")
    roots = connected_components(links)

    # Buckets that still join different components: pairs where few documents meet, runs where many do.
    open_ = _still_open(members, "token", roots, "jaccard-open")
    few = open_.filter(F.col("df") <= frequent).groupBy("token").agg(F.sort_array(F.collect_set(F.struct("doc_id", "comp"))).alias("m"))
    left = few.select(F.posexplode("m").alias("i", "x"), "m")
    pairs = left.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y")).filter("x.comp <> y.comp")
    pairs = pairs.select(F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b")).distinct()
    links = links.unionByName(join.verified(pairs, sizes, "few"))
    costly = save_table(open_.filter(F.col("df") > frequent).select("doc_id", "comp").distinct(), "jaccard-costly")
    run_rows = save_table(join.prefixes(once.join(small_side(costly), "doc_id", "left_semi"), run, "run"), "jaccard-runs")
    groups = connected_components(_run_links(run_rows, costly))
    grouped = groups.toDF("doc_id", "grp").join(sizes.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    links = links.unionByName(join.blocks(grouped)).unionByName(copies)

    final = connected_components(links).toDF("doc_id", "component_id")
    out = profiles.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
