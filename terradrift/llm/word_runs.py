"""Periodic runs of words, found by a suffix automaton and link-cut access.

A run is a stretch of words with smallest period q that no neighbouring word extends. The automaton of a piece of text is
built word by word; then its prefixes are replayed. The suffix links of a prefix's state, down to the root, hold all its
suffixes, and access paints that path with the prefix's end. Every stretch of the path that had another colour is a set of
suffixes whose previous occurrence ended there: if the distance d of the two ends is within the longest suffix, they overlap
or touch and form a square of period d, which is then extended to its run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import hash_mix, text_or_empty

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Characters of results that a task holds before it passes them on.
FLUSH_CHARS = 8 << 20


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length by state (the root is state 1), and the state of every prefix."""
    follow: list[dict[int, int]] = [{}, {}]
    link, length, prefix = [0, 0], [-1, 0], []
    last = 1
    for w in words:
        state = len(length)
        length.append(length[last] + 1)
        link.append(1)
        follow.append({})
        p = last
        while p and w not in follow[p]:
            follow[p][w] = state
            p = link[p]
        if p:
            q = follow[p][w]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(follow[q].copy())
                while p and follow[p].get(w) == q:
                    follow[p][w] = twin
                    p = link[p]
                link[q] = link[state] = twin
        prefix.append(state)
        last = state
    return link, length, prefix


class ColouredPaths:
    """A link-cut forest whose preferred paths are the stretches of one colour."""

    def __init__(self, parent: list[int]):
        # A parent that does not name the node as a child is a path's link to the path above it.
        self.up, self.shallow, self.deep = list(parent), [0] * len(parent), [0] * len(parent)
        self.colour = [-1] * len(parent)  # of a path, kept at the root of its splay tree

    def _rotate(self, x: int, y: int) -> None:
        up, near, far = self.up, self.shallow, self.deep
        if near[y] != x:
            near, far = far, near
        z = up[y]
        moved = near[y] = far[x]
        if moved:
            up[moved] = y
        far[x] = y
        up[y], up[x] = x, z
        if z:
            if self.shallow[z] == y:
                self.shallow[z] = x
            elif self.deep[z] == y:
                self.deep[z] = x

    def _splay(self, x: int) -> None:
        up, shallow, deep, colour = self.up, self.shallow, self.deep, self.colour
        while True:
            y = up[x]
            if not y or (shallow[y] != x and deep[y] != x):
                return
            z = up[y]
            if not z or (shallow[z] != y and deep[z] != y):
                colour[x] = colour[y]
                self._rotate(x, y)
                return
            top = up[z]
            if not top or (shallow[top] != z and deep[top] != z):
                colour[x] = colour[z]
            self._rotate(*((y, z) if (shallow[y] == x) == (shallow[z] == y) else (x, y)))
            self._rotate(x, up[x])

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Paint the path from the root to ``node``; ``(deepest node, old colour)`` of every stretch it consisted of."""
        met, below, at = [], 0, node
        while at:
            self._splay(at)
            met.append((at, self.colour[at]))
            cut = self.deep[at]
            if cut:
                self.colour[cut] = self.colour[at]
            self.deep[at] = below
            below, at = at, self.up[at]
        self._splay(node)
        self.colour[node] = colour
        return met


def runs_of_piece(words: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a word sequence with at least ``min_exponent`` (2 or more) periods.

    Within such a run, after its first ``min_exponent`` periods, the suffix of one period less has its latest previous end
    exactly one smallest period back, so a stretch with distance d counts if its longest suffix has ``min_exponent - 1`` times d.
    """
    link, length, prefix = suffix_automaton(words)
    paths, n = ColouredPaths(link), len(words)
    reach: dict[int, int] = {}  # last word of the latest run by period
    found = []
    for i, state in enumerate(prefix):
        for node, before in paths.access(state, i):
            d = i - before
            if before < 0 or length[node] < (min_exponent - 1) * d or reach.get(d, -1) >= i:
                continue
            a, b = i - d - length[node] + 1, i + 1
            while a and words[a - 1] == words[a - 1 + d]:
                a -= 1
            while b < n and words[b] == words[b - d]:
                b += 1
            reach[d] = b - 1
            if b - a >= max(min_length, min_exponent * d):
                found.append((a, b - a, d))
    return found


def repeating_pieces(words: list[bytes], min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Half-open stretches of words outside of which there can be no run.

    Every stretch of k words in a run occurs once more in it, one period away, if the run has at least 2q + k - 1 words. So
    words that no repeated stretch of k words covers belong to no run. Equal hashes of different words only add pieces.
    """
    k = max(1, min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 1)))
    n = len(words) - k + 1
    if n < 2:
        return []
    h = hash_mix(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    gram = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.sort(gram)
    again = order[1:][order[1:] == order[:-1]]
    if not again.size:
        return []
    at = np.searchsorted(again, gram)
    at[at == again.size] = 0
    step = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again[at] == gram)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    edge = np.flatnonzero(np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0))
    pieces = zip(edge[::2].tolist(), [*edge[1::2].tolist(), len(words)][: len(edge[::2])])
    return [(a, b) for a, b in pieces if b - a >= min_length]


def runs_of_words(words: list[bytes], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period."""
    found = []
    for a, b in repeating_pieces(words, min_length, min_exponent):
        number: dict[bytes, int] = {}
        piece = [number.setdefault(w, len(number)) for w in words[a:b]]
        found += [(a + s, n, q) for s, n, q in runs_of_piece(piece, min_length, min_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a blank, of every run only its first period."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        step[s + q] += 1
        step[s + n] -= 1
    covered = np.cumsum(step) > 0
    return b" ".join([w for w, out in zip(words, covered.tolist()) if not out])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: one row per row of ``docs``.

    Words are separated by blanks and the control characters 9 to 13 and compared as they are. ``runs`` lists the maximal
    stretches of at least ``min_length`` words and ``min_exponent`` (an integer, 2 or more) smallest periods, by start and
    period; ``collapsed`` joins the words by one blank, of each run only the first period. A null or empty text has no words,
    no runs and an empty ``collapsed``. Repeated rows give repeated rows, a null key is kept, other columns are not read, so
    none can clash. Whole texts are searched: time n log n in the words of pieces that repeat.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("runs have at least two periods and one word")
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("body"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, size = 0, 0
            n_words, runs, kept = [], [], []
            for i in range(len(texts)):
                words = texts[i].as_buffer().to_pybytes().split()
                found = runs_of_words(words, min_length, min_exponent)
                n_words.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(collapsed(words, found))
                size += len(kept[-1]) + 256
                if size >= FLUSH_CHARS or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(start, i + 1 - start), pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.binary()).cast(pa.string())],
                        ["doc_id", "n_words", "runs", "collapsed"])
                    start, size = i + 1, 0
                    n_words, runs, kept = [], [], []

    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(search, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
