"""The Jaccard join against all pairs, on every path: plain tokens, common tokens last, runs and blocks."""

import itertools
import random
import re

import numpy as np
import pytest

from terradrift.llm import shingle_join
from terradrift.llm.shingle_join import histogram, overlap_bound, prefix_length, runs_of, shingle_set, similar_documents

SCHEMA = "doc_id long, text string"


def brute(rows, words=5):
    def shingles(text):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    boiler = [word() for _ in range(12)]
    rows = []
    for group in range(6):
        base = [word() for _ in range(rng.choice((6, 30, 120)))]
        for _ in range(rng.choice((1, 4, 40))):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.4:
                copy += boiler
            rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(rng.randrange(1, 60))] + boiler) for _ in range(40)]
    rows += ["", "   \t", "one two", "One  two", "one two three four", rows[0].upper(), rows[0]]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"frequent": 2, "common": 30, "block": 7}, {"frequent": 1, "common": 0, "run": 2, "block": 5}])
def test_matches_all_pairs(frame, options):
    rows = corpus(len(options) + 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(frame(rows, SCHEMA), **options).collect()}
    assert got == brute(rows)


def test_linked_pairs_share_a_key_of_every_kind():
    rng, t = np.random.default_rng(8), (4, 5)
    for _ in range(3000):
        tokens = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        k = rng.integers(1, 60)
        a, b = np.unique(np.append(tokens[:k], tokens[k : k + rng.integers(0, k // 4 + 1)])), np.unique(tokens[: k + rng.integers(0, 2)])
        both = len(np.intersect1d(a, b))
        assert overlap_bound(histogram(a), histogram(b)) >= both
        if 5 * both < 4 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        for run in (1, 2, 3, 4):
            keys = [{(r, *p[i : i + r].tolist()) for r in runs_of(len(s), t, run) for p in [s[: prefix_length(len(s), t, r)]] for i in range(len(p) - r + 1)}
                    for s in (a, b)]
            assert keys[0] & keys[1]


def test_words_and_shingles():
    assert len(shingle_set("", 5)) == len(shingle_set(" \n\t", 5)) == 0
    assert np.array_equal(shingle_set("A b\x0bC", 5), shingle_set("a  b c ", 5))
    assert not np.array_equal(shingle_set("É b c", 5), shingle_set("é b c", 5))
    assert len(shingle_set("a b c d e a b c d e a", 5)) == 5


def test_nulls_repeats_and_clashing_columns(frame):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (1, None), (2, "a b c d e f"), (2, "a b c d e f"), (3, "A B C D E F"), (4, long_text), (5, long_text + " x")]
    df = frame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS token", "3 AS component_id", "'x' AS body")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in similar_documents(df).collect())
    assert got == [(0, 2, None), (1, 0, 1), (2, 2, 2), (2, 2, 2), (3, 2, 2), (4, 29_996, 4), (5, 29_997, 4)]
    assert similar_documents(frame([], SCHEMA)).count() == 0


def test_a_version_beside_a_copy_keeps_its_links(frame):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, x), (2, x), (2, y), (3, y + " more"), (4, x), (5, "something else entirely in this one")]
    got = {(r["doc_id"], r["component_id"]) for r in similar_documents(frame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


def test_runs_meet_in_one_join(frame, monkeypatch):
    rows = frame([(1, 7), (2, 7), (3, 7), (2, 8), (3, 8), (4, 9), (5, 10), (6, 10), (6, 10)], "doc_id long, run long")
    components = frame([(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6)], "doc_id long, comp long")
    assert {(r["a"], r["b"]) for r in shingle_join._run_links(rows, components).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    # The rows of the runs are written once and not again without lone documents, nor without closed runs.
    written, save = [], shingle_join.save_table
    monkeypatch.setattr(shingle_join, "save_table", lambda df, name, *more: written.append(name) or save(df, name, *more))
    similar_documents(frame(corpus(3), SCHEMA), frequent=1, common=0)
    assert [n for n in written if n.startswith("jaccard-run")] == ["jaccard-runs"]
