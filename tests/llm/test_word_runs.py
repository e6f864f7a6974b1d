"""Runs against a plain search of every period, and the registered query against a plain re-statement of its rules."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terradrift.llm import queries
from terradrift.llm.word_runs import ColouredPaths, find_runs, repeating_pieces, runs_of_words, suffix_automaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, min_length=6, min_exponent=4):
    """Every stretch of equal words q apart, kept if no smaller period holds for all of it."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j + q - i
                smaller = any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q))
                if length >= max(min_length, min_exponent * q) and not smaller:
                    out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 9), st.integers(0, 50), st.sampled_from([(6, 4), (1, 2), (4, 3), (9, 2), (2, 5)]))
def test_runs_equal_brute_force(words, p, a, bounds):
    a = min(a, len(words))
    words = words[:a] + [words[a + (i - a) % p] if a + (i - a) % p < len(words) else b"z" for i in range(a, len(words))] + words[:a]
    assert runs_of_words(words, *bounds) == brute(words, *bounds)


def test_runs_of_nested_and_touching_repeats():
    inner = [b"x", b"y"] * 4
    words = (inner + [b"z"]) * 5 + [b"q"] * 9 + [b"x"] * 6 + [b"end"]
    found = runs_of_words(words)
    assert found == brute(words)
    assert (45, 9, 1) in found and (54, 6, 1) in found and (0, 45, 9) in found


def test_pieces_hold_all_runs_and_leave_prose_out():
    rng = random.Random(2)
    prose = [str(rng.randrange(10**6)).encode() for _ in range(3_000)]
    assert repeating_pieces(prose, 6, 4) == []
    words = prose[:100] + [b"la"] * 7 + prose[100:200]
    assert repeating_pieces(words, 6, 4) == [(100, 107)]
    assert repeating_pieces([b"la"] * 7, 6, 4) == [(0, 7)] and repeating_pieces([b"la"] * 5, 6, 4) == []


def test_automaton_holds_every_stretch_once():
    rng = random.Random(4)
    for _ in range(50):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        link, length, prefix = suffix_automaton(words)
        distinct = {tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
        assert sum(length[s] - length[link[s]] for s in range(2, len(length))) == len(distinct)
        assert [length[s] for s in prefix] == list(range(1, len(words) + 1))


def test_access_meets_the_last_colours_of_a_path():
    rng = random.Random(6)
    parent = [0, 0] + [rng.randrange(max(1, i - 4), i) for i in range(2, 200)]
    paths, colour = ColouredPaths(parent), {}
    for i in range(600):
        node = rng.randrange(1, 200)
        line = []
        while node:
            line.append(node)
            node = parent[node]
        want = [(x, colour.get(x, -1)) for j, x in enumerate(line) if not j or colour.get(line[j - 1], -1) != colour.get(x, -1)]
        got = paths.access(line[0], i)
        # Unpainted nodes are stretches of their own; painted ones are met once per colour, deepest node first.
        assert [m for m in got if m[1] >= 0] == [m for m in want if m[1] >= 0]
        colour.update(dict.fromkeys(line, i))


def restated(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, prose(rng.randrange(0, 90))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, " \t\n\x0b\x0c\r"), (903, "a b " * 3 + "a b"), (904, "a b " * 3 + "a"), (905, "la " * 6), (906, "la " * 5),
             (907, "x y x y x y x y x y x y"), (None, "la la la la la la la"), (905, "la " * 6), (908, "A a A a A a A a a a a a a a"),
             (909, "tic tac " * 2_000), (910, prose(300) + " again and" * 30 + " " + prose(300))]
    folder = str(tmp_path_factory.mktemp("runs"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "'s' AS start", "2 AS body", "3 AS _w")
    frame.repartition(5).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_query_equals_its_rules(spark, documents):
    folder, rows = documents
    got = sorted((tuple(r) for r in queries.op12_word_runs(spark, folder).collect()), key=str)
    assert got == sorted((restated(*r) for r in rows), key=str)


def test_operator_returns_runs_and_texts(spark, documents):
    folder, rows = documents
    got = {(r["doc_id"], r["n_words"]): r for r in find_runs(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert got[904, 7]["runs"] == [] and got[903, 8]["collapsed"] == "a b" and got[900, 0]["collapsed"] == ""
    assert got[909, 4000]["runs"][0].asDict() == {"start": 0, "length": 4000, "period": 2}


def test_empty_table_and_bounds(frame):
    assert find_runs(frame([], "doc_id string, text string")).count() == 0
    with pytest.raises(ValueError):
        find_runs(frame([], "doc_id string, text string"), min_exponent=1)
