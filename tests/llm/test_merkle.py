"""Merkle manifests against a plain tree, and multiproofs against the set of nodes they must fetch."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradrift.llm import queries
from terradrift.llm.merkle import build_manifest, expanded, folded, missing_coordinates, numbered, tree_nodes, widths

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash int, pos string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_steps(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def fold_up(h, steps):
    for a, b in steps:
        h = sha(a + h + b)
    return h


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def restated(rows):
    leaf = lambda i, s, lang, n, t: sha("".join(map(field, (i, s, lang, n, t))))
    groups = defaultdict(list)
    for r in rows:
        i, s, lang, n, t = r[:5]
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        alt = leaf(i, s, lang, n, t and t.replace("\n", "")) if even else None
        groups["" if s is None else "=" + s].append(((i is not None, i or 0), leaf(i, s, lang, n, t), alt or "", i))
    names = sorted(groups, key=lambda x: x.encode())
    trees = {g: plain_tree([x[1] for x in sorted(groups[g])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, h, alt, doc) in enumerate(sorted(groups[g])):
            steps = plain_steps(trees[g], i) + plain_steps(top, at)
            back = fold_up(alt or h, steps)
            out.append((doc, h, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), back, back == top[-1][0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "B", "é", "", "zz"]), rng.choice(["en", None]), rng.choice([None, i]), "one\ntwo " * rng.randrange(4)) for i in range(9_000)]
    rows += [(i, None, "en", 1, None) for i in range(20_000, 20_004)]
    rows += [(30_000, "alone", "de", 5, "x\ny"), (None, "hot", None, None, "no id\n"), (5, "hot", "en", 5, "repeat"), (5, "hot", "en", 5, "repeat"),
             (30_001, "1:a", "b", 1, "c" * 200_000 + "\n"), (30_002, "-", "-", 1, "-")]
    rows = [(*r, "t", 1, "p") for r in rows]
    folder = str(tmp_path_factory.mktemp("merkle"))
    spark.createDataFrame(rows, DOCS).repartition(6).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_query_equals_its_rules(spark, documents):
    folder, rows = documents
    got = queries.op13_merkle_manifest(spark, folder)
    assert sorted((tuple(r) for r in got.collect()), key=str) == restated(rows)


def test_proofs_of_some_leaves_fold_to_the_root(spark, documents):
    folder, _ = documents
    manifest = build_manifest(spark.read.parquet(f"{folder}/documents.parquet"))
    every = manifest.proofs().select("tree", "pos", "proof_sha256", "root")
    some = manifest.proofs(F.col("pos") % 97 == 3, steps=True)
    rows = some.collect()
    assert rows and all(folded(r["hash"], [tuple(s) for s in r["steps"]]) == r["root"] == r["folded_root"] for r in rows)
    assert some.join(every, ["tree", "pos", "proof_sha256", "root"]).count() == len(rows)


def test_missing_coordinates_are_minimal_and_enough():
    rng = random.Random(1)
    for n in [1, 2, 3, 4, 9, 10, 28, 100, 243, 244]:
        leaves = [sha(str(i)) for i in range(n)]
        levels = plain_tree(leaves)
        assert list(map(len, levels)) == widths(n)
        for _ in range(6):
            mine = sorted(rng.sample(range(n), rng.randrange(1, min(n, 12) + 1)))
            asked = missing_coordinates(np.array(mine), n)
            below = {(0, i) for i in mine} | {(k, i // 3**k) for i in mine for k in range(len(levels))}
            need = {(k, j) for k, level in enumerate(levels[:-1]) for i in mine for j in range(i // 3**k // 3 * 3, min(i // 3**k // 3 * 3 + 3, len(level)))}
            assert set(asked) == need - below and len(asked) == len(set(asked))
            root, steps = expanded({i: leaves[i] for i in mine}, {(k, i): levels[k][i] for k, i in asked}, n)
            assert root == levels[-1][0] and all(steps[i] == plain_steps(levels, i) for i in mine)


def test_trees_of_several_blocks(spark, frame):
    sizes = {"a": 2187, "b": 2188, "c": 1, "d": 3, "e": 9000}
    rows = [(t, i, sha(f"{t}{i}")) for t, n in sizes.items() for i in range(n)]
    leaves = frame(rows, "tree string, pos long, hash string").repartition(5)
    got = defaultdict(dict)
    for r in tree_nodes(leaves, frame(list(sizes.items()), "tree string, n long")).collect():
        assert (r["level"], r["idx"]) not in got[r["tree"]]
        got[r["tree"]][r["level"], r["idx"]] = r["hash"]
    for t, n in sizes.items():
        levels = plain_tree([sha(f"{t}{i}") for i in range(n)])
        assert got[t] == {(k, i): h for k, level in enumerate(levels) for i, h in enumerate(level)}


def test_numbers_follow_the_order(frame):
    rng = random.Random(3)
    rows = [(rng.choice("xxxxyz"), rng.choice([None, rng.randrange(300)])) for _ in range(5_000)]
    placed, sizes = numbered(frame(rows, "tree string, k long").repartition(9), "tree", ["k"])
    got = defaultdict(dict)
    for r in placed.collect():
        got[r["tree"]][r["pos"]] = r["k"]
    for t, by in got.items():
        want = sorted((k for x, k in rows if x == t), key=lambda k: (k is not None, k or 0))
        assert [by[i] for i in range(len(by))] == want
    assert dict(map(tuple, sizes.collect())) == {t: len(by) for t, by in got.items()}


def test_empty_table(frame):
    assert build_manifest(frame([], DOCS)).proofs().count() == 0
