"""Exact dedup against a plain grouping, with filters of every fill."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from terradrift.llm import bloom_dedup
from terradrift.llm.bloom_dedup import add_counters, count_hashes, filter_size, mark_duplicates, places, without_duplicates

DOCS = "doc_id long, text string, keep_id int, kept string, _bloom_n int, h int, block string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        rest = list(ids)
        rest.remove(top)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(top, top, len(ids), True, sha)] + [(i, top, len(ids), False, sha) for i in rest]
    return Counter(out)


def corpus():
    rng = random.Random(5)
    texts = ["alpha " * rng.randrange(1, 400) + str(i) for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, rng.choice(texts).upper()) for i in range(200)]
    rows += [(2000 + i, "a hot text") for i in range(700)]  # more than a third of all rows
    rows += [(3000, None), (3001, ""), (3002, " "), (3003, "ÄÖ"), (3004, "äö"), (3005, "x" * 300_000), (3006, "X" * 300_000), (3007, "x" * 300_001)]
    rows += [(None, "no id"), (None, "NO ID"), (None, "alone"), (7, texts[7]), (7, texts[7]), (7, "other text of seven"), (3010, "A hot TEXT")]
    return [(i, t, 1, "k", 2, 3, "b") for i, t in rows]


@pytest.mark.parametrize("filter_bytes", [64 << 20, 1])  # the second is one block, however many rows
def test_groups_equal_brute_force(frame, filter_bytes):
    rows = corpus()
    got = mark_duplicates(frame(rows, DOCS).repartition(7), max_filter_bytes=filter_bytes)
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute(rows)
    assert {"_bloom_n", "h", "block"} <= set(got.columns) and got.count() == len(rows)


def test_full_filter_still_gives_whole_results(frame, monkeypatch):
    monkeypatch.setattr(bloom_dedup, "filter_size", lambda rows, most: (1, 1))
    rows = [(i, f"t{i % 90_000}", 1, "k", 2, 3, "b") for i in range(91_000)]
    got = mark_duplicates(frame(rows, DOCS).select("doc_id", "text"))
    assert got.filter("kept").count() == 90_000 and got.filter("group_size = 2").count() == 2_000


def test_kept_rows_have_their_own_columns(frame):
    got = without_duplicates(frame([(1, "A", 5, "k", 1, 1, "b"), (2, "a", 6, "q", 1, 1, "b"), (3, "c", 7, None, 1, 1, None)], DOCS))
    assert sorted(map(tuple, got.collect())) == [(2, "a", 6, "q", 1, 1, "b"), (3, "c", 7, None, 1, 1, None)]


def test_empty_table(frame):
    assert mark_duplicates(frame([], DOCS)).count() == 0


def test_only_suspects_are_written(spark, frame, tmp_path, monkeypatch):
    sizes = {}
    save = bloom_dedup.save_table

    def counted(df, name, *a):
        out = save(df, name, *a)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(bloom_dedup, "save_table", counted)
    rows = [(i, f"text {i}") for i in range(20_000)] + [(50_000 + i, f"text {i}") for i in range(50)]
    mark_duplicates(frame(rows, "doc_id long, text string")).count()
    assert 100 <= sizes["suspects"] <= 400 and sizes["suspect-groups"] == 50


def test_counters_of_parts_add_up():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5_000).astype(np.uint64)
    copies = hashes[:40]
    parts = [hashes[:2_500], hashes[2_500:], copies[:20], np.repeat(copies[20:], 2)]
    blocks, probes = 4, 4
    held = defaultdict(lambda: ([], []))
    for p in parts:
        rows = count_hashes(p, blocks, probes)
        for b, once, twice in zip(rows["block"], rows["once"], rows["twice"]):
            held[b][0].append(once)
            held[b][1].append(twice)
    bits = np.zeros((blocks, bloom_dedup.BLOCK // 8), np.uint8)
    for b, (once, twice) in held.items():
        bits[b] = np.frombuffer(add_counters(once, twice), np.uint8)
    block, slots = places(hashes, blocks, probes)
    hit = (((bits[block[:, None], slots >> 3] >> (7 - (slots & 7))) & 1) == 1).all(axis=1)
    assert hit[:40].all() and hit[40:].mean() < 0.01


def test_filter_stays_within_its_bound():
    for rows in (0, 1, 10**6, 10**9, 10**12):
        blocks, probes = filter_size(rows, 64 << 20)
        assert blocks * bloom_dedup.BLOCK // 8 <= 64 << 20 and 1 <= probes <= 4 and blocks & (blocks - 1) == 0
    assert filter_size(10**6, 64 << 20) == (256, 4)


def test_group_over_the_broadcast_bound(frame):
    rows = [(i, "Same" if i % 2 else f"text {i}") for i in range(24_000)]
    got = {r["doc_id"]: r for r in mark_duplicates(frame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["keep_id"] == (23_999 if i % 2 else i) and got[i]["group_size"] == (12_000 if i % 2 else 1) for i in range(24_000))
    assert [i for i, r in got.items() if r["kept"] and i % 2] == [23_999]
