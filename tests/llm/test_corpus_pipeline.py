"""Every stage of the pipeline on a small corpus whose outcome is known, with odd rows among it."""

import hashlib
import random

import pytest

import corpus_pipeline
from terradrift.llm.mixing import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, text_hash string"
ITEM = "If Tom buys 12 kg of red apples for 30 dollars and Tom gives away five of them to Ann, how many apples does Tom keep in the end?"


def prose(rng, n):
    out = []
    for i in range(n):
        out.append("".join(rng.choice("aeioutnrslmd") for _ in range(rng.randrange(2, 9))) + ("." if i % 11 == 10 else ""))
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    good = {i: "\n".join(prose(rng, 40) for _ in range(3)) for i in range(0, 60)}
    junk = {i: " ".join(prose(rng, 1) + rng.choice(["###", "$$$", "&&&"]) for _ in range(60)) for i in range(60, 100)}
    texts = good | junk
    texts[100] = texts[5]  # an exact copy: nothing is left after line dedup
    near = texts[7].split(" ")
    near[0], near[60], near[-1] = "changed", "otherwise", "finally"
    texts[101] = " ".join(near)  # a near copy in every line
    texts[102] = prose(rng, 30) + " " + ITEM.replace("Tom", "Eva").replace("12", "9") + " " + prose(rng, 30)
    texts[103] = prose(rng, 50) + "\n" + texts[9].split("\n")[1] + "\n" + prose(rng, 50)  # repeats one line
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", len(t), 1, "x") for i, t in texts.items()]
    rows += [(104, "\n".join(prose(rng, 40) for _ in range(3)), None, None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r for r in rows}


def test_stages_take_what_they_should_and_leave_the_rest(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = set(range(60)) | {103, 104}
    assert clean | {100, 101, 102} <= ids["quality classifier"] and not ids["quality classifier"] & set(range(60, 100))
    assert ids["line dedup"] == ids["quality classifier"] - {100}
    assert ids["n-gram Jaccard join"] == ids["line dedup"] - {101}
    assert ids["benchmark decontamination"] == clean
    text = {r["doc_id"]: r for r in docs.collect()}
    assert text[9]["text"] == rows[9][1] and rows[9][1].split("\n")[1] not in text[103]["text"]
    assert text[103]["n_chars"] == len(text[103]["text"]) and text[104]["text"] == rows[104][1]
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert mix.columns == [*columns, "domain", "epochs"]
    # Prefixes by brute force: within a leaf the taken documents come first in the seeded order of the epoch in part.
    taken = {r["doc_id"]: r["epochs"] for r in mix.collect()}
    leaf = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.collect()}
    for one in set(leaf.values()):
        members = [i for i in leaf if leaf[i] == one]
        whole = min(taken.get(i, 0) for i in members)
        order = sorted(members, key=lambda i: hashlib.md5(f"17:{whole}:{i}".encode()).hexdigest())
        more = [taken.get(i, 0) - whole for i in order]
        assert more == sorted(more, reverse=True) and set(more) <= {0, 1}
    total = docs.select(words().alias("n")).groupBy().sum("n").first()[0]
    assert 0 < mix.select(words().alias("n"), "epochs").selectExpr("sum(n * epochs)").first()[0] < total * 2


def test_odd_and_empty_tables_pass_every_stage(spark, corpus):
    folder, _ = corpus
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, "x"), (1, "", "en", "s", 0, 1, "x"), (2, None, "en", "", None, 2, None)], SCHEMA)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder).persist()
        assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
