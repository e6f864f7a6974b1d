"""Batches of texts are bounded by bytes while the operators' steps run, and the caller's setting comes back."""

import pyarrow as pa
import pytest

from terradrift.llm import line_dedup, shingle_join
from terradrift.llm.common import BATCH_BYTES, text_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_bytes(docs):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    return [r["bytes"] for r in docs.select("text").mapInArrow(sizes, "bytes long").collect()]


def test_batches_are_cut_by_bytes(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    assert max(batch_bytes(docs)) > 4 * BATCH_BYTES
    with text_batches(spark):
        sizes = batch_bytes(docs)
    assert sum(sizes) >= 30_000_000 and max(sizes) < 1.1 * BATCH_BYTES


@pytest.mark.parametrize("module, operator", [(shingle_join, "similar_documents"), (line_dedup, "dedup_lines")])
def test_steps_run_in_small_batches(spark, frame, monkeypatch, module, operator):
    seen, save = [], module.save_table

    def watched(df, name, *more):
        seen.append(spark.conf.get(KEY))
        return save(df, name, *more)

    monkeypatch.setattr(module, "save_table", watched)
    before = spark.conf.get(KEY, None)
    text = "a line that is long enough to count here, and more"
    out = getattr(module, operator)(frame([(1, text), (2, text), (3, text + " words")], "doc_id long, text string"))
    assert seen and set(seen) == {str(BATCH_BYTES)}
    assert spark.conf.get(KEY, None) == before and out.count() == 3
