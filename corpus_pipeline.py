"""The training corpus, stage by stage: quality, lines, near duplicates, benchmark leaks, mix.

Every stage reads the documents the one before it wrote and returns the columns of ``documents``; the last one adds
``domain`` and ``epochs``. Rows of any kind pass: null columns, empty and very long texts, repeated rows, extra columns.
Clean documents stay: a document goes only if its quality is rejected, nothing of it is left after line dedup, it is a later
member of a near-duplicate group, or it holds a benchmark passage; the mix then takes what its budget asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift.llm.common import fold, small_side, table
from terradrift.session import save_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on two thirds of the labels, does not reject."""
    from terradrift.llm.quality import fit, keep_good

    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred earlier are cut; documents with nothing else go. ``n_chars`` follows the text."""
    from terradrift.llm.line_dedup import dedup_lines

    out = dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    from terradrift.llm.shingle_join import similar_documents

    later = similar_documents(docs).filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_later")).distinct()
    return docs.join(small_side(save_table(later, "pipeline-later")), F.col("doc_id") == F.col("_later"), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item, also with other parameters, is found."""
    from terradrift.llm.templates import without_leaks

    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The registered mix over domain, language and source."""
    from terradrift.llm.queries import mixed

    return mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
]

#: The classifier's scores have no SQL form; the stages after it are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage's rows are written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
