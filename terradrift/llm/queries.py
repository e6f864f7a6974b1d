"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift.llm import sql
from terradrift.llm.common import WORD_SEPARATORS, fold, table, text_or_empty


def op1_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.quotes import link_quotes

    return link_quotes(table(spark, sf_dir, "conversations"))


def mixed(docs: DataFrame) -> DataFrame:
    """The registered mix: domain, language and source; the domain comes from the source's last character."""
    from terradrift.llm.mixing import mix, node_path

    weights = docs.sparkSession.createDataFrame([(node_path(*path), w) for path, w in sql.MIX_WEIGHTS], "path string, weight bigint")
    with_domain = docs.withColumn("domain", F.expr(sql.MIX_DOMAIN))
    return mix(with_domain, ["domain", "lang", "source"], weights, sql.MIX_SHARE, sql.MIX_EPOCHS, sql.MIX_SEED)


def op2_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.mixing import words

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", words().alias("tokens"), "epochs")


def op3_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.kdtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_token_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op6_line_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(text_or_empty(), "\n")).cast("bigint").alias("n_lines"))
    return dedup_lines(docs, count_as="n_dropped").select("doc_id", "n_lines", "n_dropped", F.md5(text_or_empty()).alias("text_md5"))


def op7_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives, read them back and report each record's totals from its last chunk."""
    from terradrift.llm.warc import dedup_payloads, read_archives, write_archives

    pages = table(spark, sf_dir, "pages")
    records = dedup_payloads(
        pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.col("html"), "UTF-8").alias("body")), "page_id", "body"
    )
    chunks = read_archives(write_archives(records), with_data=False).filter("is_last")
    own = F.col("record_type") == "response"
    return chunks.select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"),
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("sha1_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type", F.expr("try_cast(refers_to AS bigint)").alias("refers_to"),
    )


def op9_jaccard_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.shingle_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op10_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.templates import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op11_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only id and digest of each document are kept for the passes; texts are read once."""
    from terradrift.llm.bloom_dedup import case_folded, mark_repeats
    from terradrift.session import save_table

    digests = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.sha2(case_folded(), 256)).alias("digest"))
    marked = mark_repeats(save_table(digests, "digests"), "digest", "doc_id")
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """The registered documents: with h = crc32(doc_id), g = h div 10, every tenth text ends in words a, a+1, .. repeated from word a = g mod n."""
    words = F.filter(F.split(text_or_empty(), WORD_SEPARATORS), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("_h DIV 10")
    a = F.expr("CAST(_g % size(_w) AS INT)")
    p = F.expr("CAST(1 + (size(_w) - _a) DIV (3 + _g % 8) AS INT)")
    split = docs.withColumn("_h", h).withColumn("_w", F.when((F.col("_h") % 10 == 0), words)).withColumn("_g", g)
    placed = split.withColumn("_a", F.when(F.size("_w") > 0, a)).withColumn("_p", F.when(F.col("_a").isNotNull(), p))
    tail = F.expr("concat_ws(' ', transform(sequence(0, size(_w) - 1), i -> _w[if(i < _a, i, _a + (i - _a) % _p)]))")
    return placed.withColumn("text", F.when(F.col("_p").isNotNull(), tail).otherwise(F.col("text"))).drop("_h", "_w", "_g", "_a", "_p")


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.word_runs import find_runs

    found = find_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Runs come by start and period, so of equal exponents the first wins.
    best = F.expr("aggregate(runs, try_element_at(runs, 1), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.merkle import build_manifest, leaf_hash

    def cut() -> Column:
        flat = leaf_hash("doc_id", "source", "lang", "n_chars", F.replace(F.col("text"), F.lit("\n"), F.lit("")))
        return F.when(fold("doc_id", 2) == 0, flat)

    proofs = build_manifest(table(spark, sf_dir, "documents"), tampered=cut).proofs()
    return proofs.select(
        F.col("carried").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quote_threads, op2_hierarchical_mix, op3_kdtree_topk, op4_fourier_quality, op5_token_secrets, op6_line_neighbours, op7_recurrent_toxicity, op8_warc_chunks, op9_jaccard_prefixes, op10_benchmark_templates, op11_bloom_dedup,
                        op12_word_runs, op13_merkle_manifest)
}
ORACLES: dict[str, str] = {name: getattr(sql, name.upper()) for name in QUERIES if hasattr(sql, name.upper())}
