"""The numbered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, decontaminate, fingerprints, html_extract, line_dedup, near_dedup, packing, periodic_runs, pii, prefix_trie, quality, sentence_dedup, toxicity
from .common import load

#: Production parameter of the line dedup: the fewest consecutive lines that make a repeat.
RUN_LINES = 2


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by two co-trained views; ``kept`` is the decision."""
    return quality.score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents freed of runs of two and more lines that occur earlier."""
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), run_lines=RUN_LINES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in 10-word windows of benchmark items, and the items found."""
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=10)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by the wrappers of their hosts."""
    return html_extract.extract_pages(load(spark, sf_dir, "pages"))


def op5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every document whose id is divisible by 100, by BM25."""
    return bm25.search(load(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0, k=10)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in all documents."""
    return pii.find_personal_data(load(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of at least 85 %."""
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels train only where crc32 of the doc_id leaves another remainder than 1 by 3."""
    docs = load(spark, sf_dir, "documents").withColumn("held_out", toxicity.crc_held_out(F.col("doc_id")))
    return toxicity.score_toxicity(docs, load(spark, sf_dir, "labels"), F.col("held_out"), keep=("doc_id", "held_out"),
                                   threshold=0.7)


def op9_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents freed of sentence spans that occur earlier; ``repeated`` says whether any was removed."""
    out = sentence_dedup.dedup_sentences(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("repeated", out.n_removed > 0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(load(spark, sf_dir, "documents"), capacity=1024, end_id=2, vocabulary="byte_bpe_50k.json")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations with their subtree totals."""
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of at least 24 words and three periods in all documents, one in ten made periodic first."""
    return periodic_runs.periodic_runs(load(spark, sf_dir, "documents"), least_words=24, retell=True)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and of their edited texts; near rows of those whose id is divisible by 100."""
    return fingerprints.fingerprint_documents(load(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0, radius=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_cotraining, op2_line_dedup, op3_decontamination, op4_html_extraction, op5_bm25_topk,
                                    op6_personal_data, op7_minhash_near_dedup, op8_toxicity, op9_sentence_dedup, op10_best_fit_packing,
                                    op11_prefix_trie, op12_periodic_runs, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""
    return {"op2_line_dedup": line_dedup.ORACLE.replace("{run}", str(RUN_LINES)),
            "op3_decontamination": decontaminate.ORACLE, "op5_bm25_topk": bm25.ORACLE,
            "op11_prefix_trie": prefix_trie.ORACLE}
