"""Queries over the whole tables, one for each operator, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.katz import katz_scores
from lodestone.llm.main_text import main_texts
from lodestone.llm.mixing import mix_sources
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import quality_rules
from lodestone.llm.secret_scan import scan_secrets
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.token_counts import token_counts
from lodestone.llm.toxicity import toxicity
from lodestone.llm.warc import archive_pages
from lodestone.llm.whitening import whiten


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its equals."""
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted", "offending")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, with its counts and distances."""
    return quality_rules(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens in every document."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from deduplicated archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return scan_secrets(documents(spark, sf_dir))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language-model scores of every document."""
    return katz_scores(documents(spark, sf_dir))[0]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with their places in sequences."""
    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return near_duplicates(documents(spark, sf_dir))


def op11_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading whitened components of every whole embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: 160 bits of SHA-1 as 32 letters of five bits: four for each five hexadecimal digits.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id,
       CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_mix_sources": op5_mix_sources,
    "op6_archive_pages": op6_archive_pages,
    "op7_scan_secrets": op7_scan_secrets,
    "op8_katz_scores": op8_katz_scores,
    "op9_pack_documents": op9_pack_documents,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_main_texts": op11_main_texts,
    "op12_whiten_embeddings": op12_whiten_embeddings,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op6_archive_pages": OP6_SQL,
}
