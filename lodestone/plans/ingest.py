"""The index build: files to chunks to index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunking import chunk_blocks, chunk_pages
from lodestone.operators.cleaning import clean_scrapes
from lodestone.operators.index import Index, build_index, embed_chunks
from lodestone.sources import files as S
from lodestone.tables import consecutive_ids, materialize, workspace


def number_chunks(parts: list[DataFrame]) -> DataFrame:
    """Chunks of several sources (source, page, section_no, piece_no, text, disaster_type) with ids in the order of the sources.

    Within a source they stand by page, or by the column order_page where there is one (sidecars keep their blocks' order).
    """
    union = S.in_source_order([p if "order_page" in p.columns else p.withColumn("order_page", F.col("page")) for p in parts])
    numbered = consecutive_ids(union, [F.col(c) for c in ("source_rank", "source", "order_page", "section_no", "piece_no")])
    return numbered.select("id", "text", "source", F.col("page").cast("int").alias("page"), "disaster_type")


def build(spark: SparkSession, *, ready: str | None = None, cross: str | None = None, emd: list[str] | None = None, sidecars: str | None = None, pdfs: str | None = None, decode_pdf=None, embed=None, cleaned_to: str | None = None) -> Index:
    """Reads raw scrapes of the three dialects, sidecars and PDFs (those without a sidecar, if a decoder is given).

    Cleaned texts, pages and chunks of a dialect are written before they are used: a filter that is pushed down through
    the line rules would repeat them many times over.  With cleaned_to the cleaned texts stay there, in a folder for each
    dialect.  Without documents, or without chunks, it raises ValueError.
    """
    side = S.read_texts(spark, sidecars, "*.md") if sidecars else None
    parts = []
    if pdfs and decode_pdf:
        from lodestone.functions import text as T
        from lodestone.operators.layout import page_texts

        words = S.read_pdf_words(spark, pdfs, decode_pdf)
        if side is not None:
            words = S.without_sidecar(words, side.select(F.regexp_replace("source", r"\.md$", ".pdf").alias("source")))
        pages = page_texts(words, ["source", "page"])
        parts.append(chunk_pages(pages.select("source", "page", T.clean(F.col("text")).alias("text")).where("text <> ''")))
    for dialect, files in (("ready", ready and S.read_texts(spark, ready)), ("cross", cross and S.read_texts(spark, cross)), ("emd", emd and S.read_first_of(spark, emd))):
        if files is not None and files:
            S.require_rows(files, f"no source documents for {dialect}")
            cleaned = materialize(clean_scrapes(files, dialect), workspace(spark, f"cleaned-{dialect}"))
            if cleaned_to:
                S.write_texts(cleaned, f"{cleaned_to}/{dialect}")
                cleaned = S.read_cleaned(spark, f"{cleaned_to}/{dialect}")
            pages = materialize(S.text_pages(cleaned), workspace(spark, f"pages-{dialect}"))
            parts.append(materialize(chunk_pages(pages), workspace(spark, f"chunks-{dialect}")))
    if side is not None:
        S.require_rows(side, "no sidecars")
        blocks = chunk_blocks(S.sidecar_blocks(side))
        parts.append(blocks.select("source", "page", F.col("block_no").alias("section_no"), F.lit(0).alias("piece_no"), "text", "disaster_type", F.lit(0).alias("order_page")))
    if not parts:
        raise ValueError("no sources")
    chunks = materialize(number_chunks(parts), workspace(spark, "chunks"))
    S.require_rows(chunks, "no chunks")
    return build_index(chunks, embed_chunks(chunks, embed))


def build_report(chunks: DataFrame) -> DataFrame:
    """source, disaster_type, n: the chunks of a build by source and tag."""
    return chunks.groupBy("source", "disaster_type").agg(F.count("*").alias("n"))
