"""The jobs as queries over the whole tables, each run twice into the same new folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.answer_questions import answer_questions
from jobs.refresh_chunks import refresh_chunks
from lodestone import constants as C
from lodestone.catalog import tokens_sql
from lodestone.catalog.search import LEXICAL, bm25_sql
from lodestone.catalog.texts import CHUNKS
from lodestone.tables import workspace


def job1_refresh_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published chunks after the documents were taken, and a second run found nothing new."""
    at = workspace(spark, "job1")
    for _ in range(2):
        chunks = refresh_chunks(spark, f"{sf_dir}/documents.parque[t]", f"{at}/out", f"{at}/checkpoint")  # a pattern, as a stream takes no single file
    return chunks.select("source", "page", "section_no", "piece_no", F.md5(F.col("text").cast("binary")).alias("text"), "disaster_type", "lang", "batch")


JOB1_SQL = f"""WITH RECURSIVE {CHUNKS}
SELECT source, page, CAST(section_no AS INTEGER) AS section_no, CAST(piece_no AS INTEGER) AS piece_no, md5(text) AS text, disaster_type, lang, 0 AS batch FROM chunks"""


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to all users' turns after two runs over the same input."""
    at = workspace(spark, "job2")
    for _ in range(2):
        answers = answer_questions(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", at)
    return answers.select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("question"), "answer", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.round("top_score", 6).alias("top_score"), "gated", "confidence")


_ASKED = f"""asked AS (SELECT DISTINCT conv_id, turn, text AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL),
q AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, question) AS query_id, question AS text, CAST(NULL AS VARCHAR) AS tag FROM asked),
qocc AS"""
_TABLES = LEXICAL[: LEXICAL.index("q AS (")] + _ASKED + LEXICAL.split("qocc AS", 1)[1]
_SAFETY = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{p.replace(chr(39), chr(39) * 2)}', ''))) // {len(p)}" for p in C.SAFETY_PHRASES)
JOB2_SQL = rf"""WITH {_TABLES}, {bm25_sql("sparse", False)},
pairs AS (SELECT s.query_id, s.id, s.rank, d.text, list_distinct({tokens_sql("q.text")}) AS qt, {tokens_sql("d.text")} AS dt FROM sparse s JOIN q USING (query_id) JOIN documents d ON d.doc_id = s.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS final_rank
  FROM (SELECT *, CASE WHEN len(qt) = 0 THEN 0.0 ELSE round(len(list_intersect(qt, dt)) / len(qt), 9) END AS score FROM pairs)),
gates AS (SELECT q.*, top_score, top_score IS NULL OR top_score < 0.1 AS gated FROM q LEFT JOIN (SELECT query_id, max(score) AS top_score FROM ranked GROUP BY query_id) USING (query_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_SAFETY} DESC, final_rank) AS order_no FROM ranked JOIN (SELECT query_id FROM gates WHERE NOT gated) USING (query_id) WHERE final_rank < 4),
said AS (SELECT query_id, string_agg(id, ',' ORDER BY order_no) AS cited,
  string_agg(trim(regexp_extract(regexp_replace(text, '^\s+', ''), '^[^.!?\n]*[.!?]?')) || ' [' || order_no || ']', ' ' ORDER BY order_no) AS answer FROM hits GROUP BY query_id)
SELECT conv_id, turn, md5(question) AS question, CASE WHEN gated THEN '{C.LOW_CONFIDENCE_MESSAGE}' ELSE answer END AS answer, coalesce(cited, '') AS cited, round(top_score, 6) AS top_score, gated,
       CASE WHEN gated THEN 'gated' WHEN top_score >= 0.7 THEN 'high confidence' WHEN top_score >= 0.3 THEN 'partial match' ELSE 'low match' END AS confidence
FROM gates LEFT JOIN said USING (query_id)"""

QUERIES = {"job1_refresh_chunks": job1_refresh_chunks, "job2_answer_questions": job2_answer_questions}
ORACLES = {"job1_refresh_chunks": JOB1_SQL, "job2_answer_questions": JOB2_SQL}
