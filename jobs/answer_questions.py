"""Answers a log of questions from a table of documents.

    python -m jobs.answer_questions --config jobs/answer_questions.json --conversations IN --documents IN --out OUT

Every turn of a user is a question.  It is searched for in the documents, the hits are reranked, and it is answered from the best
ones, or gated if even the best is weak; so a change of documents or settings can be judged on the questions that were asked.

OUT/index     postings and statistics of the documents, as this run used them
OUT/answers   conv_id, turn, question, answer, cited, top_score, gated; partitioned by confidence
OUT/summary   a row per confidence: questions, gated, and the mean of their top scores (JSON)

A run writes all of it anew, so running it again on the same input leaves the same output.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import command_line, configuration
from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.operators.generation import first_sentence
from lodestone.operators.index import Index, build_index
from lodestone.plans.retrieve import answer

log = logging.getLogger("jobs.answer_questions")

SETTINGS = {"id", "text", "source", "tag", "role", "top_k"}
ANSWERS = "conv_id long, turn long, question string, answer string, cited array<long>, top_score double, gated boolean, confidence string"


def questions_of(conversations: DataFrame, role: str = "user") -> DataFrame:
    """conv_id, turn, question of the role's turns that have a text, and query_id, which numbers them; equal rows count once."""
    asked = conversations.where((F.col("role") == role) & F.col("text").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").alias("question")).distinct()
    return asked.withColumn("query_id", F.xxhash64("conv_id", "turn", "question"))


def write_answers(questions: DataFrame, index: Index, out: str, *, top_k: int = C.FINAL_TOP_K) -> None:
    """Answers the questions and writes answers and summary."""
    spark = questions.sparkSession
    queries = questions.select("query_id", F.col("question").alias("text"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("array<float>").alias("qvec"))
    answers = answer(queries, index, top_k=top_k, keep_text=first_sentence, by_terms=True).join(questions, "query_id")
    bucket = F.coalesce(T.confidence_bucket(F.col("top_score"), F.col("gated")), F.lit("gated"))
    rows = answers.select("conv_id", "turn", "question", "answer", F.col("citations.chunk_id").alias("cited"), "top_score", "gated", bucket.alias("confidence"))
    rows.write.mode("overwrite").partitionBy("confidence").parquet(f"{out}/answers")
    written = spark.read.schema(ANSWERS).parquet(f"{out}/answers")
    summary = written.groupBy("confidence").agg(F.count("*").alias("questions"), F.count_if("gated").alias("gated"), F.round(F.avg("top_score"), 6).alias("mean_top_score"))
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/summary")  # a row per confidence
    for r in spark.read.schema("confidence string, questions long").json(f"{out}/summary").orderBy("confidence").collect():
        log.info("wrote %d answers of confidence '%s' to %s/answers", r["questions"], r["confidence"], out)


def answer_questions(spark: SparkSession, conversations: str, documents: str, out: str, *, id: str = "doc_id", text: str = "text", source: str = "source", tag: str = "lang", role: str = "user", top_k: int = C.FINAL_TOP_K) -> DataFrame:
    """Answers every question of a log from the documents, and returns the answers as written.

    The search is by keywords: questions without a token that some document has are gated.  Documents without id are left out.
    """
    docs = spark.read.parquet(documents).where(F.col(id).isNotNull())
    chunks = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(source).alias("source"), F.lit(1).alias("page"), F.col(tag).alias("disaster_type"))
    index = build_index(chunks, spark.createDataFrame([], "id long, embedding array<float>"), f"{out}/index")
    for r in index.corpus.collect():  # one row
        log.info("read %d documents of %s, %.1f tokens on average", r["n"], documents, r["avgdl"] or 0)
    asked = questions_of(spark.read.parquet(conversations), role)
    log.info("read %d questions of %s", asked.count(), conversations)
    write_answers(asked, index, out, top_k=top_k)
    return spark.read.schema(ANSWERS).parquet(f"{out}/answers")


def main(argv: list[str] | None = None) -> int:
    args = command_line(__doc__.split("\n")[0], {"conversations": "Parquet table of turns", "documents": "Parquet table of documents", "out": "folder of the written tables"}, argv)
    spark = SparkSession.builder.appName("answer-questions").getOrCreate()
    try:
        answer_questions(spark, args.conversations, args.documents, args.out, **configuration(spark, args.config, SETTINGS))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
