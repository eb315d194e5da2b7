"""Keeps a table of search chunks up to date with a growing folder of documents.

    python -m jobs.refresh_chunks --config jobs/refresh_chunks.json --documents IN --out OUT --checkpoint CHECKPOINT

Each run takes the files that have come since the last one (a file stream with availableNow and a checkpoint), cleans their
documents into chunks and publishes those that their source hasn't published before.

OUT/chunks   source, page, section_no, piece_no, text, disaster_type, key; partitioned by batch and by the tag column
OUT/report   a row per batch and source: documents, pieces, short, repeated, published; partitioned by batch

A batch overwrites its own partitions and nothing else, so that one that is run again after a failure leaves what it would have
left the first time.  A file that has been taken must not change; a corrected document comes in a new file, under a new id.
"""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.settings import command_line, configuration
from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.operators import chunking as K
from lodestone.operators.tagging import tag_of

log = logging.getLogger("jobs.refresh_chunks")

SETTINGS = {"id", "text", "source", "tag", "separator", "window", "overlap"}
#: Names of columns of the chunks, which the tag column can't have.
RESERVED = {"source", "page", "section_no", "piece_no", "text", "disaster_type", "key", "batch"}
REPORT = "batch int, source string, documents long, pieces long, short long, repeated long, published long"


def _chunk_schema(tag: str) -> str:
    return f"source string, page long, section_no int, piece_no int, text string, disaster_type string, key string, batch int, `{tag}` string"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; an empty one if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def published_chunks(spark: SparkSession, out: str, tag: str = "lang") -> DataFrame:
    """All chunks that have been published."""
    return read_if_there(spark, f"{out}/chunks", _chunk_schema(tag))


def _overwrite(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


#: Up to so many keys of a batch are broadcast to find those that are published; the table of published chunks isn't shuffled then.
BROADCAST_KEYS = 200_000


def not_published(chunks: DataFrame, earlier: DataFrame) -> DataFrame:
    """The chunks (source, key, ...) whose source hasn't published their key yet."""
    if earlier.isEmpty():
        return chunks
    keys = chunks.select("source", "key").distinct()
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key"))
    known = earlier.select(F.col("source").alias("_source"), F.col("key").alias("_key")).join(F.broadcast(keys) if few else keys, same, "left_semi")
    return chunks.join(known, same, "left_anti")  # known has no more rows than the chunks


def keyed(pieces: DataFrame) -> DataFrame:
    """pieces with n (tokens) and key (of the tokens), each text taken apart once."""
    return pieces.withColumn("_tokens", T.tokens(F.col("text"))).withColumn("n", F.size("_tokens")).withColumn("key", F.sha2(F.array_join("_tokens", " "), 256)).drop("_tokens")


def publish(batch: DataFrame, number: int, out: str, *, id: str = "doc_id", text: str = "text", source: str = "source", tag: str = "lang", separator: str = "\n", window: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> None:
    """Publishes a batch of documents under its number.

    Of equal chunks of a source the first stays, by batch and then by document and place.  Documents without text or id give
    no chunks but count in the report; null and empty tags share a partition and are read back as null.
    """
    spark = batch.sparkSession
    pages = batch.select(F.col(source).cast("string").alias("source"), F.col(id).cast("long").alias("page"), F.col(text).cast("string").alias("text"), F.col(tag).cast("string").alias("_tag"))
    pieces = K.folded_pieces(pages.where("page IS NOT NULL"), split=lambda c: K.token_windows(c, window, overlap), separator=separator, keep=("_tag",))
    pieces = keyed(pieces).persist(StorageLevel.DISK_ONLY)  # for chunks and report
    try:
        earlier = published_chunks(spark, out, tag).where(F.col("batch") < number)
        long_enough = pieces.where(F.col("n") >= C.MIN_MEANINGFUL_TOKENS).drop("n")
        firsts = Window.partitionBy("source", "key").orderBy("page", "section_no", "piece_no")
        chunks = long_enough.withColumn("_rn", F.row_number().over(firsts)).where("_rn = 1").drop("_rn")
        fresh = not_published(chunks.withColumn("disaster_type", tag_of(F.col("source"), F.col("text"))), earlier)
        _overwrite(fresh.withColumn("batch", F.lit(number)).withColumnRenamed("_tag", tag), f"{out}/chunks", "batch", tag)
        mine = published_chunks(spark, out, tag).where(F.col("batch") == number)
        counts = [
            pages.groupBy("source").agg(F.count("*").alias("documents")),
            pieces.groupBy("source").agg(F.count("*").alias("pieces"), F.count_if(F.col("n") < C.MIN_MEANINGFUL_TOKENS).alias("short")),
            mine.groupBy("source").agg(F.count("*").alias("published")),
        ]
        named = [c.withColumnRenamed("source", f"_s{i}") for i, c in enumerate(counts)]
        report = named[0].join(named[1], F.col("_s0").eqNullSafe(F.col("_s1")), "left").join(named[2], F.col("_s0").eqNullSafe(F.col("_s2")), "left")
        number_of = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        report = report.select(F.lit(number).alias("batch"), F.col("_s0").alias("source"), "documents", *map(number_of, ("pieces", "short", "published")))
        report = report.withColumn("repeated", F.col("pieces") - F.col("short") - F.col("published"))
        _overwrite(report, f"{out}/report", "batch")
        for r in spark.read.schema(REPORT).parquet(f"{out}/report").where(F.col("batch") == number).agg(F.count("*").alias("sources"), *[F.sum(c).alias(c) for c in ("documents", "pieces", "short", "repeated", "published")]).collect():
            log.info("batch %d: read %s documents of %s sources, cut %s pieces; %s too short, %s repeated, wrote %s chunks to %s/chunks", number, r["documents"], r["sources"], r["pieces"], r["short"], r["repeated"], r["published"], out)
    finally:
        pieces.unpersist()


def refresh_chunks(spark: SparkSession, documents: str, out: str, checkpoint: str, **settings) -> DataFrame:
    """Publishes the documents in files that no earlier run with this checkpoint took, and returns all published chunks.

    documents is a folder of Parquet files, or a pattern.  All new files make one batch; before there are any, nothing is done.
    The tables in out and the checkpoint belong together.
    """
    tag = settings.get("tag", "lang")
    if tag in RESERVED:
        raise ValueError(f"the tag column can't be called {tag}")
    try:
        schema = spark.read.parquet(documents).schema
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        log.info("no files in %s", documents)
        return published_chunks(spark, out, tag)
    log.info("documents %s, checkpoint %s", documents, checkpoint)
    stream = spark.readStream.schema(schema).parquet(documents)
    query = stream.writeStream.foreachBatch(lambda batch, number: publish(batch, number, out, **settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not any(p.numInputRows for p in query.recentProgress):
        log.info("no new files")
    return published_chunks(spark, out, tag)


def main(argv: list[str] | None = None) -> int:
    args = command_line(__doc__.split("\n")[0], {"documents": "folder of Parquet files", "out": "folder of the published tables", "checkpoint": "folder of the stream's checkpoint"}, argv)
    spark = SparkSession.builder.appName("refresh-chunks").getOrCreate()
    try:
        refresh_chunks(spark, args.documents, args.out, args.checkpoint, **configuration(spark, args.config, SETTINGS))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
