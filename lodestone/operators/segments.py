"""An index that grows by segments.

Chunks that come are indexed by themselves, in a partition of each table; nothing that is there is read or written again.  Deleted
chunks are listed, with the last segment that the deletion holds for, so that an id may come back.  Loading puts the segments together:
counts of terms, chunks and tokens are sums of the segments' own, less those of deleted chunks.  A merge writes the live rows as one
segment elsewhere.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.index import BY_CHUNK, Index, build_index, exploded, term_weights

_CHUNKS = "id long, text string, source string, page int, disaster_type string, dl long, segment int"
_BY_CHUNK = "id long, dl long, terms array<string>, tfs array<int>, segment int, tag_key string"
_VECTORS = "id long, embedding array<float>, segment int, tag_key string"
_DFS = "term string, df long, segment int"
_TOTALS = "n long, tokens long, segment int"
_DELETED = "id long, upto int, batch int"
#: Up to so many deleted ids are broadcast.
FEW_DELETED = 200_000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_segment(chunks: DataFrame, vectors: DataFrame, path: str, segment: int) -> None:
    """Indexes chunks (id, text, source, page, disaster_type) and their vectors (id, embedding) as a segment; again under the same number, it replaces it.

    Ids are unique within a segment.
    """
    spark = chunks.sparkSession
    chunks = chunks.select("id", "text", "source", F.col("page").cast("int").alias("page"), "disaster_type")
    rows = chunks.withColumn("dl", F.coalesce(T.token_count(F.col("text")), F.lit(0)).cast("long"))
    index = build_index(chunks, vectors)
    write = lambda d, name, *by: d.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}/segment={segment}")
    write(rows, "chunks")
    write(index.by_chunk, "by_chunk", "tag_key")
    write(index.vectors, "vectors", "tag_key")
    written = _read(spark, f"{path}/by_chunk/segment={segment}", BY_CHUNK)
    write(exploded(written).groupBy("term").agg(F.count("*").alias("df")), "dfs")
    write(spark.read.schema(_CHUNKS).parquet(f"{path}/chunks/segment={segment}").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")), "totals")


def delete_chunks(ids: DataFrame, path: str, *, upto: int, batch: int) -> None:
    """Lists ids as deleted from all segments up to a number; again under the same batch, it replaces the list."""
    ids.select(F.col("id").cast("long"), F.lit(upto).alias("upto")).distinct().write.mode("overwrite").parquet(f"{path}/deleted/batch={batch}")


def load_segments(spark: SparkSession, path: str) -> Index:
    """The live rows of all segments as an index, equal to one that is built from them at once."""
    gone = _read(spark, f"{path}/deleted", _DELETED).groupBy(F.col("id").alias("_gone")).agg(F.max("upto").alias("_upto"))
    few = gone.limit(FEW_DELETED + 1).count() <= FEW_DELETED
    dead: Column = (F.col("id") == F.col("_gone")) & (F.col("segment") <= F.col("_upto"))
    listed = F.broadcast(gone) if few else gone
    chunks, by_chunk, vectors = (_read(spark, f"{path}/{n}", s) for n, s in (("chunks", _CHUNKS), ("by_chunk", _BY_CHUNK), ("vectors", _VECTORS)))
    live = lambda d: d.join(listed, dead, "left_anti")
    lost = lambda d: d.join(listed, dead, "left_semi")
    total = _read(spark, f"{path}/totals", _TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    less = lost(chunks.select("id", "segment", "dl")).agg(F.count("*").alias("_n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("_tokens"))
    n, tokens = F.col("n") - F.col("_n"), F.col("tokens") - F.col("_tokens")
    corpus = total.crossJoin(less).select(n.alias("n"), F.when(n > 0, tokens / n).alias("avgdl"))  # one row each
    minus = lost(by_chunk.select("id", "segment", "terms")).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    dfs = _read(spark, f"{path}/dfs", _DFS).groupBy("term").agg(F.sum("df").alias("df")).join(minus, "term", "left")
    dfs = dfs.select("term", (F.col("df") - F.coalesce("_df", F.lit(0))).alias("df")).where("df > 0")
    rows = live(chunks).drop("segment", "dl")
    tags = rows.groupBy(F.col("disaster_type").alias("tag")).agg(F.count("*").alias("n"))
    by_chunk = live(by_chunk).drop("segment")
    return Index(rows, exploded(by_chunk), term_weights(dfs, corpus), corpus, live(vectors).drop("segment"), tags, by_chunk)


def merge_segments(spark: SparkSession, path: str, out: str) -> None:
    """Writes the live rows of all segments as segment 0 of an index at another path."""
    index = load_segments(spark, path)
    append_segment(index.chunks, index.vectors.select("id", "embedding"), out, 0)
