"""The index: postings with document lengths, term statistics and vectors, as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.tables import materialize


#: The key of rows without a tag, and of vectors whose chunk isn't there.
NO_TAG, NO_CHUNK = "none", "absent"


def tag_key(tag: Column) -> Column:
    """A tag as postings and vectors are partitioned by it; never null."""
    return F.coalesce(F.concat(F.lit("t:"), tag), F.lit(NO_TAG))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For chunks (id, tag_key, tokens) a row per chunk with its terms; a few hundred chunks are counted at a time."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 256):
            batch = whole.slice(begin, 256)
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            words = batch.column(2).flatten().dictionary_encode()
            n = max(1, len(words.dictionary))
            keys, tf = np.unique(np.repeat(np.arange(batch.num_rows), lengths) * n + words.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(keys // n, np.arange(batch.num_rows + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(keys % n)))
            columns = [batch.column(0), pa.array(lengths), terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dl", "terms", "tfs", "tag_key"])


#: A chunk's postings in one row.
BY_CHUNK = "id long, dl long, terms array<string>, tfs array<int>, tag_key string"


def postings_by_chunk(chunks: DataFrame, *, id_col: str = "id", text_col: str = "text", tag_col: str = "disaster_type") -> DataFrame:
    """id, dl, terms, tfs, tag_key: a chunk's length in tokens, its distinct terms, how often it has each, and its tag.  Chunks without
    tokens have no rows.

    Ids are unique, so a chunk's terms are counted where the chunk is, and nothing is shuffled.
    """
    t = chunks.select(F.col(id_col).cast("long").alias("id"), tag_key(F.col(tag_col)).alias("tag_key"), T.tokens(F.col(text_col)).alias("_t")).where(F.size("_t") > 0)
    return t.mapInArrow(_counted, BY_CHUNK)


def exploded(by_chunk: DataFrame) -> DataFrame:
    """term, id, tf, dl, tag_key: a row per posting of rows by chunk."""
    rows = by_chunk.select("id", "dl", "tag_key", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
    return rows.select("term", "id", F.col("tf").cast("long").alias("tf"), "dl", "tag_key")


def gathered(posts: DataFrame) -> DataFrame:
    """Rows by chunk of postings; what exploded() takes apart."""
    rows = posts.groupBy("id", "dl", "tag_key").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("_p"))
    return rows.select("id", "dl", F.col("_p.term").alias("terms"), F.col("_p.tf").alias("tfs"), "tag_key")


def postings(chunks: DataFrame, **columns: str) -> DataFrame:
    """term, id, tf, dl, tag_key: how often a chunk has a term, its length in tokens and its tag; see postings_by_chunk."""
    return exploded(postings_by_chunk(chunks, **columns))


def tag_stats(chunks: DataFrame) -> DataFrame:
    """tag, n: the tags and how many chunks have each."""
    return chunks.groupBy(F.col("disaster_type").alias("tag")).agg(F.count("*").alias("n"))


def corpus_stats(chunks: DataFrame, *, text_col: str = "text") -> DataFrame:
    """One row: n chunks and their average length in tokens."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.coalesce(T.token_count(F.col(text_col)), F.lit(0)).cast("double")).alias("avgdl"))


def term_stats(posts: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, df, idf of postings; see term_weights."""
    return term_weights(posts.groupBy("term").agg(F.count("*").alias("df")), corpus)


def term_weights(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, df, idf of counts (term, df).  A negative idf becomes epsilon times the mean of all, negative ones included.

    Terms are counted by df for the mean: a sum over millions of equal values would lose digits.
    """
    weigh = lambda d: d.crossJoin(F.broadcast(corpus.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).drop("n")
    raw = weigh(df)
    mean = weigh(df.groupBy("df").agg(F.count("*").alias("terms"))).agg((F.sum(F.col("raw") * F.col("terms")) / F.sum("terms")).alias("mean"))  # one row, as is corpus
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, C.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass
class Index:
    """Tables; postings and vectors have their chunk's tag as tag_key, and are partitioned by it where they are written.

    Postings are written by chunk: a row is a chunk's, so a task that reads it has all that scores the chunk.
    """

    chunks: DataFrame
    posts: DataFrame
    terms: DataFrame
    corpus: DataFrame
    vectors: DataFrame
    tags: DataFrame
    by_chunk: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.by_chunk is None:
            self.by_chunk = gathered(self.posts)


def build_index(chunks: DataFrame, vectors: DataFrame, folder: str | None = None) -> Index:
    """The tables of chunks (id, text, source, page, disaster_type) and given vectors (id, embedding).

    With a folder all but the chunks are written there first, so that searches read them instead of the texts.
    """
    by_chunk, corpus, tags = postings_by_chunk(chunks), corpus_stats(chunks), tag_stats(chunks)
    keys = chunks.select("id", tag_key(F.col("disaster_type")).alias("tag_key"))
    vectors = vectors.select("id", "embedding").join(keys, "id", "left").withColumn("tag_key", F.coalesce("tag_key", F.lit(NO_CHUNK)))
    if folder:
        by_chunk, vectors = (materialize(d, f"{folder}/{n}", ("tag_key",)) for n, d in (("by_chunk", by_chunk), ("vectors", vectors)))
        corpus, tags = materialize(corpus, f"{folder}/corpus"), materialize(tags, f"{folder}/tags")
    posts = exploded(by_chunk)
    terms = term_stats(posts, corpus)
    if folder:
        terms = materialize(terms, f"{folder}/terms")
    return Index(chunks, posts, terms, corpus, vectors, tags, by_chunk)


def save_index(index: Index, path: str) -> None:
    """Parquet tables, with the counts of their alignment.  Postings (by chunk) and vectors are partitioned by tag."""
    for name in ("chunks", "terms", "corpus", "tags"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    for name in ("vectors", "by_chunk"):
        getattr(index, name).write.mode("overwrite").partitionBy("tag_key").parquet(f"{path}/{name}")
    read = index.chunks.sparkSession.read.parquet
    alignment(*(read(f"{path}/{n}").select("id") for n in ("chunks", "vectors", "by_chunk"))).write.mode("overwrite").parquet(f"{path}/alignment")


def load_index(spark: SparkSession, path: str) -> Index:
    """The saved tables; raises if chunks and vectors didn't match one to one when they were saved."""
    found = spark.read.parquet(f"{path}/alignment").first()
    if found["chunks_without_vector"] or found["vectors_without_chunk"] or found["postings_without_chunk"]:
        raise ValueError(f"the index tables don't match: {found.asDict()}")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("chunks", "terms", "corpus", "tags")}
    for name, schema in (("by_chunk", BY_CHUNK), ("vectors", "id long, embedding array<float>, tag_key string")):
        tables[name] = spark.read.schema(schema).parquet(f"{path}/{name}")  # keys that look like numbers stay strings
    return Index(**tables, posts=exploded(tables["by_chunk"]))


def alignment(chunk_ids: DataFrame, vector_ids: DataFrame, posting_ids: DataFrame) -> DataFrame:
    """One row: rows of each table, and the ids that one has and another lacks."""
    tagged = [d.select("id", *[F.lit(int(i == j)).alias(n) for j, n in enumerate("cvp")]) for i, d in enumerate((chunk_ids, vector_ids, posting_ids))]
    by_id = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("id").agg(*[F.sum(n).alias(n) for n in "cvp"])
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    has = lambda n: F.col(n) > 0
    return by_id.agg(
        total("c", "chunks"), total("v", "vectors"), total("p", "posting_ids"),
        total((has("c") & ~has("v")).cast("int"), "chunks_without_vector"), total((has("v") & ~has("c")).cast("int"), "vectors_without_chunk"),
        total((has("p") & ~has("c")).cast("int"), "postings_without_chunk"),
    )


def hashed_embedder(dim: int = 384):
    """The default embedding: signed hashed token counts, of unit length.  A model may take its place."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        from lodestone.operators.chunking import _TOKEN

        def one(text: str | None) -> np.ndarray:
            v = np.zeros(dim)
            for token in _TOKEN.findall((text or "").lower()):
                h = xxhash.xxh64_intdigest(token)
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32)

        return texts.map(one)

    return embed


def embed_chunks(chunks: DataFrame, embed=None) -> DataFrame:
    return chunks.select("id", (embed or hashed_embedder())(F.col("text")).alias("embedding"))
