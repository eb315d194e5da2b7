"""Retrieval quality: precision, recall, reciprocal rank, gates, filters, a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T


def pool_quality(pools: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, rr for all queries of pools (query_id, id, rank from 0) or relevant (query_id, id).

    The pool is the first k; precision divides by its length; recall is 0 without relevant rows; rr is 1 / (1 + first relevant rank).
    """
    marked = pools.where(F.col("rank") < k).join(relevant.select("query_id", "id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    of_pool = marked.groupBy("query_id").agg(F.count("*").alias("_n"), F.count("_hit").alias("_hits"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("_first"))
    of_truth = relevant.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("_relevant"))
    both = of_pool.join(of_truth, "query_id", "full_outer")
    share = lambda a, b: F.coalesce(F.round(F.col(a) / F.col(b), 6), F.lit(0.0))
    return both.select("query_id", share("_hits", "_n").alias("precision"), F.least(F.lit(1.0), share("_hits", "_relevant")).alias("recall"), F.coalesce(F.round(1 / (F.col("_first") + 1), 6), F.lit(0.0)).alias("rr"))


def mean_quality(quality: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    return quality.agg(F.count("*").alias("queries"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("rr").alias("mrr"))


def filter_violations(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (query_id, id, disaster_type) whose tag isn't the query's."""
    wanted = queries.where(F.col("tag").isNotNull()).select("query_id", F.col("tag").alias("_want"))
    return hits.join(wanted, "query_id").where(~F.col("disaster_type").eqNullSafe(F.col("_want"))).select("query_id", "id")


def gate_failures(gates: DataFrame, off_corpus: DataFrame) -> DataFrame:
    """Off-corpus queries that were answered."""
    return off_corpus.select("query_id").join(gates.where(~F.col("gated")), "query_id").select("query_id", "top_score")


def weak_scores(gates: DataFrame, watch: float = C.SCORE_WATCH) -> DataFrame:
    """Answered queries with a low top score."""
    return gates.where(~F.col("gated") & (F.col("top_score") < watch)).select("query_id", "top_score")


def accuracy(predictions: DataFrame) -> DataFrame:
    """labelled and accuracy over rows (expected, predicted) with an expectation."""
    hit = F.coalesce((F.col("expected") == F.col("predicted")).cast("int"), F.lit(0))
    return predictions.where(F.col("expected").isNotNull()).agg(F.count("*").alias("labelled"), F.coalesce(F.round(F.avg(hit), 6), F.lit(0.0)).alias("accuracy"))


def summary(means: DataFrame) -> DataFrame:
    """stage, metric, value, threshold, status (PASS, WARN, FAIL) of a row of mean_quality; precision has no bar."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).cast("double").alias("threshold")) for s, m, t in (("candidates", "precision", None), ("candidates", "recall", C.FAIL_BAR), ("final", "mrr", C.FAIL_BAR))]))
    out = means.select(rows.alias("r")).select("r.*")
    status = F.when(F.col("threshold").isNull(), "PASS").when(F.col("value") < F.col("threshold"), "FAIL").when(F.col("value") < C.WARN_BAR, "WARN").otherwise("PASS")
    return out.withColumn("status", status)


def length_histogram(chunks: DataFrame) -> DataFrame:
    """bucket, n: chunks by token count, in half-open buckets; empty buckets are left out.

    One sum for each bucket over a count made once: a filter on the bucket would be pushed down, and count tokens again.
    """
    pairs = list(zip(C.LENGTH_EDGES, C.LENGTH_EDGES[1:]))
    n = F.col("_n")
    counts = chunks.select(T.token_count(F.col("text")).alias("_n")).agg(*[F.count(F.when((n >= a) & (n < b), 1)).alias(f"b{a}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("bucket"), F.col(f"b{a}").alias("n")) for a, b in pairs]))
    return counts.select(rows.alias("r")).select("r.*").where("n > 0")


def length_summary(chunks: DataFrame) -> DataFrame:
    """n, shortest, longest, mean, median and odd_share (too short or too long) of token counts."""
    chunks, n = chunks.select(T.token_count(F.col("text")).alias("_n")), F.col("_n")
    odd = ((n < C.MIN_REASONABLE_TOKENS) | (n > C.MAX_REASONABLE_TOKENS)).cast("int")
    return chunks.agg(F.count("*").alias("n"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.round(F.median(n), 6).alias("median"), F.round(F.avg(odd), 6).alias("odd_share"))


#: Size of a sketch of lengths, and the error in rank that its quantiles keep to (three times what one has in all but 1 % of cases).
SKETCH_SIZE, RANK_ERROR = 1024, 0.01


def length_sketches(chunks: DataFrame, by: str = "source", k: int = SKETCH_SIZE) -> DataFrame:
    """by, n, lengths: for each value of a column a sketch of its chunks' token counts, which can be stored and merged."""
    counted = chunks.select(by, F.coalesce(T.token_count(F.col("text")), F.lit(0)).cast("long").alias("_n"))
    return counted.groupBy(by).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("_n", k).alias("lengths"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """n, lengths of all sketches together, or for each value of some columns."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("lengths").alias("lengths"))


def sketched_quartiles(sketches: DataFrame) -> DataFrame:
    """The sketches' other columns with q1, median, q3: token counts whose ranks are within RANK_ERROR of one, two and three quarters."""
    at = lambda share: F.kll_sketch_get_quantile_bigint("lengths", F.lit(share))
    return sketches.select(*[c for c in sketches.columns if c != "lengths"], at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))


def phrase_hits(chunks: DataFrame, phrases: tuple[str, ...] = C.CRITICAL_PHRASES) -> DataFrame:
    """phrase, n: chunks that have each phrase whole."""
    low = F.lower("text")
    counts = chunks.agg(*[F.coalesce(F.sum(low.contains(p).cast("long")), F.lit(0)).alias(f"p{i}") for i, p in enumerate(phrases)])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("n")) for i, p in enumerate(phrases)]))
    return counts.select(rows.alias("r")).select("r.*")


def sampled(chunks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n chunks in a seeded order."""
    return chunks.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def rows_of_tag(chunks: DataFrame, tag: str | None = None) -> DataFrame:
    """Chunks of a tag, or of all, by tag and id, each with the number of chunks that share its tag; for browsing."""
    wanted = chunks if tag is None else chunks.where(F.col("disaster_type") == tag)
    counts = wanted.groupBy("disaster_type").agg(F.count("*").alias("n_of_tag")).withColumnRenamed("disaster_type", "_tag")
    joined = wanted.join(F.broadcast(counts) if tag else counts, F.col("disaster_type").eqNullSafe(F.col("_tag"))).drop("_tag")
    return joined.orderBy("disaster_type", "id")


def top_values(rows: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """value, n: how often each value occurs, the commonest first (then by value); the first n, or all."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value"))
    return counts if n is None else counts.limit(n)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys' values that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
