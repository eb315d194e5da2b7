"""Dense search: the exact best inner products, and inverted lists that score a part of the vectors only.

Queries are taken in blocks of a bounded size.  A block is sent to all tasks, and each task keeps the best k of its vectors for every
query of the block, so that vectors are never shuffled and a task passes on k rows per query whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.batches import giving_back
from lodestone.tables import materialize

PLACES = 9
#: Queries in a block; with their vectors they are what a task gets besides its own rows.
QUERY_BLOCK = 4096
#: Vectors that are scored at a time, which with the queries of a block bounds the matrices of a task.
STEP = 128


def top(scored: DataFrame, k: int | Column, order: list[Column], by: str = "query_id") -> DataFrame:
    """The first k rows of each query, with a rank from 0.  The filter is on row_number itself, so that Spark prunes before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).withColumn("rank", F.col("_rn") - 1).drop("_rn")


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.stack(vectors.to_numpy(zero_copy_only=False)).astype(float) if len(vectors) else np.zeros((0, 0))


class Best:
    """The best k of all rows seen so far for each query, by score and then by the lower id; with a floor only scores above it."""

    def __init__(self, n: int, k: int, floor: float | None = None) -> None:
        self.n, self.k = n, k
        self.at, self.ids, self.scores = (np.zeros(0, t) for t in (np.int64, np.int64, float))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        limits = np.iinfo(np.int64)
        self.count, self.least, self.last = np.zeros(n, np.int64), np.full(n, -np.inf if floor is None else floor), np.full(n, limits.max if floor is None else limits.min)

    def offer(self, ids: np.ndarray, scores: np.ndarray, rows: np.ndarray | None = None, allowed: np.ndarray | None = None) -> None:
        """Offers a matrix of scores, of the queries in rows (all, if that is None) and these ids, where allowed."""
        rows = np.arange(self.n) if rows is None else rows
        if (lost := np.isnan(scores)).any():
            allowed = ~lost if allowed is None else allowed & ~lost
        if allowed is not None:
            scores = np.where(allowed, scores, -np.inf)
        bound = self.least[rows]
        short = np.flatnonzero(self.count[rows] < self.k)
        if len(short) and len(ids) > self.k:  # until k are known, the best k of this matrix are enough
            bound[short] = np.maximum(bound[short], np.partition(scores[short], len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, v = np.nonzero(scores >= (bound - 2 * 10.0**-PLACES)[:, None])
        some, of = np.round(scores[q, v], PLACES) + 0.0, rows[q]
        better = (some > self.least[of]) | ((some == self.least[of]) & (ids[v] < self.last[of]))
        if allowed is not None:
            better &= allowed[q, v]
        if better.any():
            self.waiting.append((of[better], ids[v[better]], some[better]))
            if sum(len(w[0]) for w in self.waiting) > max(1024, len(self.at) // 4):
                self.merge()

    def merge(self) -> None:
        """Puts what waits among the best."""
        at, ids, scores = (np.concatenate(x) for x in zip((self.at, self.ids, self.scores), *self.waiting))
        self.waiting.clear()
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        keep = np.arange(len(at)) - np.searchsorted(at, np.arange(self.n))[at] < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        self.count = np.bincount(self.at, minlength=self.n)
        ends, full = np.cumsum(self.count) - 1, self.count == self.k
        self.least[full], self.last[full] = self.scores[ends[full]], self.ids[ends[full]]

    def found(self, query_ids: np.ndarray) -> pa.RecordBatch:
        """query_id, id, score of the best."""
        self.merge()
        return pa.RecordBatch.from_arrays([pa.array(query_ids[self.at]), pa.array(self.ids), pa.array(self.scores)], names=["query_id", "id", "score"])


def _search_block(query_ids: np.ndarray, queries: np.ndarray, k: int, tags: np.ndarray | None, probes: dict[int, np.ndarray] | None, step: int = STEP):
    """A function over batches of vectors (id, embedding, and tag or list where those are given), `step` of which are scored at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if probes is not None:
                    lists = batch.column(2).to_numpy()
                    for one in np.unique(lists):
                        if one in probes:
                            best.offer(ids[lists == one], queries[probes[one]] @ vectors[lists == one].T, probes[one])
                    continue
                allowed = None
                if tags is not None:
                    own = np.array(batch.column(2).to_pylist(), object)
                    allowed = (tags[:, None] == None) | (tags[:, None] == own[None, :])  # noqa: E711
                best.offer(ids, queries @ vectors.T, None, allowed)
        yield best.found(query_ids)

    return giving_back(run)


_FOUND = "query_id long, id long, score double"


def _blocks(queries: DataFrame, with_tag: bool, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Ids, vectors and tags of the queries that have a vector, in blocks; only one block is at the driver at a time."""
    rows = queries.where(F.col("qvec").isNotNull()).select("query_id", "qvec", *(["tag"] if with_tag else []))
    held: list = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        ids, vectors = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], float)
        return ids, vectors, np.array([r[2] for r in held], object) if with_tag else None

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield block()
            held.clear()
    if held:
        yield block()


def united(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = parts[0] if parts else like.sparkSession.createDataFrame([], _FOUND)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = C.DENSE_TOP_K, *, mode: str = "all", overfetch: int = C.OVERFETCH, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank: the exact k largest inner products.

    mode: all (tags play no part), prefilter (only vectors with the query's tag, if it has one) or overfetch (the best
    overfetch * k of all, then only those with the tag; fewer than k may be left).  vectors has id, embedding and, for
    these, tag; all vectors and queries have one length.  Queries and vectors without one have no rows.
    """
    reach = overfetch * k if mode == "overfetch" else k
    with_tag = mode == "prefilter"
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding", *(["tag"] if with_tag else []))
    found = []
    for ids, block, tags in _blocks(queries, with_tag, query_block):
        wanted = set(tags.tolist()) if with_tag else {None}
        some = rows if None in wanted or len(wanted) > 1000 else rows.where(F.col("tag").isin(sorted(wanted)))
        found.append(some.mapInArrow(_search_block(ids, block, reach, tags, None), _FOUND))
    found = united(found, vectors)
    order = [F.desc("score"), F.asc("id")]
    if mode != "overfetch":
        return top(found, reach, order)
    ranked = top(found, reach, order).join(queries.select("query_id", F.col("tag").alias("_want")), "query_id").where(F.col("_want").isNotNull() | (F.col("rank") < k))
    ranked = ranked.join(vectors.select("id", "tag"), "id")
    near = ranked.where(F.col("_want").isNull() | (F.col("_want") == F.col("tag"))).drop("rank", "_want", "tag")
    return top(near, k, order)


# --- inverted lists ---------------------------------------------------------------------------------------------------

#: Most lists, and so most centres at the driver; and most vectors that the centres are fitted to.
MOST_LISTS, MOST_FIT = 4096, 200_000


@dataclass
class Lists:
    """Vectors (id, embedding, list) by the nearest of some centres, each list in files of its own; and how many lists a search reads."""

    table: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    probes: int

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Numbers of the lists for each query, those with the largest inner product of centre and query first."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")


def _size_bits(rows: DataFrame, most: int) -> DataFrame:
    """At most about `most` rows, chosen by a hash of the id; all, if there are no more."""
    parts = -(-rows.count() // most)
    return rows if parts <= 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0)


def build_lists(vectors: DataFrame, folder: str, *, lists: int | None = None, seed: int = 42, steps: int = 12, recall: float = 0.95, k: int = C.DENSE_TOP_K, samples: int = 256) -> Lists:
    """Splits vectors (id, embedding) into lists by seeded k-means, and finds how many lists reach a recall.

    Centres are fitted to at most MOST_FIT vectors or a little more, every vector is listed.  The default is four lists for each
    square root of vectors, MOST_LISTS at most.  The number of lists to read is the least that finds the given share of the exact k best
    of `samples` vectors as queries.  Vectors that are null are left out; without any there are no lists.
    """
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    n = rows.count()
    lists = min(MOST_LISTS, max(1, n), lists or max(1, int(4 * n**0.5)))
    if not n:
        return Lists(materialize(rows.withColumn("list", F.lit(0)), f"{folder}/lists", ("list",)), np.zeros((0, 0)), np.zeros(0, int), 0)
    points = rows.withColumn("_p", array_to_vector("embedding"))
    model = KMeans(k=lists, seed=seed, maxIter=steps, featuresCol="_p", predictionCol="list").fit(_size_bits(points, MOST_FIT))
    listed = model.transform(points).select("id", "embedding", "list")
    # by range, so that a list with a large share of all vectors is spread over several tasks
    table = materialize(listed.repartitionByRange("list", F.xxhash64("id")), f"{folder}/lists", ("list",))
    centres = np.array(model.clusterCenters(), float)
    sizes = np.zeros(len(centres), int)
    for r in table.groupBy("list").count().collect():  # a row per list
        sizes[r["list"]] = r["count"]
    out = Lists(table, centres, sizes, len(centres))
    asked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(samples).select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    best = dense_topk(asked, rows, k).join(table.select("id", "list"), "id").join(asked, "query_id").select("query_id", "qvec", "list").collect()  # k rows per sample
    if best:
        ranks = np.argsort(out.order(np.array([r["qvec"] for r in best], float)), axis=1)[np.arange(len(best)), [r["list"] for r in best]]
        out.probes = int(np.quantile(ranks, recall, method="higher")) + 1
    return out


def lists_topk(queries: DataFrame, lists: Lists, k: int = C.DENSE_TOP_K, *, probes: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k largest inner products among the vectors of the lists nearest to the query.

    Scores are exact; vectors of lists that aren't read are missed.  Lists that no query of a block reads are pruned with their files.
    """
    found = []
    for ids, block, _ in _blocks(queries, False, query_block):
        nearest = lists.order(block)[:, : probes or lists.probes] if len(lists.centres) else np.zeros((len(ids), 0), int)
        of = {int(one): np.flatnonzero((nearest == one).any(axis=1)) for one in np.unique(nearest)}
        rows = lists.table.where(F.col("list").isin(list(of))) if len(of) < len(lists.centres) else lists.table
        found.append(rows.select("id", "embedding", "list").mapInArrow(_search_block(ids, block, k, None, of), _FOUND))
    return top(united(found, lists.table), k, [F.desc("score"), F.asc("id")])


def scored_share(queries: DataFrame, lists: Lists, *, probes: int | None = None, query_block: int = QUERY_BLOCK) -> float:
    """The share of all pairs of query and vector that lists_topk scores."""
    n = scored = 0
    for ids, block, _ in _blocks(queries, False, query_block):
        n += len(ids)
        scored += int(lists.sizes[lists.order(block)[:, : probes or lists.probes]].sum())
    return scored / (n * int(lists.sizes.sum())) if n and lists.sizes.sum() else 0.0


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of a query's exact rows that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))
