"""Exact dense search in blocks, and inverted lists, against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import search as catalog
from lodestone.operators import dense as D

npr = np.random.default_rng(11)


def tables(spark, v, every=10):
    vectors = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(5)
    asked = vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.lit(None).cast("string").alias("tag"), F.col("embedding").alias("qvec"))
    return vectors, asked


def exact(v, q, k):
    scores = np.round(v[q].astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, D.PLACES)
    return [(s, i) for s, i in sorted((-s, i) for i, s in enumerate(scores))[:k]]


def rows_by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("block, step", [(3, 4), (4096, 512)])
def test_exact_with_many_ties(spark, monkeypatch, block, step):
    """A third of all vectors are one vector: the k best of them are those with the least ids."""
    v = np.round(npr.normal(0, 1, (150, 6)), 1)
    v[::3] = v[0]
    vectors, asked = tables(spark, v)
    monkeypatch.setattr(D._search_block, "__defaults__", (step,))
    got = rows_by_query(D.dense_topk(asked, vectors, 7, query_block=block))
    assert got == {q: [i for _, i in exact(v, q, 7)] for q in range(0, 150, 10)}


def test_task_passes_on_k_rows_per_query(spark):
    v = np.ones((400, 3))
    vectors, asked = tables(spark, v, every=100)
    ids, block, _ = next(D._blocks(asked, False, 10))
    found = vectors.mapInArrow(D._search_block(ids, block, 5, None, None), D._FOUND)
    assert found.count() <= 5 * 4 * vectors.rdd.getNumPartitions()


def test_lists(spark, tmp_path):
    """On clustered vectors a small share is scored; reading all lists is exact; every vector has one list."""
    centres = npr.normal(0, 1, (30, 16))
    v = np.concatenate([c + npr.normal(0, 0.05, (60, 16)) for c in centres])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors, asked = tables(spark, v, every=20)
    lists = D.build_lists(vectors, str(tmp_path / "lists"), lists=40)
    assert lists.table.count() == len(v) == lists.sizes.sum() and lists.table.select("id").distinct().count() == len(v)
    want = {q: [i for _, i in exact(v, q, 15)] for q in range(0, len(v), 20)}
    got = rows_by_query(D.lists_topk(asked, lists))
    assert np.mean([len(set(got[q]) & set(w)) / 15 for q, w in want.items()]) >= 0.9
    assert D.scored_share(asked, lists) < 0.3
    assert rows_by_query(D.lists_topk(asked, lists, probes=len(lists.centres), query_block=7)) == want
    found = {r.query_id: r.recall for r in D.recall_of(D.lists_topk(asked, lists), D.dense_topk(asked, vectors)).collect()}
    assert found == {q: len(set(got[q]) & set(w)) / 15 for q, w in want.items()}
    plan = D.lists_topk(asked.limit(1), lists, probes=1)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "PartitionFilters: [isnotnull(list" in plan


def test_a_hot_list_is_spread(spark, tmp_path):
    v = np.concatenate([np.tile([[1.0, 0.0]], (3000, 1)), npr.normal(0, 1, (3000, 2))])
    vectors, _ = tables(spark, v)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a small table is spread as a large one is
    try:
        lists = D.build_lists(vectors, str(tmp_path / "lists"), lists=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = int(np.argmax(lists.sizes))
    files = lists.table.where(F.col("list") == hot).select("_metadata.file_path").distinct().count()
    assert lists.sizes[hot] >= 3000 and files > 1


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 5), (2, None, 5), (3, [0.0, 1.0], 5), (3, [0.0, 1.0], 5)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>, list int")
    asked = spark.createDataFrame([(1, None, [1.0, 0.5]), (2, "t", None)], "query_id long, tag string, qvec array<float>")
    lists = D.build_lists(vectors, str(tmp_path / "a"))
    for found in (D.dense_topk(asked, vectors, 3), D.lists_topk(asked, lists, 3, probes=9)):
        assert [(r.query_id, r.id, r.rank) for r in found.orderBy("rank").collect()] == [(1, 1, 0), (1, 3, 1), (1, 3, 2)]
    none = D.build_lists(vectors.where("false"), str(tmp_path / "b"))
    assert D.lists_topk(asked, none).count() == 0 and D.dense_topk(asked, vectors.where("false")).count() == 0 and D.dense_topk(asked.where("false"), vectors).count() == 0


def test_recall_over_the_table(spark):
    found = catalog.dense_lists_recall(spark, "/root/testdata/sf0.01").agg(F.avg("recall").alias("recall"), F.max("scored_share").alias("share"), F.count("*").alias("n")).first()
    assert found.n == 25 and found.recall >= 0.9 and found.share < 0.75
