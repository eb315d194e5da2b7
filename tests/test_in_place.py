"""Keyword search that scores chunks where they are read."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import index as I
from lodestone.operators import search as S
from lodestone.operators.dense import Best, top

draw = random.Random(77)


def tables(spark, chunks, asked):
    words = "storm water kit plan safe".split() + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(draw.choices(words, weights=[20] * 5 + [1] * 60, k=n))
    docs = spark.createDataFrame([(i, say(draw.randint(0, 25)), "s", 1, draw.choice(["flood", "fire", None])) for i in range(chunks)], "id long, text string, source string, page int, disaster_type string")
    q = spark.createDataFrame([(i, say(6), draw.choice(["flood", None, "nowhere"])) for i in range(asked)], "query_id long, text string, tag string")
    return docs, q, I.build_index(docs, spark.createDataFrame([], "id long, embedding array<float>"))


def test_rows_of_the_whole_search(spark, monkeypatch):
    """The same best rows as by all scores, with small blocks of queries and small stretches of pairs."""
    _, q, index = tables(spark, 300, 9)
    monkeypatch.setattr(S, "QUERY_BLOCK", 4)
    monkeypatch.setattr(S, "PAIRS", 300)
    for filtered in (False, True):
        want = top(S.bm25_scores(q, index, filtered=filtered).where("score > 0"), 7, [F.desc("score"), F.asc("id")])
        rows = lambda d: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in d.collect())
        assert rows(S.bm25_topk(q, index, 7, filtered=filtered)) == rows(want)


def test_no_pairs_are_shuffled(spark):
    """Of a word that all chunks have, a task passes on k rows per query."""
    docs = spark.range(0, 4000, 1, 4).select("id", F.lit("storm").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("page"), F.lit("t").alias("disaster_type"))
    index = I.build_index(docs, spark.createDataFrame([], "id long, embedding array<float>"))
    index.terms = index.terms.withColumn("idf", F.lit(1.0))
    q = spark.createDataFrame([(i, "storm", None) for i in range(3)], "query_id long, text string, tag string")
    asked = next(S._asked(q, index, False))
    rows = index.by_chunk.crossJoin(F.broadcast(index.corpus.select("avgdl"))).select("id", "dl", "terms", "tfs", "tag_key", "avgdl")
    assert rows.mapInArrow(S._scored(asked, 5, False), "query_id long, id long, score double").count() == 3 * 5 * 4
    assert [r.id for r in S.bm25_topk(q, index, 5).where("query_id = 1").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_best_of_matrices():
    """Ties, floors, masks and NaN against sorting."""
    rng = np.random.default_rng(3)
    best, plain, seen = Best(4, 3, 0.0), Best(4, 3), []
    for part in range(30):
        scores = rng.integers(-3, 6, (4, 11)).astype(float)
        scores[rng.random(scores.shape) < 0.05] = np.nan
        ids, allowed = rng.permutation(400)[:11] * 30 + part, rng.random((4, 11)) < 0.7
        best.offer(ids, scores, None, allowed)
        plain.offer(ids, scores)
        seen += [(q, i, scores[q, j], allowed[q, j]) for q in range(4) for j, i in enumerate(ids)]
    for got, keep in ((best, lambda s, ok: ok and s > 0), (plain, lambda s, ok: s == s)):
        found = got.found(np.arange(4)).to_pydict()
        want = {q: sorted((-s, i) for a, i, s, ok in seen if a == q and keep(s, ok))[:3] for q in range(4)}
        assert {q: sorted((-s, i) for a, i, s in zip(found["query_id"], found["id"], found["score"]) if a == q) for q in range(4)} == want
