"""An index of segments against one that is built at once."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as I
from lodestone.operators import search as S
from lodestone.operators import segments as X

draw = random.Random(31)
CHUNK = "id long, text string, source string, page int, disaster_type string"


def row(i):
    return (i, " ".join(draw.choices("storm water kit plan safe exit rare".split() + [f"w{j}" for j in range(40)], k=draw.randint(0, 20))) or None, f"s{i % 3}", 1, draw.choice(["flood", "fire", None]))


def rows_of(df):
    return sorted(map(repr, ([round(v, 9) if isinstance(v, float) else v for v in r] for r in df.select(*sorted(df.columns)).collect())))


def same(spark, index, rows):
    chunks = spark.createDataFrame(rows, CHUNK)
    whole = I.build_index(chunks, vectors(spark, rows))
    for name in ("chunks", "posts", "terms", "corpus", "vectors", "tags"):
        assert rows_of(getattr(index, name)) == rows_of(getattr(whole, name)), name
    q = spark.createDataFrame([(1, "storm water rare", "fire"), (2, "kit plan w1 w2", None)], "query_id long, text string, tag string")
    for filtered in (False, True):
        assert rows_of(S.bm25_topk(q, index, 9, filtered=filtered)) == rows_of(S.bm25_topk(q, whole, 9, filtered=filtered))


def vectors(spark, rows):
    return spark.createDataFrame([(r[0], [float(r[0]), 1.0]) for r in rows], "id long, embedding array<float>")


def test_segments(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "index")
    parts = [[row(i) for i in range(0, 40)], [row(i) for i in range(40, 70)], [row(3), row(5), row(100)]]
    for k in (0, 1):
        X.append_segment(spark.createDataFrame(parts[k], CHUNK), vectors(spark, parts[k]), at, k)
    same(spark, X.load_segments(spark, at), parts[0] + parts[1])
    gone = spark.createDataFrame([(i,) for i in (3, 5, 50, 999)], "id long")
    for _ in range(2):  # again, to no effect
        X.delete_chunks(gone, at, upto=1, batch=0)
    left = [r for r in parts[0] + parts[1] if r[0] not in (3, 5, 50)]
    same(spark, X.load_segments(spark, at), left)
    for _ in range(2):  # ids that were deleted come back, and a segment may be written again
        X.append_segment(spark.createDataFrame(parts[2], CHUNK), vectors(spark, parts[2]), at, 2)
    same(spark, X.load_segments(spark, at), left + parts[2])
    X.delete_chunks(spark.createDataFrame([(3,), (0,)], "id long"), at, upto=2, batch=1)
    monkeypatch.setattr(X, "FEW_DELETED", 1)  # joined by shuffle
    left = [r for r in left + parts[2] if r[0] not in (0, 3)]
    same(spark, X.load_segments(spark, at), left)
    X.merge_segments(spark, at, str(tmp_path / "merged"))
    same(spark, X.load_segments(spark, str(tmp_path / "merged")), left)


def test_no_segments(spark, tmp_path):
    index = X.load_segments(spark, str(tmp_path / "none"))
    assert index.posts.count() == index.chunks.count() == index.terms.count() == 0 and index.corpus.first().n == 0
    empty = spark.createDataFrame([], CHUNK)
    X.append_segment(empty, spark.createDataFrame([], "id long, embedding array<float>"), str(tmp_path / "empty"), 0)
    assert X.load_segments(spark, str(tmp_path / "empty")).corpus.first().n == 0
