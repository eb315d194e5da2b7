"""Postings that are kept in a row per chunk."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import index as I


def test_by_chunk(spark, tmp_path):
    """They are taken apart and gathered again, and written a row per chunk."""
    docs = spark.createDataFrame([(i, "storm " * (i % 4) + f"w{i % 7} " * (i % 3), "s", 1, ["flood", "fire", None][i % 3]) for i in range(40)], "id long, text string, source string, page int, disaster_type string")
    index = I.build_index(docs, spark.createDataFrame([], "id long, embedding array<float>"), str(tmp_path))
    rows = lambda d: sorted((r.id, r.dl, r.tag_key, sorted(zip(r.terms, r.tfs))) for r in d.collect())
    assert rows(index.by_chunk) == rows(I.gathered(index.posts)) and index.by_chunk.count() == docs.where(F.size(T.tokens(F.col("text"))) > 0).count()
    assert {(r.term, r.tf) for r in index.posts.where("id = 11").collect()} == {("storm", 3), ("w4", 2)}
