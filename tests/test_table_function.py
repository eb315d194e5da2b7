"""The table function against the columns' way of chunking."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking as K
from lodestone.operators import table_function as X

draw = random.Random(23)
LINES = ["Alpha Beta", "# x", "1. Two words", "- item", "What now?", "two words here.", "é à 𝄞 über", "...", " \xa0 ", "UPPER lower mixed Case", "a\rb", "c\r", "Note:", "1. " + "w " * 8]


def test_headings(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "x string").select("x", T.is_heading(F.col("x")).alias("h")).collect()
    for r in rows:
        one = [y for y in r.x.replace("\n", "\r").split("\r") if y.strip(X.SPACES)]
        n = K.count_tokens(r.x)
        assert r.h == (len(one) == 1 and X.looks_like_heading(r.x.strip(X.SPACES), n)), r.x


def test_same_pieces(spark):
    def text():
        return "\n".join(draw.choice([draw.choice(LINES), " ".join(draw.choices("storm water kit plan safe exit".split(), k=draw.randint(1, 400)))]) for _ in range(draw.randint(0, 12)))

    rows = [(i, text(), "s") for i in range(80)] + [(100, None, "s"), (101, "", "s"), (102, "w " * 20_000, "s"), (None, "some words", "s"), (103, text(), None), (103, text(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("section_no", F.lit("clash"))
    docs.createOrReplaceTempView("docs")
    X.register(spark)
    want = K.folded_pieces(docs.select("source", F.col("doc_id").alias("page"), "text"), split=lambda c: K.token_windows(c, 50, 5), separator="\n")
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert plain(spark.sql("SELECT doc_id, section_no, piece_no, text FROM chunk_documents(TABLE(docs) PARTITION BY (doc_id), 50, 5)")) == plain(want.select("page", "section_no", "piece_no", "text"))
    assert plain(spark.sql("SELECT doc_id, text FROM chunk_documents(TABLE(docs), 50, 5)")) == plain(want.select("page", "text"))
    assert spark.sql("SELECT * FROM chunk_documents(TABLE(SELECT * FROM docs WHERE false))").count() == 0
    for wrong in ("TABLE(SELECT 1 AS a)", "TABLE(docs), 5, 5"):
        with pytest.raises(Exception, match="chunk_documents takes|longer than"):
            spark.sql(f"SELECT * FROM chunk_documents({wrong})").collect()
