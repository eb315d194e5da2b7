"""Phrases in texts against Python's own search."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.operators import phrases as P

draw = random.Random(9)


@pytest.mark.parametrize("most", [3, 4_000_000])
def test_phrases_in_texts(spark, most):
    """Overlapping, nested, repeated and equal phrases, in one block and in many."""
    phrases = ["a", "aa", "aba", "abab", "b", "ab", "ab", "é", "𝄞a", *("".join(draw.choices("ab ", k=draw.randint(1, 5))) for _ in range(40))]
    texts = ["", "aaaa", "ababab", "𝄞a é𝄞a", *("".join(draw.choices("ab é", k=draw.randint(0, 60))) for _ in range(60))]
    p = spark.createDataFrame(list(enumerate(phrases)), "phrase_id int, phrase string")
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.phrase_id): r.n for r in P.find_phrases(t, p, phrase_chars=most).collect()}
    assert got == {(i, k): x.count(y) for i, x in enumerate(texts) for k, y in enumerate(phrases) if y in x}


def test_odd_rows(spark):
    long = "x " * 200_000 + "needle"
    t = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "needle", "z"), (3, "needle", "z"), (None, "needle", "z"), (4, long, "z")], "id long, text string, phrase string")
    p = spark.createDataFrame([(7, "needle"), (8, None), (9, ""), (None, "needle")], "phrase_id long, phrase string")
    assert sorted(map(tuple, P.find_phrases(t, p).collect()), key=str) == sorted([(3, 7, 1), (3, 7, 1), (None, 7, 1), (4, 7, 1)], key=str)
    assert P.find_phrases(t, p.where("false")).count() == 0 and P.find_phrases(t.where("false"), p).count() == 0


def test_totals_are_the_safety_score(spark):
    texts = [None, "", "Do not do not DRIVE", "warning: turn off, turn off!", *(" ".join(draw.choices(C.SAFETY_PHRASES, k=6)) for _ in range(50))]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    both = t.select(T.safety_score(F.col("text")).alias("a"), P.phrase_totals(C.SAFETY_PHRASES)(F.lower("text")).alias("b")).collect()
    assert all(r.a == r.b for r in both) and any(r.a for r in both)
