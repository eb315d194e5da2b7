"""Python functions that work on few rows at a time."""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone import batches as B
from lodestone.functions import text as T
from lodestone.operators import chunking as K
from lodestone.operators import dense as D


def test_few_rows_at_a_time():
    """A batch is cut into slices, and a slice's result is passed on before the next is taken."""
    seen = []
    run = B.by_slices(lambda x: seen.append(len(x)) or x, 3)(iter([pa.array(range(8)), pa.array([], pa.int64()), pa.array([9])]))
    assert next(run).to_pylist() == [0, 1, 2] and seen == [3]
    assert [x.to_pylist() for x in run] == [[3, 4, 5], [6, 7], [9]] and seen == [3, 3, 2, 1]


def test_pieces_and_sections_over_slices(spark):
    """Rows of more than one slice, among them nulls and long ones, keep their pieces, paragraphs and sections."""
    texts = [None if i % 7 == 0 else "\n".join([f"Head {i}", "one two three four five six seven eight nine ten eleven twelve.", "# Next"] + ["tail word here."] * (i % 400)) for i in range(2 * B.SLICE + 5)]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = d.select("id", K.recursive_pieces(20, 5)(F.col("text")).alias("p")).collect()
    assert all(r.p == ([] if texts[r.id] is None else K.split_recursively(texts[r.id], 20, 5, K.count_tokens)) for r in got) and len(got) == len(texts)
    whole = d.withColumn("_d", K.described(T.split_blocks(F.coalesce("text", F.lit("")), "\n")))
    want = {r.id: r.s for r in whole.select("id", K.sections(K.dedupe_paragraphs(F.col("_d"))).alias("s")).collect()}
    assert {r.id: r.sections for r in K.section_texts(d, separator="\n", least=0).collect()} == want and len(want[8]) > 1


def test_normal_forms_over_slices(spark):
    """Rows of more than one slice keep their normal forms, and few are Python objects at a time."""
    texts = [None if i % 5 == 0 else f"\ufb01 \u2460 e\u0301 {i}" for i in range(B.SLICE + 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    assert {r.id: r.t for r in rows.select("id", T.nfkc(F.col("text")).alias("t")).collect()} == {i: x and unicodedata.normalize("NFKC", x) for i, x in enumerate(texts)}


def test_matrices_of_a_search_are_bounded(monkeypatch):
    """However many vectors a batch has, STEP of them are scored at a time, with the same rows."""
    rng, seen, offer = np.random.default_rng(5), [], D.Best.offer
    monkeypatch.setattr(D.Best, "offer", lambda self, ids, scores, *rest: seen.append(scores.shape) or offer(self, ids, scores, *rest))
    vectors, queries = rng.normal(size=(1000, 4)).astype("f4"), rng.normal(size=(7, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(list(vectors), pa.list_(pa.float32()))], names=["id", "embedding"])
    found = list(D._search_block(np.arange(7), queries, 3, None, None)(iter([batch])))[0].to_pylist()
    assert max(n for _, n in seen) == D.STEP
    scores = queries @ vectors.astype(float).T
    assert all([r["id"] for r in found if r["query_id"] == q] == np.argsort(-scores[q])[:3].tolist() for q in range(7))
