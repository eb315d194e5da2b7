"""Keyword search with pruned postings against the whole search."""

import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import search as catalog
from lodestone.operators import index as I
from lodestone.operators import pruned as R
from lodestone.operators import search as S

draw = random.Random(21)
WORDS = [f"w{i}" for i in range(60)]


def text(n):
    """Words by a steep law, so that some are in most texts and have a negative weight."""
    return " ".join(WORDS[min(len(WORDS) - 1, int(draw.paretovariate(0.7)) - 1)] for _ in range(n))


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("size, k", [(1, 3), (4, 15), (64, 5)])
def test_same_rows(spark, tmp_path, size, k):
    texts = [text(draw.choice([3, 10, 60, 200])) for _ in range(250)] + ["", "w0 w0 w0", "w59"] * 3
    chunks = spark.createDataFrame([(i * 3, t, "s", 1, "x") for i, t in enumerate(texts)], "id long, text string, source string, page int, disaster_type string")
    index = I.build_index(chunks, spark.createDataFrame([], "id long, embedding array<float>"))
    asked = [text(n) for n in (1, 2, 5, 30, 80)] + ["w59 w58 w57", "w0", "unheard", "", "w0 w0 w1 w59 w59", None]
    q = spark.createDataFrame([(i, t, None) for i, t in enumerate(asked)], "query_id long, text string, tag string")
    blocks = R.build_blocks(index, str(tmp_path / "index"), size)
    assert all(len(r.rows) == r.n <= size and max(x.part for x in r.rows) == r.most for r in blocks.blocks.collect())
    got = R.pruned_topk(q, blocks, str(tmp_path / "run"), k)
    assert rows(got.found) == rows(S.bm25_topk(q, index, k))
    reads = {r["pass"]: r.postings for r in got.reads.collect()}
    there = reads.pop("all there are")
    reads.pop("bounds of blocks")
    assert sum(reads.values()) <= there + reads["promising blocks"] + reads["seeds"]


def test_less_is_read(spark):
    """Of the table's postings a part is read; sf0.1 needs under one half (README), these few documents more."""
    reads = {r["pass"]: r.postings for r in catalog.bm25_postings_read(spark, "/root/testdata/sf0.01").collect()}
    assert sum(n for name, n in reads.items() if name not in ("all there are", "bounds of blocks")) < 0.9 * reads["all there are"]


def test_nothing_to_search(spark, tmp_path):
    chunks = spark.createDataFrame([], "id long, text string, source string, page int, disaster_type string")
    index = I.build_index(chunks, spark.createDataFrame([], "id long, embedding array<float>"))
    q = spark.createDataFrame([(1, "a", None)], "query_id long, text string, tag string")
    assert R.pruned_topk(q, R.build_blocks(index, str(tmp_path / "i")), str(tmp_path / "r")).found.count() == 0
    assert R.pruned_topk(q.where(F.lit(False)), R.build_blocks(index, str(tmp_path / "j")), str(tmp_path / "s")).found.count() == 0


def test_postings_stay_with_their_chunks(spark, tmp_path):
    """A row per block, not per term and block, from the tasks that have the chunks; no posting is lost or shuffled."""
    rows = spark.range(3000).selectExpr("id", "concat('w', id % 7, ' w', id % 11, ' x', id) AS text", "'s' AS source", "1 AS page", "'x' AS disaster_type").repartition(3)
    index = I.build_index(rows, spark.createDataFrame([], "id long, embedding array<float>"), str(tmp_path / "index"))
    blocks = R.build_blocks(index, str(tmp_path / "blocks"))
    assert blocks.by_block.count() <= 3000 / R.BLOCK + 3 and blocks.by_block.selectExpr("sum(size(ids))").first()[0] == 3000
    assert blocks.by_block.selectExpr("sum(size(places))").first()[0] == blocks.blocks.selectExpr("sum(n)").first()[0] == index.posts.count()


def test_each_chunk_once(spark, tmp_path):
    """Scores so large that sums in another order differ in the ninth place: a chunk that both passes find is one row."""
    pick = random.Random(5)
    texts = [" ".join(pick.choice(WORDS) for _ in range(pick.choice([10, 15, 20]))) for _ in range(300)]
    chunks = spark.createDataFrame([(i, t, "s", 1, "x") for i, t in enumerate(texts)], "id long, text string, source string, page int, disaster_type string")
    index = I.build_index(chunks, spark.createDataFrame([], "id long, embedding array<float>"))
    asked = [" ".join(w for w in pick.sample(WORDS, 12) for _ in range(pick.randint(90_000, 120_000))) for _ in range(4)]
    q = spark.createDataFrame([(i, t, None) for i, t in enumerate(asked)], "query_id long, text string, tag string")
    got = R.pruned_topk(q, R.build_blocks(index, str(tmp_path / "index")), str(tmp_path / "run"), 15).found.collect()
    assert len({(r.query_id, r.id) for r in got}) == len(got) == 60
    whole = S.bm25_topk(q, index, 15).collect()
    assert {(r.query_id, r.id) for r in got} == {(r.query_id, r.id) for r in whole}


def test_mean_of_many_terms(spark):
    """The mean over two million terms of one value in one task keeps its digits."""
    df = spark.range(2_000_000, numPartitions=1).select(F.col("id").cast("string").alias("term"), F.when(F.col("id") == 0, 600_000).otherwise(1).cast("long").alias("df"))
    idf = I.term_weights(df, spark.range(1).select(F.lit(1_000_000).alias("n"))).where("df > 1").first().idf
    raw = lambda d: math.log(1_000_000 - d + 0.5) - math.log(d + 0.5)
    want = 0.25 * (1_999_999 * raw(1) + raw(600_000)) / 2_000_000
    assert abs(idf - want) < 1e-14 * want


def test_rows_read_at_a_time(spark, tmp_path):
    """Row groups of blocks are bounded in bytes, as Spark's reader decodes up to 4,096 of their rows at once."""
    rows = spark.range(12_000, numPartitions=1).selectExpr("id", "concat_ws(' ', transform(sequence(1, 150), i -> concat('w', (id * 31 + i * i) % 9973))) AS text", "'s' AS source", "1 AS page", "'x' AS disaster_type")
    index = I.build_index(rows, spark.createDataFrame([], "id long, embedding array<float>"))
    R.build_blocks(index, str(tmp_path / "blocks"))
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "blocks").rglob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 3000 and max(g.num_rows for g in groups) < 1500
