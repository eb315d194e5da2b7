"""Words dealt by page: the number of tasks follows the number of words."""

import pytest

from lodestone.catalog import derived
from lodestone.operators import layout as P

WORDS = "page int, text string, x0 double, x1 double, top double, page_left double, page_right double"


@pytest.fixture
def words(spark):
    """60 pages of 40 words: even ones in two columns, odd ones in one; and a page of one word without a number."""
    rows = [(p, f"w{i:02}", left, left + 80.0, float(i % 20 * 12), 0.0, 600.0) for p in range(60) for i in range(40) for left in [40.0 + (300.0 if p % 2 == 0 and i >= 20 else 0.0)]]
    return spark.createDataFrame([*rows, (None, "lost", 40.0, 120.0, 0.0, 0.0, 600.0)], WORDS)


def test_tasks_follow_words(monkeypatch, words):
    monkeypatch.setattr(P, "TASK_WORDS", 100, raising=False)
    for df in (P.page_texts(words, ["page"]), P.lines_of_words(words, ["page"]), P.column_ranges(words, ["page"])):
        assert df.rdd.getNumPartitions() >= 24


def test_page_texts(words):
    got = {r.page: r.text for r in P.page_texts(words, ["page"]).collect()}
    column = lambda a, b: "\n".join(f"w{i:02}" for i in range(a, b))
    assert got == {None: "lost"} | {p: column(0, 20) + "\n\n" + column(20, 40) if p % 2 == 0 else "\n".join(f"w{i:02} w{i + 20}" for i in range(20)) for p in range(60)}


def test_numbers_of_pages(spark, tmp_path):
    """Page numbers beyond an INT are whole numbers of more bits; where all fit, they are an INT."""
    text = " ".join(f"w{i:03}" for i in range(401))
    for name, ids, kind in (("low", (7, 2_144_900), "int"), ("last", (2_147_483,), "int"), ("high", (7, 2_147_484, 3_076_919), "bigint"), ("negative", (-2_147_484,), "bigint")):
        spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        for f in (derived.pdf_lines, derived.pdf_columns, derived.page_texts):
            got = f(spark, str(tmp_path / name))
            assert dict(got.dtypes)["page"] == kind
            last = 0 if f is derived.pdf_columns else 1  # a word alone is no column
            assert {r.page for r in got.collect()} == {i * 1000 + n for i in ids for n in range(last + 1)}
        lines = [r for r in derived.pdf_lines(spark, str(tmp_path / name)).collect() if r.page % 1000 == 1]
        assert [(r.line_no, r.line) for r in lines] == [(0, "w400")] * len(ids)
