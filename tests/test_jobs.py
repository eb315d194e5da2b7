"""The jobs: runs over growing input, reruns, odd rows, the command line."""

import collections
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import refresh_chunks as R
from jobs.answer_questions import answer_questions, questions_of
from lodestone import constants as C

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, source string"


def body(seed, n=60):
    return " ".join(f"word{seed}x{i}" for i in range(n)) + "."


def add(spark, folder, rows, schema=DOCS):
    """One more file in the folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def published(spark, out):
    return sorted((r.batch, r.source, r.page, r.lang, r.text.split()[0]) for r in R.published_chunks(spark, out).collect())


def report(spark, out):
    return {(r.batch, r.source): (r.documents, r.pieces, r.short, r.repeated, r.published) for r in spark.read.schema(R.REPORT).parquet(f"{out}/report").collect()}


def test_only_what_is_new(spark, tmp_path):
    docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "checkpoint"))
    assert R.refresh_chunks(spark, docs, out, mark).count() == 0  # no files yet
    add(spark, docs, [(1, body(1), "en", "a"), (2, body(2), "fr", "a"), (3, body(1), "en", "a"), (4, body(1), "en", "b"), (5, "too short", "en", "b")])
    R.refresh_chunks(spark, docs, out, mark)
    first = [(0, "a", 1, "en", "word1x0"), (0, "a", 2, "fr", "word2x0"), (0, "b", 4, "en", "word1x0")]
    assert published(spark, out) == first
    assert report(spark, out) == {(0, "a"): (3, 3, 0, 1, 2), (0, "b"): (2, 2, 1, 0, 1)}
    files = sorted(os.listdir(f"{out}/chunks/batch=0/lang=en"))
    R.refresh_chunks(spark, docs, out, mark)  # nothing has come
    assert published(spark, out) == first and sorted(os.listdir(f"{out}/chunks/batch=0/lang=en")) == files
    add(spark, docs, [(0, body(2), "fr", "a"), (6, body(3), "en", "a"), (7, body(2), "fr", "b")])
    R.refresh_chunks(spark, docs, out, mark)
    assert published(spark, out) == [*first, (1, "a", 6, "en", "word3x0"), (1, "b", 7, "fr", "word2x0")]
    assert report(spark, out)[1, "a"] == (2, 2, 0, 1, 1) and report(spark, out)[1, "b"] == (1, 1, 0, 0, 1)
    assert sorted(os.listdir(f"{out}/chunks/batch=0/lang=en")) == files  # what was published stays as it is


def test_two_runs_give_what_one_gives(spark, tmp_path):
    """Where documents come in the order of their ids, the chunks don't depend on how they are cut into runs."""
    sf = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(sf)
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    outs = [str(tmp_path / n) for n in ("out1", "out2")]
    for low, high in ((0, 80), (80, 120), (120, 10**9)):
        docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).coalesce(1).write.mode("append").parquet(grown)
        R.refresh_chunks(spark, grown, outs[0], str(tmp_path / "mark1"))
    docs.write.parquet(whole)
    R.refresh_chunks(spark, whole, outs[1], str(tmp_path / "mark2"))
    rows = [collections.Counter(map(tuple, R.published_chunks(spark, o).drop("batch").collect())) for o in outs]
    assert rows[0] == rows[1] and sum(rows[0].values()) > 100
    assert R.published_chunks(spark, outs[0]).select("batch").distinct().count() == 3


def test_a_batch_may_be_run_again(spark, tmp_path):
    out = str(tmp_path / "out")
    frames = [spark.createDataFrame(rows, DOCS) for rows in ([(1, body(1), "en", "a"), (2, body(2), "de", "a")], [(3, body(1), "en", "a"), (4, body(4), "en", "a")])]
    for number, frame in enumerate(frames):
        R.publish(frame, number, out)
    before = published(spark, out), report(spark, out)
    R.publish(frames[1], 1, out)
    assert (published(spark, out), report(spark, out)) == before


def test_odd_documents(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(1, None, "en", "a", "x"), (2, "", "en", "a", "x"), (None, body(1), "en", "a", "x"), (3, body(2), None, "a", "x"), (4, body(3), "", None, "x"), (4, body(3), "", None, "x"), (5, body(5, 40_000), "en", "a", "x")]
    R.publish(spark.createDataFrame(rows, f"{DOCS}, piece_no string").withColumn("batch", F.lit("clash")), 0, out)
    got = R.published_chunks(spark, out).collect()
    assert collections.Counter((r.source, r.page, r.lang) for r in got if r.page != 5) == {("a", 3, None): 1, (None, 4, None): 1}
    long = {w for r in got if r.page == 5 for w in r.text.split()}
    assert long == set(body(5, 40_000)[:-1].split())
    assert {k: v[0] for k, v in report(spark, out).items()} == {(0, "a"): 5, (0, None): 2}
    with pytest.raises(ValueError, match="tag column"):
        R.refresh_chunks(spark, str(tmp_path), out, str(tmp_path / "mark"), tag="source")


TURNS = "conv_id long, turn long, role string, text string"


def test_answers_and_reruns(spark, tmp_path):
    docs, log, out = (str(tmp_path / n) for n in ("docs", "log", "out"))
    add(spark, docs, [(1, "Store water in clean bottles. Then label them.", "en", "a"), (2, "Do not drive through flood water. Turn around.", "en", "a"), (3, "Unrelated words about cats. Nothing else.", "en", "b"), (None, "water", "en", "b"), (4, None, "en", "b")])
    add(spark, log, [(1, 0, "user", "how do I store clean water"), (1, 1, "assistant", "store water"), (1, 2, "user", "zzz qqq"), (2, 0, "user", None), (2, 1, "user", "store bottles"), (2, 1, "user", "store bottles")], TURNS)
    first = answer_questions(spark, log, docs, out).collect()
    assert questions_of(spark.read.parquet(log)).count() == 3
    got = {(r.conv_id, r.turn): r for r in first}
    assert set(got) == {(1, 0), (1, 2), (2, 1)} and len(first) == 3
    assert got[1, 0].cited[0] == 2 and got[1, 0].answer.startswith("Do not drive through flood water. [1] Store water in clean bottles. [2]")  # warnings first
    assert got[1, 2].gated and got[1, 2].answer == C.LOW_CONFIDENCE_MESSAGE and got[1, 2].cited == [] and got[1, 2].confidence == "gated"
    assert got[2, 1].confidence == "high confidence" and got[2, 1].cited == [1]
    assert sorted(map(repr, answer_questions(spark, log, docs, out).collect())) == sorted(map(repr, first))
    add(spark, docs, [(9, "Zzz and qqq.", "en", "b")])
    again = {(r.conv_id, r.turn): r for r in answer_questions(spark, log, docs, out).collect()}
    assert not again[1, 2].gated and again[1, 2].cited == [9]
    summary = {r.confidence: r.questions for r in spark.read.json(f"{out}/summary").collect()}
    assert summary == dict(collections.Counter(r.confidence for r in again.values()))


@pytest.mark.parametrize("few", [0, 1000])
def test_not_published(spark, monkeypatch, few):
    """Both ways of finding published keys, with null sources, against sets."""
    monkeypatch.setattr(R, "BROADCAST_KEYS", few)
    new, old = [("a", "k1"), ("a", "k2"), (None, "k1"), (None, "k3"), ("b", "k1")], [("a", "k1"), (None, "k3"), ("c", "k2"), ("b", "k2")]
    got = R.not_published(*(spark.createDataFrame(x, "source string, key string") for x in (new, old))).collect()
    assert {tuple(r) for r in got} == set(new) - set(old)


def test_command_line(spark, tmp_path):
    docs = str(tmp_path / "docs")
    add(spark, docs, [(1, body(1), "en", "a")])
    for _ in range(2):
        run = [sys.executable, "-m", "jobs.refresh_chunks", "--config", "jobs/refresh_chunks.json", "--documents", docs, "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
        done = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=180)
        assert done.returncode == 0, done.stderr[-2000:]
    assert "no new files" in done.stderr
    assert published(spark, str(tmp_path / "out")) == [(0, "a", 1, "en", "word1x0")]
    wrong = tmp_path / "wrong.json"
    wrong.write_text('{"colour": 1}')
    from jobs.settings import configuration

    with pytest.raises(ValueError, match="colour"):
        configuration(spark, str(wrong), R.SETTINGS)


def test_first_batch_is_joined_with_nothing(spark):
    """Without published chunks there is no join; pieces with equal tokens have equal keys, and their numbers of tokens."""
    pieces = spark.createDataFrame([("s", "One, two!"), ("s", "one TWO"), ("s", ""), ("t", "three")], "source string, text string")
    rows = R.keyed(pieces)
    assert [r.n for r in rows.collect()] == [2, 2, 0, 1] and len({r.key for r in rows.collect()}) == 3
    assert R.not_published(rows, rows.where("false").select("source", "key")) is rows
    assert {r.text for r in R.not_published(rows, rows.where("n = 1").select("source", "key")).collect()} == {"One, two!", "one TWO", ""}
