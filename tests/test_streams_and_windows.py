"""Streams in pieces, windows of tokenizer ids, sketches of lengths."""

import json
import random
import types

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.operators import chunking as K
from lodestone.operators import evaluation as E
from lodestone.operators import generation as G
from lodestone.streaming.frames import EVENTS, Assembly, _assemble, assembled_events, event_of

draw = random.Random(17)


def body(n):
    lines = [": note"]
    for i in range(n):
        event = draw.choice([{"type": "meta", "gated": False, "top_score": i / 4}, {"type": "token", "text": draw.choice(["é𝄞", 'say "x"', "", "a\nb"])}, {"type": "done"}])
        lines += ["data: " + json.dumps(event, ensure_ascii=draw.random() < 0.5), ""]
    return "\n".join(lines) + draw.choice(["\n", "", '\ndata: {"type": "tok'])


def cut(data):
    """Pieces of random sizes, some of them empty."""
    out, at = [], 0
    while at < len(data):
        n = draw.choice([0, 1, 2, 5, 40])
        out.append(data[at : at + n])
        at += n
    return out


def test_assembly_in_any_order():
    for _ in range(60):
        whole = body(draw.randint(0, 8)).encode()
        pieces = list(enumerate(cut(whole)))
        want = [(i, *e) for i, e in enumerate(map(event_of, whole.split(b"\n")[:-1])) if e is not None]
        draw.shuffle(pieces)
        stream, got = Assembly(), []
        for k in range(0, len(pieces), 3):
            got += stream.take(pieces[k : k + 3] + pieces[:1])  # one of them again and again
        assert got == want and not stream.waiting


def test_odd_lines():
    assert event_of(b"data: oops") == event_of(b"data: [1]") == event_of(b"data: null") == (None, None, None, None)
    assert event_of(b'data: {"type": 5, "text": null, "gated": "no", "top_score": true}') == (None, None, None, None)
    assert event_of(b"data") is event_of(b": x") is event_of(b"") is None


def test_events_are_one_block():
    """A stream's frame has objects only, as columns of several kinds cost most of the time that a stream takes."""
    whole = b'data: {"type": "meta", "gated": true, "top_score": 0.5}\n: x\ndata: {"type": "done"}\n'
    pieces = pd.DataFrame({"seq": [0, 1], "piece": [whole[:9], whole[9:]]})
    (frame,) = _assemble(None)((7,), iter([pieces]), types.SimpleNamespace(hasTimedOut=False, exists=False, update=lambda _: None))
    assert frame.values.tolist() == [[7, 0, "meta", None, True, 0.5], [7, 2, "done", None, None, None]]
    assert set(frame.dtypes) == {pd.Series([None], dtype=object).dtype} and list(frame) == [f.split()[0] for f in EVENTS.split(", ")]


def test_stream_with_restarts(spark, tmp_path):
    """The events of a stream in pieces, over three runs of the query, are those of the whole bodies."""
    bodies = [(i, body(draw.randint(0, 6))) for i in range(25)]
    pieces = [(i, n, p, "clash") for i, b in bodies for n, p in enumerate(cut(b.encode()))]
    draw.shuffle(pieces)
    pieces += [(None, 0, b"data: x\n", ""), (1, None, b"data: x\n", ""), (2, 0, None, "")] + pieces[:20]
    schema = "stream_id long, seq long, piece binary, type string"
    for k in range(3):
        spark.createDataFrame(pieces[k::3], schema).write.mode("append").parquet(str(tmp_path / "in"))
        events = assembled_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema(EVENTS).parquet(str(tmp_path / "out")).collect()
    want = G.parse_sse(spark.createDataFrame(bodies, "stream_id long, body string")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 30


@pytest.mark.parametrize("size, overlap", [(300, 30), (7, 3), (5, 0)])
def test_tokenizer_windows(spark, size, overlap):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    texts = [None, "", "  ", "one", "Straße, ÉTÉ 𝄞 日本語 <|endoftext|> " * 9, "word " * 1500, *(" ".join(draw.choices("alpha beta, gamma. déjà-vu 12345 http://x.y".split(), k=draw.randint(1, 900))) for _ in range(12))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", K.tokenizer_windows(path, size, overlap)(F.col("text")).alias("w")).collect()
    for r in rows:
        text = texts[r.id]
        offsets = encode(text, add_special_tokens=False).offsets if text and "<|" not in text else None
        if offsets is None:
            assert bool(r.w) == bool(text and text.strip())
            continue
        want, at = [], 0
        while offsets:
            part = offsets[at : at + size]
            want.append((part[0][0], part[-1][1], len(part)))
            if at + size >= len(offsets):
                break
            at += size - overlap
        assert [(w.start, w.end, w.n) for w in r.w] == want and all(w.text == text[w.start : w.end] for w in r.w)


def test_sketches(spark):
    rows = [(f"s{i % 3}", " ".join(["w"] * (i * 37 % 500))) for i in range(3000)] + [("none", None), ("one", "a b")]
    sketches = E.length_sketches(spark.createDataFrame(rows, "source string, text string").withColumn("n", F.lit("clash")))
    lengths = {}
    for source, text in rows:
        lengths.setdefault(source, []).append(len((text or "").split()))
    found = {r.source: r for r in E.sketched_quartiles(sketches).collect()}
    merged = E.sketched_quartiles(E.merged_sketches(sketches)).first()
    assert found["none"].median == 0 and found["one"].q3 == 2 and merged.n == len(rows)
    for r, values in [(r, lengths[s]) for s, r in found.items()] + [(merged, sum(lengths.values(), []))]:
        assert r.n == len(values)
        for q, share in ((r.q1, 0.25), (r.median, 0.5), (r.q3, 0.75)):
            below, upto = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
            assert below <= share + E.RANK_ERROR and upto >= share - E.RANK_ERROR
    assert E.length_sketches(spark.createDataFrame([], "source string, text string")).count() == 0
