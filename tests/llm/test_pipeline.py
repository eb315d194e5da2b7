"""The pipeline's stages against brute force, one after the other."""

import collections
import random

import corpus_pipeline as P
from lodestone.llm.simhash import components_of, fingerprint
from lodestone.llm.toxicity import train

import numpy as np

rng = random.Random(3)


def test_stages(spark, tmp_path):
    vocabulary = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(" ".join(rng.choices(vocabulary, k=9)) + "." for _ in range(15))
        toxic = i % 5 == 0
        if toxic:
            text = text.replace(".", " you grobnik.", 2)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s9", rows[i][4]) for i in range(1, 40)]  # exact copies
    rows += [(2000 + i, rows[i][1] + " end", "en", "s9", rows[i][4] + 4) for i in range(1, 240, 6)]  # near copies
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)

    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "packing"]
    clean = P.toxicity(spark, docs, sf).collect()
    score = train(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    assert {r.doc_id for r in clean} == {r[0] for r in rows if score((r[1] or "").encode())[0] < 0.5}
    assert {r.doc_id for r in clean} == {r[0] for r in rows if "grobnik" not in (r[1] or "")}

    clean_docs = spark.createDataFrame(clean, docs.schema)
    last = {}
    for r in clean:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    one = P.exact_dedup(spark, clean_docs, sf).collect()
    assert sorted(r.doc_id for r in one) == sorted(last.values())

    near = P.near_dedup(spark, spark.createDataFrame(one, docs.schema), sf).collect()
    fps = np.array([fingerprint((r.text or "").encode()) for r in one], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    groups = collections.defaultdict(list)
    for r, c in zip(one, components_of(len(fps), a, b)):
        groups[c].append(r.doc_id)
    assert sorted(r.doc_id for r in near) == sorted(map(min, groups.values()))
    assert len(near) < len(one)

    mixed = P.mixing(spark, spark.createDataFrame(near, docs.schema), sf)
    assert mixed.columns == docs.columns
    total = sum(len((r.text or "").split()) for r in near)
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * total) <= 5
    texts = {r.doc_id: r.text or "" for r in near}
    assert all((r.text or "") in texts[r.doc_id] for r in mixed.collect())

    pieces = P.packing(spark, mixed, sf).collect()
    assert sum(p.length for p in pieces) > 0 and {p.doc_id for p in pieces} == {r.doc_id for r in mixed.collect()}
    assert max(collections.Counter(p.sequence_id for p in pieces).values()) >= 1

    assert P.run(spark, sf).count() == len(pieces)
    empty = docs.where("false")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
