"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has a logistic score from its words; the document's score is the noisy-or
of its sentences with a leak, 1 - (1 - leak) * prod(1 - p).  A sentence in which no word is a feature has p = 0, and the
leak takes up noise in the labels, so that length alone doesn't make a document toxic.  The weights are fitted to document
labels only, and the sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import giving_back, numbered, text_of

#: Lower-cases, makes sentence ends line feeds and all other ASCII but letters and digits spaces.
_TABLE = bytes(10 if chr(b) in ".!?\n" else b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def sentences(raw: bytes) -> list[bytes]:
    """Sentences of a UTF-8 text, of which some may be blank; each ends where one of .!? or a line feed stands."""
    return raw.translate(_TABLE).split(b"\n")


#: Lengths in bytes of the word beginnings that are features, so that inflected forms share evidence.
STEMS = (4, 5, 6, 7, 8)


def features(word: bytes) -> list[bytes]:
    """The word itself (closed by a line feed) and its beginnings."""
    return [word + b"\n", *(word[:k] for k in STEMS if k <= len(word))]


class WordScores(dict):
    """A word's share of the sentence score; emptied when it holds `most` words, none of over 100 bytes."""

    def __init__(self, weights: dict[bytes, float], most: int = 200_000) -> None:
        self.weights, self.most = weights, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        out = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(word) <= 100:
            self[word] = out
        return out


class Model:
    """Weights of features, bias and leak."""

    def __init__(self, weights: dict[bytes, float], bias: float, leak: float) -> None:
        self.weights, self.bias, self.leak = weights, bias, leak

    def scorer(self):
        """A function from a UTF-8 text to its score and to number and score of each sentence with evidence."""
        of, bias, leak = WordScores(self.weights).__getitem__, self.bias, self.leak

        def score(raw: bytes) -> tuple[float, list[tuple[int, float]]]:
            found, hidden = [], 0.0
            for k, sentence in enumerate(sentences(raw)):
                z = sum(map(of, sentence.split()))
                if z:
                    z = min(max(z + bias, -60.0), 60.0)
                    found.append((k, 1 / (1 + math.exp(-z))))
                    hidden += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
            return 1 - (1 - leak) * math.exp(-hidden), found

        return score


def screen(texts: list[bytes], y: np.ndarray, min_df: int, most: int) -> dict[bytes, int]:
    """The features that toxic documents have most significantly oftener than their share: binomial score over 4."""
    df, hits = Counter(), Counter()
    for text, toxic in zip(texts, y):
        own = {f for w in set(text.translate(_TABLE).split()) for f in features(w)}
        df.update(own)
        if toxic:
            hits.update(own)
    base = y.mean()
    z = {f: (n - df[f] * base) / math.sqrt(df[f] * base * (1 - base)) for f, n in hits.items() if n >= min_df} if base < 1 else {}
    return {f: i for i, f in enumerate(sorted((f for f, x in z.items() if x >= 4), key=lambda f: (-z[f], f))[:most])}


#: Toxic texts from which on the ridge has its full weight.
RIDGE_TEXTS = 300


def fit(texts: list[bytes], labels: np.ndarray, *, min_df: int = 3, steps: int = 300, rate: float = 0.1, ridge: float = 0.3, most_features: int = 2000) -> Model:
    """Full-batch Adam on the noisy-or likelihood with a ridge penalty.  Repeated texts count once.

    The ridge is for RIDGE_TEXTS toxic texts or more; fewer get it in proportion, as the same penalty against less evidence would
    keep all scores low.
    """
    kept = {t: bool(y) for t, y in zip(texts, labels)}
    texts, y = list(kept), np.array(list(kept.values()), bool)
    vocabulary = screen(texts, y, min_df, most_features) if y.any() else {}
    words, ends, bags = [], [], []
    for d, text in enumerate(texts):
        for s in sentences(text):
            ids = [i for w in s.split() for i in map(vocabulary.get, features(w)) if i is not None]
            if ids:
                words += ids
                ends.append(len(ids))
                bags.append(d)
    if not words:
        return Model({}, -12.0, min(0.4, float(y.mean()) if len(y) else 0.0))
    flat, bags = np.array(words, np.int32), np.array(bags)
    of = np.repeat(np.arange(len(ends), dtype=np.int32), ends)
    n, size = len(texts), len(vocabulary)
    ridge *= min(1.0, y.sum() / RIDGE_TEXTS)
    theta = np.zeros(size + 2)
    theta[size], theta[size + 1] = -6.0, -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        z = theta[size] + np.bincount(of, theta[flat], len(ends))
        leak = sigmoid(theta[size + 1])
        hidden = np.bincount(bags, np.logaddexp(0, z), n) - np.log1p(-leak)  # -log of P(clean)
        push = np.where(y, -1 / np.expm1(np.clip(hidden, 1e-9, 60)), 1.0)
        dz = push[bags] * sigmoid(z) / n
        g = np.concatenate([np.bincount(flat, dz[of], size) + ridge * theta[:size] / n, [dz.sum(), (push * leak).sum() / n]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[size] = min(theta[size], -5.0)
    return Model({f: float(theta[i]) for f, i in vocabulary.items() if abs(theta[i]) > 0.02}, float(theta[size]), min(0.4, float(sigmoid(theta[size + 1]))))


def is_held_out(id_col: str = "doc_id", every: int = 5, part: int = 0):
    """Whether crc32 of the id's digits leaves this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % every == part


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 12_000, max_bytes: int = 60_000_000, seed: int = 42, **how) -> Model:
    """Fits a model to labelled rows that are not held out: at most max_docs of them, the first in a seeded order, and max_bytes of text.

    A text that alone has more than max_bytes is never sent to the driver; the one that would exceed them ends the sample.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    marked = marked.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(marked), "_id").where(F.octet_length("_text") <= max_bytes)
    texts, ys, size = [], [], 0
    for r in rows.orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "_text").toLocalIterator():
        text = r["_text"].encode()
        size += len(text)
        if size > max_bytes:
            break
        texts.append(text)
        ys.append(r["_label"] > 0)
    return fit(texts, np.array(ys, bool), **how)


def _score(model: Model, threshold: float):
    spans = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores, where = [], []
            for text in batch.column(1):
                s, found = of(text.as_buffer().to_pybytes())
                scores.append(s)
                where.append([{"sentence": k, "score": float(p)} for k, p in found if p >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(where, spans)], names=["doc_id", "held_out", "score", "predicted", "offending"])

    return score


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", sentence_threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, offending (number and score of sentences above the threshold).

    Sentences are numbered as `sentences` splits the text.  Only the text decides; null counts as empty and gets the
    score of a text without sentences.  Null ids and repeated rows are scored like any others; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col).cast("binary"), is_held_out(id_col).alias("held_out"))
    return rows.mapInArrow(giving_back(_score(model, sentence_threshold)), "doc_id long, held_out boolean, score double, predicted int, offending array<struct<sentence: int, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Trains on the labelled documents that are not held out and scores all."""
    return score_toxicity(docs, train(docs, labels, **how))


def _pass_clean(model: Model, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of((t.as_py() or "").encode())[0] < threshold for t in batch.column(text_at)], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns; nothing is shuffled."""
    model = train(docs, labels, text_col=text_col, **how)
    plain = numbered(docs)
    return plain.mapInArrow(giving_back(_pass_clean(model, docs.columns.index(text_col), threshold)), plain.schema).toDF(*docs.columns)
