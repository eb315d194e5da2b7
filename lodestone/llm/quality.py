"""Quality rules by distribution divergence from language references.

A document's histograms of character classes and of its language's most common words are compared with those of all
documents of the language by the Jensen-Shannon distance (base 2, from 0 to 1).  Thin references judge nothing.

Short documents: a number or address among few words outweighs the other classes, so symbols are told from all else only;
and the bound on words grows with the noise in few of them.

The distance of a text without common words depends on the language's share of them, so the bound on words is a part of
that distance.  Common words that a document of its length would have less than once share a bin: with a bin for each,
noise alone sets short documents of the language as far off as those of another.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, text_of, workspace

SPACE, LOWER, UPPER, DIGIT, STOP, MARK, SYMBOL, WIDE, REST = range(9)
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _byte_classes() -> np.ndarray:
    """The class of each byte; bytes that go on with a character have none (-1)."""
    out = np.full(256, REST)
    for cls, group in ((SPACE, b" \t\n\v\f\r"), (LOWER, bytes(range(97, 123))), (UPPER, bytes(range(65, 91))), (DIGIT, bytes(range(48, 58))), (STOP, b".,;:"), (MARK, b"!?\"'()-"), (SYMBOL, SYMBOLS)):
        out[list(group)] = cls
    out[192:] = WIDE
    out[128:192] = -1
    return out


BYTE_CLASS = _byte_classes()
#: Rows: bytes; columns: classes.
CLASS_OF = (BYTE_CLASS[:, None] == np.arange(9)).astype(np.int64)


def class_counts(raw: bytes) -> np.ndarray:
    """Characters of a UTF-8 text by class."""
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASS_OF


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts, not both empty."""
    p, q = (x / np.sum(x) for x in (p, q))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def symbols_alone(classes: np.ndarray) -> np.ndarray:
    """Counts of symbols and of all other characters but space."""
    return np.array([classes[SYMBOL], classes.sum() - classes[SPACE] - classes[SYMBOL]])


def words_distance(words: list, ref: dict) -> float:
    """The distance of lower-cased words from a reference, over its common words that are expected once or more, its other
    common words, words of punctuation alone, and all others."""
    index, n = ref["words"], ref["n"]
    most = len(index)
    hits = np.bincount([index.get(w, most + 1) for w in words], minlength=most + 2)
    bare = sum(not w.strip(PUNCTUATION) for w in words)
    hits[most:] = bare, hits[-1] - bare
    own = np.count_nonzero(n[:most] * len(words) >= n.sum())
    return distance(*([*x[:own], x[own:most].sum(), *x[most:]] for x in (hits, n)))


def repeated_words(words: list, width: int = 5) -> int:
    """Words in windows of `width` words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = reach = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _count(most: int):
    """Character classes (named by number) and lower-cased words of a task by language."""

    def rows(words: dict, classes: dict) -> pa.RecordBatch:
        flat = [(lang, "w" if w.strip(PUNCTUATION) else "p", w, n) for lang, c in words.items() for w, n in c.items()] + [(lang, "c", b"%d" % i, n) for lang, c in classes.items() for i, n in enumerate(c.tolist())]
        columns = list(zip(*flat)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64()))], names=["lang", "kind", "item", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict = {}
        classes: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                words.setdefault(lang, Counter()).update(raw.lower().split())
                classes[lang] = classes.get(lang, 0) + class_counts(raw)
            if sum(map(len, words.values())) > most:
                yield rows(words, classes)
                words, classes = {}, {}
        yield rows(words, classes)

    return count


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", common: int = 100, min_words: int = 0, hold_words: int = 400_000) -> dict:
    """By language (null is one) of min_words words or more: counts of the classes; the common words, commonest first; their
    counts, that of words of punctuation alone and that of all others; the distance of a text without common words.

    Counted over all documents, whose texts are read once; `common` words and nine classes for each such language reach
    the driver.
    """
    counted = docs.select(F.col(lang_col).cast("string"), text_of(text_col).cast("binary")).mapInArrow(_count(hold_words), "lang string, kind string, item binary, n long")
    sums = counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    sums = materialize(sums, workspace(docs.sparkSession, "quality") + "/sums")
    by_kind = sums.where("kind <> 'c'").groupBy("lang", "kind").agg(F.sum("n").alias("n"))
    spoken = by_kind.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= min_words).select(F.col("lang").alias("of"))
    known = F.col("lang").eqNullSafe(F.col("of"))
    ranked = sums.where("kind <> 'p'").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))).where(F.col("rank") <= max(common, 9))
    ranked = ranked.join(spoken, known, "left_semi")
    out: dict = {}
    for r in ranked.collect():
        ref = out.setdefault(r["lang"], {"classes": np.zeros(9, np.int64), "words": [], "n": []})
        if r["kind"] == "c":
            ref["classes"][int(bytes(r["item"]))] = r["n"]
        else:
            ref["words"].append((-r["n"], bytes(r["item"])))
    totals = {(r["lang"], r["kind"]): r["n"] for r in by_kind.join(spoken, known, "left_semi").collect()}
    for lang, ref in out.items():
        top = sorted(ref["words"])[:common]
        ref["words"] = {w: i for i, (_, w) in enumerate(top)}
        n = [-x for x, _ in top]
        bare, others = totals.get((lang, "p"), 0), totals.get((lang, "w"), 0) - sum(n)
        ref["n"] = np.array([*n, bare, others], float)
        ref["none"] = distance([0, 1], [sum(n) + bare, others]) if sum(n) + bare + others else 0.0
    return out


NAMES = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed class_distance word_distance kept".split()
TYPES = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]


def _judge(refs: dict, p: dict):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = list(SYMBOLS)
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                words = raw.split()
                by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                classes = by_byte @ CLASS_OF
                chars = int(classes.sum() - classes[SPACE])
                repeats = repeated_words(words)
                failed = len(words) < 10 or 100 * repeats > 20 * len(words)
                ref = refs.get(lang)
                of_class = of_word = None
                short = chars < p["min_chars"]
                if words and ref:
                    of_class = distance(*map(symbols_alone, (classes, ref["classes"]))) if short else distance(classes, ref["classes"])
                    of_word = words_distance(raw.lower().split(), ref)
                good = (of_class is None or of_class <= p["max_symbol_distance" if short else "max_class_distance"]) and (of_word is None or of_word <= (p["max_word_part"] + p["few_words"] / len(words)) * ref["none"])
                out.append((doc_id, len(words), chars, int(by_byte[symbols].sum()), repeated_lines(raw), repeats, failed, of_class, of_word, good and not failed))
            columns = list(zip(*out)) or [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], names=NAMES)

    return judge


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: int = 100,
    min_chars: int = 120,
    min_reference_words: int = 2000,
    max_class_distance: float = 0.3,
    max_symbol_distance: float = 0.2,
    max_word_part: float = 0.5,
    few_words: float = 8.0,
) -> DataFrame:
    """One row per input row: the base counts, base_failed, class_distance, word_distance (null: no words or no reference) and kept.

    kept: the base rules hold; class_distance is at most max_class_distance or, under min_chars characters, where it tells
    symbols from all else only, max_symbol_distance; and word_distance is at most max_word_part + few_words / words of the
    distance that a text without any common word of the language has.

    A null text counts as empty and fails the base rules.  Null languages form one language.  A language with fewer than
    min_reference_words words has no reference, and its documents are judged by the base rules alone.  Null ids and
    repeated rows are judged like any others; an empty table gives an empty result.  Other columns are not read.
    """
    refs = references(docs, text_col=text_col, lang_col=lang_col, common=common, min_words=max(1, min_reference_words))
    params = {"min_chars": min_chars, "max_class_distance": max_class_distance, "max_symbol_distance": max_symbol_distance, "max_word_part": max_word_part, "few_words": few_words}
    rows = docs.select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), text_of(text_col).cast("binary"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return rows.mapInArrow(_judge(refs, params), schema)
