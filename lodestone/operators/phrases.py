"""Which phrases stand in which texts: one pass over the texts with an automaton of all phrases.

Phrases are taken in blocks of a bounded size, each of which is sent to all tasks and built into an automaton there; texts stay where
they are.  The time for a text doesn't depend on the number of phrases in a block, only on its length and what is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of phrases in a block.
PHRASE_CHARS = 4_000_000


def automaton(phrases: Iterable[tuple[int, str]]) -> ahocorasick.Automaton:
    """An automaton whose values are the length and the numbers of a phrase; equal phrases share one."""
    numbers: dict[str, list[int]] = {}
    for number, phrase in phrases:
        numbers.setdefault(phrase, []).append(number)
    out = ahocorasick.Automaton()
    for phrase, own in numbers.items():
        out.add_word(phrase, (len(phrase), own))
    out.make_automaton()
    return out


def counts(found: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """How often each phrase stands in a text, from the left without overlap with itself."""
    out: dict[int, int] = {}
    ends: dict[int, int] = {}  # past the last occurrence that counted
    for end, (size, numbers) in found.iter(text):
        for number in numbers:
            if end - size + 1 >= ends.get(number, 0):
                ends[number] = end + 1
                out[number] = out.get(number, 0) + 1
    return out


def _blocks(phrases: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """(phrase_id, phrase) in blocks of at most `most` characters, or of one phrase; only one block is at the driver at a time."""
    held, size = [], 0
    for r in phrases.where((F.col("phrase") != "") & F.col("phrase_id").isNotNull()).select(F.col("phrase_id").cast("long"), "phrase").toLocalIterator():
        if held and size + len(r[1]) > most:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def find_phrases(texts: DataFrame, phrases: DataFrame, *, id_col: str = "id", text_col: str = "text", phrase_chars: int = PHRASE_CHARS) -> DataFrame:
    """id, phrase_id, n: the phrases (phrase_id, phrase) that a text has, and how often from the left without overlap.

    Letters are compared as they are.  Null texts, null and empty phrases and phrases without id are found nowhere; rows of texts
    that repeat are searched each for itself; equal phrases are found each under its own id.
    """
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)

    def search(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = automaton(block)
            for batch in batches:
                ids, found, times = [], [], []
                for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = counts(built, text)
                    ids += [one] * len(own)
                    found += own
                    times += own.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(times, pa.int64())], names=["id", "phrase_id", "n"])

        return run

    kind = "id long, phrase_id long, n long"
    out = None
    for block in _blocks(phrases, phrase_chars):
        part = rows.mapInArrow(search(block), kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else texts.sparkSession.createDataFrame([], kind)


def phrase_totals(words: tuple[str, ...]):
    """A function of a text column: how often any of a few phrases stands in it, each counted by itself; null for null."""
    numbered = list(enumerate(words))

    @F.arrow_udf("bigint")
    def totals(texts: pa.Array) -> pa.Array:
        built = automaton(numbered)
        return pa.array([None if t is None else sum(counts(built, t).values()) for t in texts.to_pylist()], pa.int64())

    return totals
