"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are handed out in blocks of BLOCK words, whatever the size of the table.  Sources get whole blocks by the highest
quotients target / (2 k + 1); the blocks of a source go to its shards by the same rule, with the shards' words as votes.
What is left between a source's blocks and its target, a block or so, is settled inside one block of its largest shards.
A shard is a seeded share of the source's documents, small enough for one task; its documents stand in a seeded order and
are cut into blocks.  All blocks are taken equally often, but for a seeded selection of blocks that are taken once more,
the last of them in part.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, giving_back, materialize, text_of, workspace

#: Up to so many sources their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000

#: Words in a block; the last block of a shard may be shorter.
BLOCK = 4096


def capped_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight; one above most times its size stops there and its excess goes to the others by weight."""
    caps = [most * s for s in sizes]
    targets = [0.0] * len(sizes)
    free, rest = set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if weight <= 0 or rest * weights[i] / weight > caps[i]]
        if not over:
            for i in free:
                targets[i] = rest * weights[i] / weight
            break
        for i in over:
            targets[i] = caps[i]
            rest -= caps[i]
            free.discard(i)
    return targets


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), caps[i] at most; ties go to the lower index.

    A divisor found by bisection hands out all but a few seats at once, and a heap the others.  The divisor used is a
    little larger, so that seats of equal quotients, which rounding could tell apart there, are all left to the heap.
    """
    votes = np.asarray(votes, float)
    caps = np.where(votes > 0, np.asarray(caps, np.int64), 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    low, high = 0.0, 2 * votes.max() + 1  # given(high) is 0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if given(middle).sum() > seats else (low, middle)
    out = given(high * (1 + 1e-9))
    heap = [(-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def shard_words(votes: np.ndarray, seats: int, words: int, most: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each shard by Sainte-Laguë, and its words: those blocks, and what is left of the source's words.

    The rest, positive or negative, goes to the largest shards first; none gets under 0 or over most times its words.
    """
    votes = np.asarray(votes, np.int64)
    blocks = sainte_lague(votes, seats, most * votes // block)
    out = blocks * block
    rest = words - int(out.sum())
    for i in np.lexsort((np.arange(len(votes)), -votes)):
        if not rest:
            break
        change = int(np.clip(rest, -out[i], most * votes[i] - out[i]))
        out[i] += change
        rest -= change
    return blocks, out


def block_order(words: int, block: int, seed: list[int]) -> np.ndarray:
    """The numbers of a shard's blocks in the order of their seeded selection."""
    return np.random.default_rng(seed).permutation(-(-words // block))


TAKEN = "row long, taken long, copies long, spans array<struct<begin: long, end: long>>"


def _select(seed: int, block: int):
    """The words that the mix takes from each document of a shard: whole copies, and ranges of words taken once more."""

    def select(key, rows, quota):
        rows = rows.sort_by([("deal", "ascending"), ("doc_id", "ascending"), ("tie", "ascending"), ("copy", "ascending"), ("size", "ascending")])
        sizes = rows["size"].to_numpy()
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = int(sizes.sum())
        copies, extra = divmod(quota["quota"][0].as_py(), words) if words else (0, 0)
        runs: list[list[int]] = []
        if extra:
            order = block_order(words, block, [seed, key[0].as_py(), key[1].as_py()])
            length = np.minimum((order + 1) * block, words) - order * block
            taken_to = np.cumsum(length)
            n = int(np.searchsorted(taken_to, extra)) + 1
            length[n - 1] -= taken_to[n - 1] - extra
            for b, size in sorted(zip(order[:n].tolist(), length[:n].tolist())):
                if runs and runs[-1][1] == b * block:
                    runs[-1][1] += size
                else:
                    runs.append([b * block, b * block + size])
        taken = copies * sizes
        spans: list[list[dict[str, int]]] = [[] for _ in range(len(sizes))]
        for a, b in runs:
            for i in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))):
                begin, end = max(a - int(starts[i]), 0), min(b, int(ends[i])) - int(starts[i])
                if end > begin:
                    spans[i].append({"begin": begin, "end": end})
                    taken[i] += end - begin
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table({"row": rows["row"], "taken": pa.array(taken, pa.int64()), "copies": pa.array([copies] * len(sizes), pa.int64()), "spans": pa.array(spans, kind)})

    return select


def with_copy_numbers(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tie, row, ...) with copy: 0, 1, 2, ... among rows of equal doc_id and tie.

    Numbers run on from task to task (the upper bits of row), so that no window holds more of a key than one task read.
    """
    rows = rows.withColumn("part", F.shiftright("row", 33))
    counts = rows.groupBy("doc_id", "tie", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc_id", "tie").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "tie", "part").orderBy("row")) - 1)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")) & (F.col("part") == F.col("_part"))
    return ranked.join(offsets, same).withColumn("copy", F.col("copy") + F.col("_before")).drop("part", "_id", "_tie", "_part", "_before")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2,
    seed: int = 42,
    block: int = BLOCK,
    shard_docs: int = 4096,
) -> DataFrame:
    """One row per input row: doc_id, tie (xxhash64 of the text), source, size, source_size, target, taken, copies, spans.

    taken words are `copies` times the whole document and the words of the spans (from begin to before end) once more.
    size counts words (null text: none).  Sources in the order of their code points, null last, get the weights in turn.
    Together they get share times all words, and each at most `most` times its own (a whole number); so no document is
    taken more often.  Equal rows are dealt to shards each on its own.  Null ids sort first.  Sources without words get
    a target of 0; an empty table gives an empty result.  Reruns on equal rows agree.  A source smaller than a block has
    one block, which is taken in part.
    """
    spark = docs.sparkSession
    at = workspace(spark, "mixing")
    text = text_of(text_col)
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    sizes = materialize(with_copy_numbers(materialize(sizes, f"{at}/sizes")), f"{at}/numbered")

    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()  # a row per source, like the weights
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [r["size"] for r in found]
    words = sum(totals)
    targets = capped_targets(totals, [weights[i % len(weights)] for i in range(len(found))], share * words, most)
    seats = sainte_lague(np.array(targets), round(sum(targets) / block), np.full(len(found), np.iinfo(np.int64).max // (len(found) + 1)))
    plan = spark.createDataFrame(
        [(r["source"], i, r["size"], float(targets[i]), max(1, -(-r["docs"] // shard_docs)), int(seats[i])) for i, r in enumerate(found)],
        "source string, source_no long, source_size long, target double, shards long, seats long",
    )
    if len(found) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    placed = sizes.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumns(
        {"shard": F.pmod(F.xxhash64("doc_id", "tie", "copy", F.lit(seed)), F.col("shards")), "deal": F.xxhash64("doc_id", "tie", "copy", F.lit(seed + 1))}
    )

    times = int(most)

    def quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        words = round(float(shards["target"].iloc[0]))
        blocks, quota = shard_words(shards["words"].to_numpy(), int(shards["seats"].iloc[0]), words, times, block)
        return shards.assign(blocks=blocks, quota=quota)[["source_no", "shard", "blocks", "quota"]]

    of_shards = (
        placed.groupBy("source_no", "shard")
        .agg(F.sum("size").alias("words"), F.first("seats").alias("seats"), F.first("target").alias("target"))
        .groupBy("source_no")
        .applyInPandas(quotas, "source_no long, shard long, blocks long, quota long")
    )
    rows = placed.select("source_no", "shard", "row", "doc_id", "tie", "copy", "deal", "size")
    taken = rows.groupBy("source_no", "shard").cogroup(of_shards.groupBy("source_no", "shard")).applyInArrow(_select(seed, block), TAKEN)
    return placed.select("row", "doc_id", "tie", "source", "size", "source_size", "target").join(taken, "row").drop("row")


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _write_out(text_at: int, chars_at: int | None):
    """Repeats each row as often as the mix takes it whole, and adds a row for each range of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, sizes, copies, spans = batch.columns
            picks: list[int] = []
            texts: dict[int, str] = {}
            for i, (size, n, own) in enumerate(zip(sizes.to_pylist(), copies.to_pylist(), spans.to_pylist())):
                picks += [i] * n
                for span in own:
                    if span["end"] - span["begin"] < size:
                        raw = columns[text_at][i].as_py().encode()
                        at = [m.span() for m in _WORDS.finditer(raw)]
                        texts[len(picks)] = raw[at[span["begin"]][0] : at[span["end"] - 1][1]].decode()
                    picks.append(i)
            out = [c.take(pa.array(picks, pa.int64())) for c in columns]
            if texts:
                for k, of in ((text_at, lambda t: t), (chars_at, len)):
                    if k is not None:
                        values = out[k].to_pylist()
                        for j, text in texts.items():
                            values[j] = of(text)
                        out[k] = pa.array(values, columns[k].type)
            yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])

    return giving_back(run)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **how) -> DataFrame:
    """The mix itself, with the columns of docs: whole documents as often as taken, and the ranges of words of the few that are taken in part.

    The count in chars_col, if there is such a column, follows the text.
    """
    mix = mix_sources(docs, id_col=id_col, text_col=text_col, **how)
    same = lambda a, b: Window.partitionBy(a, b).orderBy(F.lit(0))  # noqa: E731  equal rows are interchangeable
    mix = mix.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "size", "copies", "spans").withColumn("_no", F.row_number().over(same("_id", "_tie")))
    mix = mix.where((F.col("copies") > 0) | (F.size("spans") > 0))
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs[id_col].cast("long").alias("_own_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_own_tie"))
    plain = plain.withColumn("_own_no", F.row_number().over(same("_own_id", "_own_tie")))
    joined = plain.join(mix, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_tie") == F.col("_tie")) & (F.col("_own_no") == F.col("_no")))
    joined = joined.select(*[f"c{i}" for i in range(len(docs.columns))], "size", "copies", "spans")
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    out = joined.mapInArrow(_write_out(docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None), schema)
    return out.toDF(*docs.columns)
