"""Exact deduplication with an extendible-hash index on shared files.

1. A narrow table of (id, key, digest, bytes) is written to the shared folder; texts are not kept there.
2. The driver grows a directory over the leading bits of the key: it doubles whenever an overfull bucket is as deep as
   the directory, and the bucket splits.  Only a histogram with a few slots per bucket reaches the driver.
3. Map tasks collapse equal texts and deal one row for each to the owner of its key range; consecutive buckets form a range.
4. An owner inserts what it gets, sorted by key, into pages of its own extendible-hash table.  Entries of one key form a
   chain, which compares whole texts byte by byte; once its key has passed, an entry keeps the text's digest alone.  The
   pages are written to the shared folder.
5. Rows look up their entry by key and digest.  Entries with very many rows are broadcast, as their number is bounded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import giving_back, join_skewed, materialize, numbered, shuffle_partitions, text_of, workspace

#: Bytes that an entry of an owner's table takes besides its text; every row is weighed with them.
ENTRY = 500


class ExtendibleHash:
    """Pages of at most `capacity` keys, found by the key's low bits; entries with the same key form a chain.

    An overfull page splits by one more bit; if it is as deep as the directory, the directory doubles first.  A page
    whose keys agree in all `max_depth` bits is left overfull.
    """

    def __init__(self, capacity: int = 256, max_depth: int = 20) -> None:
        self.capacity, self.max_depth, self.depth = capacity, max_depth, 0
        self.directory: list[dict] = [{}]
        self.depths: dict[int, int] = {id(self.directory[0]): 0}

    def chain(self, key: int) -> list:
        """The chain of a key, which is created if need be."""
        page = self.directory[key & ((1 << self.depth) - 1)]
        found = page.get(key)
        if found is None:
            found = page[key] = []
            while len(page) > self.capacity and self._split(page, key):
                page = self.directory[key & ((1 << self.depth) - 1)]
        return found

    def _split(self, page: dict, key: int) -> bool:
        local = self.depths[id(page)]
        if local >= self.max_depth:
            return False
        if local == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit = 1 << local
        other = {k: page.pop(k) for k in list(page) if k & bit}
        self.depths[id(page)] = self.depths[id(other)] = local + 1
        for slot in range((key & (bit - 1)) | bit, len(self.directory), bit << 1):
            self.directory[slot] = other
        return True

    def pages(self) -> list[dict]:
        return list({id(p): p for p in self.directory}.values())


def grow_directory(load: np.ndarray, capacity: float) -> np.ndarray:
    """Bucket numbers (in key order) by slot of the leading bits, given the load of each slot.

    Starts as one bucket; a bucket over capacity splits by one more leading bit as long as slots tell its keys apart.
    """
    bits = int(math.log2(len(load)))
    total = np.concatenate([[0], np.cumsum(load)])
    depth, directory = 0, [(0, 0)]  # for each entry its bucket: prefix, local depth
    grown = True
    while grown:
        grown = False
        for prefix, local in dict.fromkeys(directory):
            width = 1 << (bits - local)
            if local == bits or total[(prefix + 1) * width] - total[prefix * width] <= capacity:
                continue
            if local == depth:
                directory = [b for b in directory for _ in (0, 1)]
                depth += 1
            span = 1 << (depth - local)
            directory[prefix * span : (prefix + 1) * span] = [(2 * prefix + i, local + 1) for i in (0, 1) for _ in range(span // 2)]
            grown = True
    number = {b: i for i, b in enumerate(dict.fromkeys(directory))}
    return np.repeat(np.array([number[b] for b in directory], np.int32), 1 << (bits - depth))


def _above(a, b) -> bool:
    """Whether id a is above b; null is below all."""
    return a is not None and (b is None or a > b)


def _merge(entry: list, top, at_top: int, n: int) -> None:
    """entry: text, largest id, rows with that id, rows."""
    if _above(top, entry[1]):
        entry[1], entry[2] = top, at_top
    elif top == entry[1]:
        entry[2] += at_top
    entry[3] += n


def _dealer(owners: np.ndarray, bits: int, hold_bytes: int):
    """Collapses equal texts of a task, holding at most about hold_bytes of texts, and names each row's owner."""
    schema = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("text", pa.binary()), ("top", pa.int64()), ("at_top", pa.int64()), ("n", pa.int64())])

    def flush(held: dict[int, list[list]]) -> pa.RecordBatch:
        flat = [(k, *e) for k, chain in held.items() for e in chain]
        keys = np.array([x[0] for x in flat], np.int64)
        slots = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        columns = [pa.array(owners[slots], pa.int32()), pa.array(keys)] + [pa.array([x[i] for x in flat], schema.field(i + 1).type) for i in (1, 2, 3, 4)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list]] = {}
        size = 0
        for batch in batches:
            for top, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_buffer().to_pybytes()
                chain = held.setdefault(key, [])
                for entry in chain:
                    if entry[0] == text:
                        _merge(entry, top, 1, 1)
                        break
                else:
                    chain.append([text, top, 1, 1])
                    size += len(text) + 200
                if size > hold_bytes:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return deal


def _owner(page_capacity: int):
    """Inserts what a task owns into its pages and returns one row for each entry.  Rows come in order of their key."""

    def seal(chain: list) -> None:
        """Texts give way to digests."""
        for entry in chain:
            entry[0] = hashlib.sha256(entry[0]).digest()
        if len({e[0] for e in chain}) < len(chain):
            raise ValueError("two different texts share key and SHA-256")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ExtendibleHash(page_capacity)
        at, chain = None, []
        for batch in batches:
            _, keys, texts, tops, counts, ns = batch.columns
            for key, text, top, at_top, n in zip(keys.to_pylist(), texts, tops.to_pylist(), counts.to_pylist(), ns.to_pylist()):
                if key != at:
                    seal(chain)
                    at, chain = key, index.chain(key)
                text = text.as_buffer().to_pybytes()
                for entry in chain:
                    if entry[0] == text:
                        _merge(entry, top, at_top, n)
                        break
                else:
                    chain.append([text, top, at_top, n])
        seal(chain)
        names = ["page", "key", "chain_no", "digest", "keep_id", "keep_rows", "group_size"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for number, page in enumerate(index.pages()):
            columns = list(zip(*[(number, key, i, *e) for key, chain in page.items() for i, e in enumerate(chain)]))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return own


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20, owner_bytes: int = 1 << 30, page_capacity: int = 256, hold_bytes: int = 32 << 20, key_bits: int = 64
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, page, chain_no.

    Texts are equal if their bytes are; null counts as empty.  Of equal texts the row with the largest id stays.  A null id
    is below all others.  Of several rows with the winning id and text exactly one is kept.  An empty table gives an empty result.
    Other columns of docs are not read.  key_bits below 64 makes keys collide and is for tests.
    """
    spark = docs.sparkSession
    at = workspace(spark, "exact-dedup")
    text = text_of(text_col)
    key = F.xxhash64(text)
    if key_bits < 64:
        key = F.shiftleft(key, 64 - key_bits)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))
    keys = rows.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("digest"), (F.octet_length("text") + ENTRY).alias("bytes"), F.monotonically_increasing_id().alias("row_no"))
    keys = materialize(keys, f"{at}/keys")

    total, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    owners_n = max(shuffle_partitions(spark), math.ceil(size / owner_bytes))
    capacity = max(1, min(bucket_bytes, size / (4 * owners_n)))  # so that ranges of buckets come out even
    bits = min(20, max(6, math.ceil(math.log2(max(1, size / capacity))) + 3))
    slots = keys.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slot")).agg(F.sum("bytes").alias("bytes")).toPandas()
    load = np.zeros(1 << bits)
    load[slots["slot"].to_numpy(np.int64)] = slots["bytes"]
    buckets = grow_directory(load, capacity)
    per_bucket = np.bincount(buckets, load)
    begin = np.concatenate([[0], np.cumsum(per_bucket)[:-1]])
    owner_of = np.minimum(owners_n - 1, (begin * owners_n / max(1, size)).astype(np.int64))

    dealt = rows.mapInArrow(giving_back(_dealer(owner_of[buckets].astype(np.int32), bits, hold_bytes)), "owner int, key long, text binary, top long, at_top long, n long")
    entries = dealt.repartitionById(owners_n, "owner").sortWithinPartitions("key").mapInArrow(giving_back(_owner(page_capacity)), "page int, key long, chain_no int, digest binary, keep_id long, keep_rows long, group_size long")
    index = materialize(entries, f"{at}/index")

    out = join_skewed(keys, index, ["key", "digest"], "group_size", total)
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if index.where("keep_rows > 1").isEmpty():
        out = out.withColumn("kept", wins)
    else:  # several rows with one id and text: the first of them stays
        tied = wins & (F.col("keep_rows") > 1)
        first = F.row_number().over(Window.partitionBy("key", "digest").orderBy("row_no")) == 1
        out = out.where(~tied).withColumn("kept", wins).unionByName(out.where(tied).withColumn("kept", first))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "page", "chain_no")


def distinct_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns.  Of rows with one id and text one stays."""
    spark = docs.sparkSession
    found = exact_dedup(docs, id_col=id_col, text_col=text_col, **how).select("doc_id", "keep_id", "kept", "text_sha256")
    found = materialize(found, workspace(spark, "exact-dedup") + "/found")
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    plain = numbered(docs)
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    digest = F.sha2(F.coalesce(own_text, F.lit("")), 256)

    def only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
        return rows.join(ids, F.col(own_id).cast("long").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), how)

    stay = only(plain, found.where("kept"), "left_semi")
    again = found.where(wins & ~F.col("kept")).select("doc_id", "text_sha256").distinct()
    if again.isEmpty():
        return stay.toDF(*docs.columns)
    one = only(plain, again, "left_semi").withColumn("_text", F.coalesce(own_text, F.lit(""))).dropDuplicates([own_id, "_text"]).drop("_text")
    return only(stay, again, "left_anti").unionByName(one).toDF(*docs.columns)
