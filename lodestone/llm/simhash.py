"""Near-duplicates by SimHash fingerprints and BK-trees.

Equal fingerprints collapse first.  Two fingerprints that differ in at most `radius` bits agree on some set of whole
blocks of bits; each such set deals every fingerprint to one shard, and one BK-tree per shard finds its links.  In a tree
the children of a node are keyed by their integer Hamming distance to it, and a search follows only the edges within the
radius of its own distance.  Trees of a task are built and searched together, level by level, in numpy.  A subtree whose
nodes are all known to be linked with the searching fingerprint is not searched again, so a dense group costs no square.

The tree of a shard that fits into a task is searched by the shard's fingerprints in that task.  A larger shard gets
several trees of a bounded size; these are broadcast in rounds, and all the shard's fingerprints search them from all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import HEAVY, giving_back, join_skewed, materialize, numbered, shuffle_partitions, text_of, workspace
from lodestone.llm.components import connected_components


def fingerprint(raw: bytes, width: int = 4, seed: int = 42, chunk: int = 1 << 15) -> int:
    """The fingerprint of a UTF-8 text."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(spans), chunk):
        hashes = b"".join([digest(joined[s:e], seed) for s, e in spans[i : i + chunk]])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(spans)).tobytes(), "big")


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes(), width, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.int64())], names=["doc_id", *batch.schema.names[2:], "fp"])

    return run


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node each of n nodes is linked to."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            return root
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class Forest:
    """BK-trees, one for each tree number, over fingerprints that are distinct in each; rows are in order of tree.

    group is the lowest row that each row is known to be linked to inside its tree; mixed tells whether a node's subtree
    has several groups.
    """

    def __init__(self, tree: np.ndarray, fp: np.ndarray, radius: int) -> None:
        n = len(fp)
        new = np.concatenate([[True], tree[1:] != tree[:-1]])[:n]
        self.fp, self.radius = fp, radius
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.parent, self.edge, level = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.flatnonzero(~new)
        at = self.root[rows]
        depth = 0
        while len(rows):  # all rows that don't yet have a place go down one level
            depth += 1
            d = np.bitwise_count(fp[rows] ^ fp[at]).astype(np.int64)
            near = d <= radius
            self.links.append((rows[near], at[near]))
            order = np.lexsort((rows, d, at))
            rows, at, d = rows[order], at[order], d[order]
            first = np.concatenate([[True], (at[1:] != at[:-1]) | (d[1:] != d[:-1])])
            child = rows[first]
            self.parent[child], self.edge[child], level[child] = at[first], d[first], depth
            at = child[np.cumsum(first) - 1]
            rows, at = rows[~first], at[~first]
        self._settle(self.linked())
        self._mark(level, depth)

    def linked(self) -> np.ndarray:
        a, b = (np.concatenate([*(x[i] for x in self.links), []]).astype(np.int64) for i in (0, 1))
        return components_of(len(self.fp), a, b)

    def _settle(self, group: np.ndarray) -> None:
        """Takes groups, and sorts the nodes by parent and edge."""
        self.group = group
        kids = np.flatnonzero(self.parent >= 0)
        key = self.parent[kids] * 128 + self.edge[kids]
        order = np.argsort(key, kind="stable")
        self.kids, self.key = kids[order], key[order]

    def _mark(self, level: np.ndarray, depth: int) -> None:
        self.mixed = np.zeros(len(self.fp), bool)
        by_level = np.argsort(-level, kind="stable")
        begin = 0
        for end in np.searchsorted(-level[by_level], -np.arange(depth, 0, -1), "right"):
            c = by_level[begin:end]
            p = self.parent[c]
            self.mixed[p[self.mixed[c] | (self.group[c] != self.group[p])]] = True
            begin = end

    def _down(self, node: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of each node whose edges are within the radius of d, and for each the index of its parent's entry."""
        low = np.searchsorted(self.key, node * 128 + np.maximum(d - self.radius, 0))
        n_kids = np.searchsorted(self.key, node * 128 + d + self.radius, "right") - low
        offset = np.arange(n_kids.sum()) - np.repeat(np.cumsum(n_kids) - n_kids, n_kids)
        return self.kids[np.repeat(low, n_kids) + offset], np.repeat(np.arange(len(node)), n_kids)

    def components(self, pairs: int = 4_000_000) -> np.ndarray:
        """The lowest row that each row is linked to inside its tree, after every row has searched its own tree."""
        if not len(self.fp):
            return self.group
        big = np.flatnonzero(self.mixed[self.root])
        chunk = max(32, min(4096, pairs // int(np.bincount(self.root).max())))  # fingerprints that search at once
        for i in range(0, len(big), chunk):
            q = big[i : i + chunk]
            node = self.root[q]
            while len(q):
                todo = self.mixed[node] | (self.group[node] != self.group[q])
                q, node = q[todo], node[todo]
                d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
                near = d <= self.radius
                self.links.append((q[near], node[near]))
                node, of = self._down(node, d)
                q = q[of]
        return self.linked()

    def search(self, fp: np.ndarray, root: np.ndarray, pairs: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
        """For fingerprints that enter at these roots: the index of each and a group that it is linked to, for every such group.

        A subtree of one group is not searched further once the fingerprint is linked to that group.
        """
        n = len(self.fp)
        which, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        chunk = max(32, min(4096, pairs // max(1, n)))
        for i in range(0, len(fp), chunk):
            q, node = np.arange(min(chunk, len(fp) - i)), root[i : i + chunk]
            linked = np.zeros((len(q), n), bool)
            while len(q):
                todo = self.mixed[node] | ~linked[q, self.group[node]]
                q, node = q[todo], node[todo]
                d = np.bitwise_count(fp[i + q] ^ self.fp[node]).astype(np.int64)
                near = d <= self.radius
                linked[q[near], self.group[node[near]]] = True
                node, of = self._down(node, d)
                q = q[of]
            own, group = np.nonzero(linked)
            which.append(i + own)
            groups.append(group)
        return np.concatenate(which), np.concatenate(groups)

    @classmethod
    def rebuilt(cls, fp: np.ndarray, root: np.ndarray, parent: np.ndarray, edge: np.ndarray, group: np.ndarray, mixed: np.ndarray, radius: int) -> Forest:
        """A forest from its columns."""
        out = cls.__new__(cls)
        out.fp, out.radius, out.root, out.parent, out.edge, out.mixed, out.links = fp, radius, root, parent, edge, mixed, []
        out._settle(group)
        return out


def forest_components(shard: np.ndarray, fp: np.ndarray, radius: int, pairs: int = 4_000_000) -> np.ndarray:
    """For fingerprints (distinct in each shard) the lowest row each is linked to inside its shard; rows are in order of shard."""
    return Forest(shard, fp, radius).components(pairs)


def _links(radius: int):
    """Links each fingerprint of a task's shards with the first that it is connected to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not parts:
            return
        shard, fp = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((fp, shard))
        shard, fp = shard[order], fp[order]
        shared = np.concatenate([[False], shard[1:] == shard[:-1]])
        shared |= np.concatenate([shared[1:], [False]])
        shard, fp = shard[shared], fp[shared]
        if not len(fp):
            return
        first = forest_components(shard, fp.view(np.uint64), radius)
        own = first != np.arange(len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[first[own]])], names=["a", "b"])

    return run


TREE = "tree long, shard long, node long, fp long, parent long, edge long, grp long, mixed boolean"


def _grow(radius: int):
    """A tree of a piece of a large shard, as rows; groups are complete inside it."""

    def grow(rows: pa.Table) -> pa.Table:
        fp = np.unique(rows["fp"].to_numpy())
        forest = Forest(np.zeros(len(fp), np.int64), fp.view(np.uint64), radius)
        group = forest.components()
        forest.group = group
        level = np.zeros(len(fp), np.int64)
        at = forest.parent.copy()
        while (at >= 0).any():
            level[at >= 0] += 1
            at = np.where(at >= 0, forest.parent[at], -1)
        forest._mark(level, int(level.max()))
        same = lambda name: pa.array(np.full(len(fp), rows[name][0].as_py()))
        columns = [same("tree"), same("shard"), *(pa.array(x) for x in (np.arange(len(fp)), fp, forest.parent, forest.edge, group, forest.mixed))]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in TREE.split(", ")])

    return grow


def _search(held):
    """Links fingerprints (shard, tree, fp) with the groups of all broadcast trees of their shard but their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_shard, columns, radius = held.value
        forest = Forest.rebuilt(*columns, radius)
        for batch in batches:
            shard, tree, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            picks, roots = [], []
            for i, (s, t) in enumerate(zip(shard.tolist(), tree.tolist())):
                for number, root in of_shard.get(s, ()):
                    if number != t:
                        picks.append(i)
                        roots.append(root)
            own = fp[np.array(picks, np.int64)]
            q, group = forest.search(own.view(np.uint64), np.array(roots, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(forest.fp[group].view(np.int64))], names=["a", "b"])

    return run


def broadcast_links(large: DataFrame, folder: str, radius: int, most: int, round_most: int) -> DataFrame:
    """Links of shards with over `most` fingerprints (shard, fp, n: how many it has) by trees that are broadcast in rounds.

    A shard is cut by a hash into pieces of about `most`; a task makes the tree of each piece, and the trees are written.
    Each round broadcasts trees of at most round_most fingerprints together, and a single larger one, and all fingerprints of
    their shards search them, dealt over all tasks.  The number of rounds grows with the fingerprints in large shards only.
    """
    spark = large.sparkSession
    pieces = F.ceil(F.col("n") / most)
    dealt = large.withColumn("tree", F.xxhash64("shard", F.pmod(F.xxhash64("fp", F.lit(7)), pieces))).select("shard", "tree", "fp")
    dealt = materialize(dealt, f"{folder}/large")
    trees = materialize(dealt.groupBy("tree").applyInArrow(_grow(radius), TREE), f"{folder}/trees")
    grown = trees.alias("t").join(trees.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("fp").alias("b")), (F.col("tree") == F.col("_t")) & (F.col("grp") == F.col("_n")))
    out = materialize(grown.where("node <> grp").select(F.col("fp").alias("a"), "b"), f"{folder}/links-own")
    sizes = [(r["tree"], r["n"]) for r in trees.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").collect()]  # a row per tree
    rounds: list[list[int]] = []
    size = round_most
    for tree, n in sizes:
        if size + n > round_most:
            rounds.append([])
            size = 0
        rounds[-1].append(tree)
        size += n
    for k, numbers in enumerate(rounds):
        rows = trees.where(F.col("tree").isin(numbers)).orderBy("tree", "node").toArrow()
        tree, shard, node, fp, parent, edge, group, mixed = (rows.column(i).to_numpy() for i in range(8))
        root = np.arange(len(fp)) - node
        of_shard: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(node == 0).tolist():
            of_shard.setdefault(int(shard[i]), []).append((int(tree[i]), i))
        held = spark.sparkContext.broadcast((of_shard, (fp.view(np.uint64), root, np.where(parent >= 0, parent + root, -1), edge, group + root, mixed), radius))
        asked = dealt.where(F.col("shard").isin(list(of_shard))).repartition(max(shuffle_partitions(spark), sum(n for _, n in sizes) // 200_000))
        out = out.unionByName(materialize(asked.mapInArrow(_search(held), "a long, b long").distinct(), f"{folder}/links-{k}"))
        held.unpersist()
    return out


def block_masks(blocks: int, agreeing: int) -> list[int]:
    """For each choice of `agreeing` of the 64 bits' `blocks` parts, a mask of their bits (signed)."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(part[i] for i in c) for c in combinations(range(blocks), agreeing)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shards(fingerprints: DataFrame, n: int, radius: int, aim: int = 512, extra: int | None = None) -> DataFrame:
    """shard and fp: all sets of blocks on which fingerprints within the radius may agree.

    Blocks are added (or `extra` of them given) until random fingerprints would leave at most `aim` in a shard.  A shard's
    number is a hash of set and bits; should two shards share it, they are searched as one.
    """
    if extra is None:
        extra = 1
        while n >> (64 * extra // (radius + extra)) > aim and extra < 4:
            extra += 1
    masks = block_masks(radius + extra, extra)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return fingerprints.select(F.explode(keys).alias("shard"), "fp")


def near_links(prints: DataFrame, n: int, folder: str, radius: int, *, extra: int | None = None, shard_most: int = 200_000, round_most: int = 1_000_000) -> DataFrame:
    """Links (a, b) between n distinct fingerprints (fp), enough to connect all within the radius of each other."""
    spark = prints.sparkSession
    dealt = shards(prints.select("fp"), n, radius, extra=extra)
    large = None
    if n > shard_most:  # else no shard can have more
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_most)
        sizes = materialize(sizes, f"{folder}/large-shards")
        count = sizes.count()
        if count:
            if count <= HEAVY:
                sizes = F.broadcast(sizes)
            large = dealt.join(sizes, "shard")
            dealt = dealt.join(sizes.select("shard"), "shard", "left_anti")
    tasks = max(shuffle_partitions(spark), n // 200_000)
    links = dealt.repartition(tasks, "shard").mapInArrow(giving_back(_links(radius)), "a long, b long")
    return links if large is None else links.unionByName(broadcast_links(large, folder, radius, shard_most, round_most))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4, **how) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Texts are lower-cased in A-Z; a text of fewer than `width` words is one shingle; null and wordless texts have
    fingerprint zero and are linked like any other.  Null ids are no component_id unless a component has no others.
    Repeated rows share a component; an empty table gives an empty result.  Other columns are not read.
    """
    out = _found(docs, [], id_col, text_col, width, seed, radius, **how)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _found(docs: DataFrame, keys: list[Column], id_col: str, text_col: str, width: int, seed: int, radius: int, **how) -> DataFrame:
    """One row per input row: doc_id, the keys (named columns of type long), fp, root (a fingerprint, one for each component) and component_id."""
    spark = docs.sparkSession
    at = workspace(spark, "simhash")
    texts = docs.select(F.col(id_col).cast("long"), text_of(text_col).cast("binary"), *keys)
    kept = "".join(f"{c} long, " for c in texts.columns[2:])
    rows = materialize(texts.mapInArrow(giving_back(_fingerprints(width, seed)), f"doc_id long, {kept}fp long"), f"{at}/rows")
    total = rows.count()
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), f"{at}/prints")
    n = prints.count()

    links = near_links(prints, n, at, radius, **how)
    roots = connected_components(links, f"{at}/components")

    linked = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "id", "n", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    of_print = materialize(join_skewed(linked, least, ["root"], "members", n).select("fp", "n", "root", "component_id"), f"{at}/found")
    return join_skewed(rows, of_print, ["fp"], "n", total)


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """Of each component the row with the smallest id, with all its columns.  Rows without id stay.

    Rows are known by id and text: of rows with one id and different texts each counts for its own component, and where
    both have its smallest id, the one with the smaller text hash stays.  Rows equal in id and text stay or go together.
    """
    key = F.xxhash64(text_of(text_col))
    found = _found(docs, [key.alias("key")], id_col, text_col, width, seed, radius).select("doc_id", "key", "root", "component_id")
    found = materialize(found, workspace(docs.sparkSession, "near"))
    least = found.where("doc_id = component_id")
    doubled = least.groupBy("root").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    drop = found.where("doc_id <> component_id").select("doc_id", "key").unionByName(least.join(doubled, "root").where("key <> first").select("doc_id", "key"))
    own_id, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    same = (own_id.cast("long") == F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_key"))
    return numbered(docs).join(drop.distinct().toDF("_id", "_key"), same, "left_anti").toDF(*docs.columns)
