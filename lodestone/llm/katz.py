"""A language model of n-grams with Katz backoff, trained and evaluated on distributed tables.

    P(w | h) = d(c(h, w)) c(h, w) / c(h)            if the n-gram was seen in training
             = alpha(h) P(w | h')                   otherwise; h' is h without its first word
    P(w)     = d(c(w)) c(w) / N, or the left-over mass for a word that was not seen

The recursion goes from the highest order (three by default) down to single words.  d are Good-Turing discounts of each
order (Katz, counts up to 5), and alpha makes each P(. | h) sum to one over the vocabulary, the end and the unknown word:
with S the words seen after h, alpha(h) = (1 - sum over S of P(w | h)) / (1 - sum over S of P(w | h')).  As a word seen after
h was seen after h' as well, the second sum follows from whole numbers: the counts of (h', w) above 5 added up, and how many
are 1, ..., 5.

Texts are read once, into blocks of some million tokens: local word numbers and the documents' lengths.  Tables are dealt
to owners by a hash of their key: words, and for each order the n-grams by their contexts.  For an order, blocks send each
distinct n-gram whose context was seen once, with its count and that of (h', w), to the owner, and get the answer for just
those back; so no owner's input grows with the number of times that an n-gram occurs in a block, and no table is broadcast.
Contexts that are too frequent for one owner are split among several by their followers; their sums are added up and joined
with the blocks that have them.  A block sends an owner one row for an order, so there are never more rows than n-grams.

Blocks stay where they are: they are written in buckets by their number, and only answers are shuffled to them.  Words are
known by 64-bit hashes until owners number them; two words with one hash would count as one.

What a task holds for a block is places in it, of four bytes, and counts; word numbers are looked up for some n-grams at a time, and the
owners' sums become two numbers for a context as they are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.batches import give_back
from lodestone.llm.common import giving_back, materialize, shuffle_partitions, text_of, workspace

K = 5  # counts up to K are discounted
START = np.uint64((1 << 64) - 1)  # the number of the context before the first token
END = b" "  # no word has a space
PIECE = 1 << 18  # n-grams whose word numbers or probabilities are worked out at a time
_press, _expand = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """Kind, and the compressed byte planes."""
    a = np.ascontiguousarray(a)
    return a.dtype.char.encode() + _press.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(_expand.decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold the largest."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r up to K (d[0] is unused) from the numbers n[r] of items with count r, r up to K + 1.

    Where Good-Turing with Katz's correction leaves (0, 1), as with few or odd counts, the absolute discount
    n1 / (n1 + 2 n2) stands in, or one half if nothing has count 1.
    """
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] > 0 else 1.0
    spare = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else 0.5
    for r in range(1, K + 1):
        good = n[r] > 0 and common < 1
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if good else 0.0
        d[r] = ratio if 0 < ratio < 1 else 1 - 0.9 * min(spare, 1.0) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.where(c <= K, c, 0).astype(np.int64)]


class Unigrams:
    """P(w) from the tokens N, the numbers n[r] of words with count r, and nothing else."""

    def __init__(self, tokens: int, n: np.ndarray) -> None:
        self.tokens, self.d = tokens, discounts(n)
        r = np.arange(1, K + 1)
        left = float(((1 - self.d[1:]) * r * n[1 : K + 1]).sum())
        self.total, self.left = (tokens, left) if left > 0 else (tokens + 1, 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(float)
        return np.where(c > 0, discounted(c, self.d), self.left) / self.total


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


BLOCK = "block long, tokens long, words binary, body binary, lengths binary, ids binary, known binary, train binary"


def _blocks(block_tokens: int):
    """Blocks of whole documents: word hashes by local number, and the tokens of each document (the end comes last)."""
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
            known = np.array([i is not None for i in ids], bool)
            row = [first, sum(lengths), pack(hashes), pack(np.concatenate(parts)), pack(narrow(np.array(lengths, np.uint64))), pack(np.array([i or 0 for i in ids], np.int64)), pack(known), pack(np.array(train, bool))]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        numbers = _Numbers()
        parts, lengths, ids, train, first, size = [], [], [], [], 0, 0
        for batch in batches:
            for doc_id, text, row, learn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.as_buffer().to_pybytes().lower().split()
                words.append(END)
                first = first if parts else row
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                lengths.append(len(words))
                ids.append(doc_id)
                train.append(learn)
                size += len(words)
                if size >= block_tokens:
                    yield out()
                    numbers = _Numbers()
                    parts, lengths, ids, train, size = [], [], [], [], 0
        if parts:
            yield out()

    return giving_back(run)


PARTS = 6
DEALT = "owner int, block long, " + ", ".join(f"p{i} binary" for i in range(PARTS))
ANSWER = "kind string, block long, owner int, sums array<long>, " + ", ".join(f"p{i} binary" for i in range(PARTS))


def _rows(rows: list[tuple], head: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """A batch from head values and up to PARTS packed arrays."""
    columns = list(zip(*[(*r, *[None] * (len(head) + PARTS - len(r))) for r in rows])) or [[]] * (len(head) + PARTS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [t for _, t in head] + [pa.binary()] * PARTS)], names=[n for n, _ in head] + [f"p{i}" for i in range(PARTS)])


DEAL_HEAD = [("owner", pa.int32()), ("block", pa.int64())]
ANSWER_HEAD = [("kind", pa.string()), ("block", pa.int64()), ("owner", pa.int32()), ("sums", pa.list_(pa.int64()))]


def _slices(owner: np.ndarray, owners: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by owner, and owner, begin and end of each part of it."""
    order = np.argsort(owner.astype(np.uint16) if owners <= 1 << 16 else owner, kind="stable")
    who, begin = np.unique(owner[order], return_index=True)
    return order, list(zip(who.tolist(), begin.tolist(), [*begin[1:].tolist(), len(owner)]))


def _places(n: int) -> type:
    """The type of numbers below n."""
    return np.int32 if n < 1 << 31 else np.int64


def _pieces(n: int) -> Iterator[slice]:
    return (slice(i, i + PIECE) for i in range(0, n, PIECE))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the rank of its value, and for each value, in order, the place of one such key."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(keys)]
    del ranked
    kind = _places(len(keys))
    rank = np.empty(len(keys), kind)
    rank[order] = np.cumsum(new, dtype=kind) - kind(1)
    return rank, order[new].astype(kind)


def joint(columns: list[np.ndarray]) -> np.ndarray:
    """One key for each row of columns of word numbers, in the order of the rows; START comes last."""
    if len(columns) == 1:
        return columns[0]
    bits = 64 // len(columns)
    last = np.uint64((1 << bits) - 1)
    if all(int(np.where(c == START, 0, c).max(initial=0)) < int(last) for c in columns):
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out << np.uint64(bits)) | np.where(c == START, last, c)
        return out
    rank = distinct(columns[0])[0]
    for c in columns[1:]:
        own, at = distinct(c)
        rank = distinct(rank.astype(np.int64) * len(at) + own)[0]
    return rank.astype(np.uint64)


def beside(columns: list[np.ndarray]) -> np.ndarray:
    """Columns one after the other, in few bytes; START becomes one more than the largest number."""
    flat = np.concatenate([c.astype(np.uint64) for c in columns])
    start = flat == START
    most = np.where(start, 0, flat).max(initial=0)
    return narrow(np.concatenate([[most + np.uint64(1)], np.where(start, most + np.uint64(1), flat)]).astype(np.uint64))


def apart(flat: np.ndarray, width: int) -> list[np.ndarray]:
    """The columns from `beside`."""
    flat = flat.astype(np.uint64)
    start, rest = flat[0], flat[1:]
    return list(np.where(rest == start, START, rest).reshape(width, -1))


def _deal_words(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hashes, body = unpack(r["words"]), unpack(r["body"])
                learn = np.repeat(unpack(r["train"]), unpack(r["lengths"]).astype(np.int64))
                n = np.bincount(body[learn], minlength=len(hashes))
                order, parts = _slices((hashes % np.uint64(owners)).astype(np.int32), owners)
                yield _rows([(o, r["block"], pack(hashes[order[i:j]]), pack(narrow(n[order[i:j]]))) for o, i, j in parts], DEAL_HEAD)

    return giving_back(run)


def _own_words(owners: int):
    """Counts and numbers words: the unigram table, its statistics, and an answer for each block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                dealt.setdefault(r["owner"], []).append((r["block"], unpack(r["p0"]), unpack(r["p1"])))
        for owner, parts in dealt.items():
            hashes, at = np.unique(np.concatenate([h for _, h, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, _, c in parts]), len(hashes)).astype(np.uint64)
            rank = np.empty(len(n), np.uint64)
            rank[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(n), dtype=np.uint64)
            number = rank * np.uint64(owners) + np.uint64(owner)
            rows = [("unigrams", None, owner, None, pack(narrow(number)), pack(hashes), pack(narrow(n))), ("stats", None, owner, [*_count_counts(n), int((n > 0).sum()), int(n.sum())])]
            for (block, h, _), (i, j) in zip(parts, _bounds([len(h) for _, h, _ in parts])):
                rows.append(("words", block, owner, None, pack(narrow(number[at[i:j]])), pack(narrow(n[at[i:j]]))))
            yield _rows(rows, ANSWER_HEAD)

    return giving_back(run)


def _count_counts(n: np.ndarray) -> list[int]:
    return [int((n == r).sum()) for r in range(1, K + 2)]


def _bounds(sizes: list[int]) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends))


class _Level:
    """The distinct n-grams of one order in a block, by context and then word, both in the order of their numbers."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, word: np.ndarray, lower: np.ndarray, n: np.ndarray) -> None:
        """gram: the n-gram that ends at each token, or -1; context, word, lower: of each n-gram the index of its first words and
        of its last words among those of the order below, and its last word; n: its count in all training texts."""
        self.gram, self.context, self.word, self.lower, self.n = gram, context, word, lower, n


class _Block:
    """A block with the answers for its words and, so far as they are there, for its n-grams."""

    def __init__(self, block: dict, told: list[dict], owners: int, tokens: int, documents: int) -> None:
        self.lengths = unpack(block["lengths"]).astype(np.int64)
        self.train = unpack(block["train"])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.owners, self.tokens = owners, tokens
        answers = sorted((r["owner"], r["p0"], r["p1"]) for r in told if r["kind"] == "words")
        order = np.argsort((unpack(block["words"]) % np.uint64(owners)).astype(np.int32), kind="stable")
        size = len(order)
        number, n = (np.concatenate([unpack(r[k]).astype(np.uint64) for r in answers]) for k in (1, 2))
        place = np.argsort(number)  # words in the order of their numbers
        self.kind = _places(max(size, int(self.lengths.sum())) + 1)
        rank = np.empty(size, self.kind)
        rank[order[place]] = np.arange(size)
        body = rank[unpack(block["body"])]
        self.number = np.append(number[place], START)  # of each word; the last one is the context of first tokens
        self.counts = np.uint32 if max(tokens, documents) < 1 << 32 else np.uint64
        none = np.zeros(size, self.kind)
        words = _Level(body, none, np.arange(size, dtype=self.kind), none, np.append(n[place], np.uint64(documents)).astype(self.counts))
        self.size, self.levels, self.sums = size, [words], []

    def numbers(self, order: int, which: np.ndarray) -> list[np.ndarray]:
        """The columns of the word numbers of some n-grams of this order."""
        out = []
        for level in reversed(self.levels[1:order]):
            out.append(self.number[level.word[which]])
            which = level.context[which]
        return [self.number[which], *reversed(out)]

    def grow(self) -> _Level:
        """Adds the next order."""
        below, size = self.levels[-1], self.size
        first = len(self.levels) == 1
        body = self.levels[0].gram
        context = np.empty(len(body), self.kind)
        context[1:], context[self.first] = below.gram[:-1], size if first else -1
        there = np.flatnonzero(context >= 0).astype(self.kind)
        key = context[there].astype(np.int64)
        key *= size
        key += body[there]
        rank, at = distinct(key)
        del key
        gram = np.full(len(body), -1, self.kind)
        gram[there] = rank
        at = there[at]
        self.levels.append(_Level(gram, context[at], body[at], below.gram[at], np.zeros(len(at), self.counts)))
        return self.levels[-1]

    def dealt(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The highest order's n-grams whose context was seen, by owner, context and word; the owners of their parts."""
        level, below = self.levels[-1], self.levels[-2]
        which = np.flatnonzero(below.n[level.context] > 0).astype(self.kind)
        owner = np.empty(len(which), np.int32)
        for s in _pieces(len(which)):
            some = which[s]
            numbers = self.numbers(len(self.levels), some)
            with np.errstate(over="ignore"):
                mixed = (numbers[-1] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % splits(below.n[level.context[some]], self.owners, self.tokens)
                for c in numbers[:-1]:
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + c
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            owner[s] = (mixed >> np.uint64(32)) % np.uint64(self.owners)
        order, parts = _slices(owner, self.owners)
        return which[order], parts

    def learn(self, told: list[dict], discount: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Takes the owners' answers for the highest order; with the discounts of the order below and of this one it keeps, of contexts
        whose weight is needed, what is left for words not seen there, and what the order below gives to those that were."""
        level, below = self.levels[-1], self.levels[-2]
        rows = {r["owner"]: r for r in told if r["kind"] == "grams"}
        which, parts = self.dealt()
        plain = np.zeros(len(below.n), bool)
        at, left, mass = [np.zeros(0, self.kind)], [np.zeros(0)], [np.zeros(0)]
        for o, i, j in parts:
            r, g = rows[o], which[i:j]
            n = unpack(r["p0"])
            level.n[g] = n
            if discount is None:
                continue
            contexts, begin = _runs(level.context[g])
            plain[contexts] = np.unpackbits(unpack(r["p1"]), count=len(contexts)).astype(bool)
            at.append(contexts[np.logical_or.reduceat(n == 0, begin)])
            for kept, more in zip((left, mass), _left_and_mass(unpack(r["p2"]).reshape(SUMS, -1).T, *discount)):
                kept.append(more)
        if discount is None:
            return
        del which, parts
        context, left, mass = np.concatenate(at), np.concatenate(left), np.concatenate(mass)
        split = np.concatenate([np.zeros(0, int), *(s.start + np.flatnonzero(splits(below.n[s], self.owners, self.tokens) > 1) for s in _pieces(len(below.n)))])
        whole = {r["p0"]: r["sums"] for r in told if r["kind"] == "shared"}
        names = self.numbers(len(self.levels) - 1, split)
        shared = [(c, whole[key]) for i, c in enumerate(split.tolist()) if (key := _key(names, i)) in whole]
        if shared:
            own = [c for c, _ in shared]
            keep = ~np.isin(context, own)
            more = _left_and_mass(np.array([x for _, x in shared], np.int64), *discount)
            context, left, mass = np.concatenate([context[keep], np.array(own, self.kind)]), np.concatenate([left[keep], more[0]]), np.concatenate([mass[keep], more[1]])
            for c, x in shared:
                plain[c] = not any(x[1 + K :])
        self.sums.append((plain, context, left, mass))


SUMS = 1 + 2 * K  # the counts of (h', w) over K added up, how many are 1 to K, how many counts of (h, w) are 1 to K


def _left_and_mass(sums: np.ndarray, lower: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From contexts' sums and the discounts of the order below and of this one: what the context leaves to words not seen after it,
    and the discounted counts that the order below has of those seen."""
    r = np.arange(1, K + 1)
    left = (sums[:, 1 + K :] * (1 - own[1:]) * r).sum(1)
    # a context without discounted followers leaves one occurrence to others
    return np.where(left > 0, left, 1.0), sums[:, 0] + (sums[:, 1 : 1 + K] * lower[1:] * r).sum(1)


def _key(numbers: list[np.ndarray], i: int) -> bytes:
    """A context's word numbers as bytes."""
    return b"".join(int(c[i]).to_bytes(8, "little") for c in numbers)


def _runs(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of runs, and where each begins."""
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(context)])
    return context[begin], begin


def splits(n: np.ndarray, owners: int, tokens: int) -> np.ndarray:
    """Among how many owners a context with this count is split: one for each quarter of an owner's share of all tokens."""
    return (np.uint64(1) + n.astype(np.uint64) * np.uint64(4 * owners) // np.uint64(max(1, tokens))).astype(np.uint64)


def _blocks_with_answers(owners: int, tokens: int, documents: int, orders: int, d: list[np.ndarray] | None = None):
    """Blocks from rows of a block and its answers, whose kinds end with the order; d has the discounts of all orders, if weights are needed."""

    def of(blocks: pa.Table, answers: pa.Table) -> Iterator[tuple[dict, _Block]]:
        told: dict[int, list[dict]] = {}
        for r in answers.to_pylist():
            kind, order = r["kind"].rsplit("-", 1)
            told.setdefault(int(order), []).append(r | {"kind": kind})
        for r in blocks.to_pylist():
            b = _Block(r, told[1], owners, tokens, documents)
            for order in range(2, orders + 1):
                b.grow()
                b.learn(told.get(order, []), (d[order - 2], d[order - 1]) if d else None)
            yield r, b

    return of


def _deal(owners: int, tokens: int, documents: int, order: int):
    """Deals the n-grams of this order, given the answers for those below."""
    known = _blocks_with_answers(owners, tokens, documents, order - 1)

    def run(key, blocks, answers):
        rows = []
        for r, b in known(blocks, answers):
            level, below = b.grow(), b.levels[-2]
            count = narrow(np.bincount(level.gram[np.repeat(b.train, b.lengths) & (level.gram >= 0)], minlength=len(level.n)))
            which, parts = b.dealt()
            for o, i, j in parts:
                g = which[i:j]
                contexts, begin = _runs(level.context[g])
                runs = np.diff(np.append(begin, len(g)))
                rows.append((o, r["block"], pack(beside(b.numbers(order - 1, contexts))), pack(narrow(runs)), pack(narrow(below.n[contexts])), pack(narrow(b.number[level.word[g]])), pack(narrow(count[g])), pack(narrow(below.n[level.lower[g]]))))
        out = pa.Table.from_batches([_rows(rows, DEAL_HEAD)])
        rows = r = b = level = below = count = which = parts = g = contexts = None  # before memory is given back
        give_back()
        return out

    return run


def _own(order: int, owners: int, tokens: int):
    """Counts the n-grams of an order: their table, its statistics, sums of split contexts, and an answer for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                dealt.setdefault(r["owner"], []).append((r["block"], apart(unpack(r["p0"]), order - 1), *(unpack(r[f"p{i}"]) for i in range(1, PARTS))))
        for owner in list(dealt):
            parts = dealt.pop(owner)
            sizes = [len(p[4]) for p in parts]
            numbers = [np.concatenate(c) for c in zip(*(p[1] for p in parts))]
            of_context, at = distinct(joint(numbers))
            contexts = len(at)
            numbers = [c[at] for c in numbers]
            runs = [p[2].astype(np.int64) for p in parts]
            total = np.concatenate([p[3] for p in parts])[at]
            word, count, lower = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
            blocks = [p[0] for p in parts]
            del parts
            context = np.repeat(of_context, np.concatenate(runs))
            most = int(word.max(initial=0)) + 1
            key = context.astype(np.int64)
            if contexts * most >= 1 << 63:
                rank, place = distinct(word)
                key = key * len(place) + rank
            else:
                key *= most
                key += word.astype(np.int64)
            gram, at = distinct(key)
            del key
            n = np.bincount(gram, count, len(at)).astype(np.int64)
            own, lower, word = context[at], lower[at].astype(np.int64), word[at]
            del count, context, at
            known = n > 0
            o, low, c = own[known], lower[known], n[known]
            del own, lower
            # columns of SUMS; how many are 1 to K is at most the number of words
            sums = [np.bincount(o[low > K], low[low > K], contexts).astype(np.int64)]
            sums += [np.bincount(o[x == i], minlength=contexts).astype(_places(len(o))) for x in (low, c) for i in range(1, K + 1)]
            rows = [
                ("table", None, owner, None, pack(beside(numbers)), pack(narrow(total)), pack(narrow(np.bincount(o, minlength=contexts))), pack(narrow(word[known])), pack(narrow(c))),
                ("stats", None, owner, _count_counts(n)),
            ]
            del o, low, c, known, word
            n = narrow(n)
            shared = splits(total, owners, tokens) > 1
            rows += [("shared", None, owner, [int(x[k]) for x in sums], _key(numbers, k)) for k in np.flatnonzero(shared).tolist()]
            plain = ~np.any([x > 0 for x in sums[1 + K :]], axis=0)
            for block, run_of, (i, j), (a, b) in zip(blocks, runs, _bounds(sizes), _bounds([len(x) for x in runs])):
                here, answer = of_context[a:b], n[gram[i:j]]
                bare = np.logical_or.reduceat(answer == 0, np.cumsum(run_of) - run_of)
                rows.append(("grams", block, owner, None, pack(narrow(answer)), pack(np.packbits(plain[here])), pack(narrow(np.concatenate([x[here[bare]] for x in sums])))))
                rows += [("asks", block, owner, None, _key(numbers, k)) for k in here[shared[here]].tolist()]
            yield _rows(rows, ANSWER_HEAD)

    return giving_back(run)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _probabilities(b: _Block, unigrams: Unigrams, d: list[np.ndarray]) -> list[np.ndarray]:
    """For each order the probability of each of its n-grams, from single words up; d has the discounts from order 2 on."""
    out = [unigrams.p(b.levels[0].n[: b.size])]
    divisor = None
    for (plain, context, left, mass), level, below, own in zip(b.sums, b.levels[1:], b.levels, d):
        total = np.maximum(below.n.astype(float), 1) + plain
        alpha = np.ones(len(below.n))  # of contexts that were not seen
        alpha[context] = left / total[context] / (1 - mass / (unigrams.total if divisor is None else divisor[below.lower[context]]))
        p = np.empty(len(level.n))
        for s in _pieces(len(p)):
            n, at = level.n[s].astype(float), level.context[s]
            p[s] = np.where(n > 0, discounted(n, own) / total[at], alpha[at] * out[-1][level.lower[s]])
        out.append(p)
        divisor = total
    return out


def _evaluate(owners: int, unigrams: Unigrams, vocabulary: int, documents: int, d: list[np.ndarray]):
    """Scores a block's documents, given the answers for its words and n-grams of all orders."""
    known = _blocks_with_answers(owners, unigrams.tokens, documents, len(d) + 1, [unigrams.d, *d])

    def run(key, blocks, answers):
        tables = []
        for r, b in known(blocks, answers):
            p = _probabilities(b, unigrams, d)
            logs = np.zeros(len(b.levels[0].gram))
            for level, own in zip(b.levels, p):
                with np.errstate(divide="ignore"):
                    np.log10(own, out=own)
                for s in _pieces(len(logs)):
                    there = level.gram[s] >= 0  # the highest order that a token has context for decides
                    logs[s][there] = own[level.gram[s][there]]
            n = b.levels[0].n[: b.size].astype(float)
            base = np.log10((n + 0.5) / (unigrams.tokens + 0.5 * (vocabulary + 1)))
            body = b.levels[0].gram
            add = lambda x: np.add.reduceat(x, b.first) if len(b.first) else x
            tables.append(
                pa.table(
                    {
                        "doc_id": pa.array(unpack(r["ids"]), mask=~unpack(r["known"])),
                        "held_out": pa.array(~b.train),
                        "n_tokens": pa.array(b.lengths),
                        "n_known": pa.array(add((n > 0).astype(np.int64)[body])),
                        "train_tokens": pa.array(np.full(len(b.first), unigrams.tokens, np.int64)),
                        "base_score": pa.array(add(base[body])),
                        "score": pa.array(add(logs)),
                    }
                )
            )
        p = own = level = logs = n = base = body = add = r = b = None  # before memory is given back
        give_back()
        return pa.concat_tables(tables) if tables else pa.table({n: pa.array([], t) for n, t in EMPTY})

    return run


EMPTY = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def is_training(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 1


class KatzModel:
    """Where the tables are, and the few numbers that turn counts into probabilities."""

    def __init__(self, folder: str, unigrams: Unigrams, vocabulary: int, documents: int, d: list[np.ndarray]) -> None:
        self.folder, self.unigrams, self.vocabulary, self.documents, self.d = folder, unigrams, vocabulary, documents, d


def _in_buckets(df: DataFrame, path: str, buckets: int, key: str) -> DataFrame:
    """df, written in buckets by key, so that a join or cogroup by it needn't shuffle it."""
    spark, name = df.sparkSession, f"katz_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; files at a path of their own stay
    return out


def _forget_shuffles(spark) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that are no longer used."""
    spark._jvm.System.gc()


def katz_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, block_tokens: int = 2_000_000, owner_tokens: int = 2_000_000) -> tuple[DataFrame, KatzModel]:
    """One row per input row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), and the model of this order.

    Rows whose id has crc32 mod 5 = 1 are held out; a null id counts as an empty text there and is learnt from.  Null texts
    count as empty: one end token.  Repeated rows count each time.  Without training rows every token is unknown and
    has probability one.  A document stays whole in a block; its first tokens have shorter contexts, the first the start
    alone.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    at = workspace(spark, "katz")
    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col).cast("binary"), F.monotonically_increasing_id(), is_training(id_col).alias("train"))
    buckets = min(100_000, max(shuffle_partitions(spark), rows.rdd.getNumPartitions()))
    blocks = _in_buckets(rows.mapInArrow(_blocks(block_tokens), BLOCK), f"{at}/blocks", buckets, "block")
    size = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    owners = max(shuffle_partitions(spark), -(-size // owner_tokens))
    documents = docs.where(is_training(id_col)).count()
    parts = [f"p{i}" for i in range(PARTS)]

    def stats(found: DataFrame, width: int) -> list[int]:
        sums = found.where("kind = 'stats'").agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(width)]).first()
        return [0, *sums]

    def told(found: DataFrame, kind: str, number: int) -> DataFrame:
        return found.where(F.col("kind") == kind).select(F.lit(f"{kind}-{number}").alias("kind"), "block", "owner", "sums", *parts)

    words = blocks.select("block", "words", "body", "lengths", "train").mapInArrow(_deal_words(owners), DEALT)
    found = materialize(words.repartitionById(owners, "owner").mapInArrow(_own_words(owners), ANSWER), f"{at}/order-1", ("kind",))
    *counts, vocabulary, tokens = stats(found, K + 3)
    unigrams = Unigrams(tokens, np.array(counts, float))
    answers = told(found, "words", 1)
    d: list[np.ndarray] = []
    need = blocks.select("block", "words", "body", "lengths", "train")
    for k in range(2, order + 1):
        dealt = need.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_deal(owners, tokens, documents, k), DEALT)
        found = materialize(dealt.repartitionById(owners, "owner").mapInArrow(_own(k, owners, tokens), ANSWER), f"{at}/order-{k}", ("kind",))
        d.append(discounts(np.array(stats(found, K + 1), float)))
        asks = found.where("kind = 'asks'").select("block", "p0").distinct()
        sums = found.where("kind = 'shared'").groupBy("p0").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(SUMS)]).alias("sums"))
        none = [F.lit(None).cast("binary").alias(p) for p in parts[1:]]
        shared = asks.join(sums, "p0").select(F.lit(f"shared-{k}").alias("kind"), "block", F.lit(None).cast("int").alias("owner"), "sums", "p0", *none)
        answers = answers.unionByName(told(found, "grams", k)).unionByName(shared)
        _forget_shuffles(spark)

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_evaluate(owners, unigrams, vocabulary, documents, d), SCORES)
    return scored, KatzModel(at, unigrams, vocabulary, documents, d)
