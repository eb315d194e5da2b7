"""Packing documents into sequences by first-fit decreasing, with a tournament tree of bin capacities.

Texts are tokenised in map tasks, word by word with a bounded cache, and cut into pieces; only the pieces' lengths and
checksums go on.  They are written with a row number, which deals them at random to groups of a bounded size; each group
is packed on its own.
"""

from __future__ import annotations

import json
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import giving_back, materialize, text_of, workspace

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

LONG = 100

_words: dict[str, WordIds] = {}


#: Of the normalizer and pre-tokenizer that WordIds knows by heart: what makes a lower-case word of letters one input of the model.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters as the byte-level letters of their UTF-8 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


_BYTE_LETTERS = _byte_letters()


def _treats_letters_alone(tokenizer) -> bool:
    """Whether a tokenizer passes lower-case words of Latin-1 letters to its model as they are, and marks at the end of a word by themselves."""
    d = json.loads(tokenizer.to_str())
    steps = (d["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
    return (
        (d["normalizer"] or {}).get("normalizers") == _NORMAL
        and len(steps) == 2
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        and d["model"]["type"] == "BPE"
        and not d["model"].get("dropout")
        and not d["truncation"]
        and not d["padding"]
        and all("<|" in t["content"] for t in d["added_tokens"])
    )


class WordIds(dict):
    """The ids of a word as little-endian 32-bit integers, from a tokenizer that drops white space, lower-cases and treats words alone.

    A word's ASCII capitals, and a full stop or comma after an ASCII letter, make no difference to the ids of the rest, so
    such words are led back to others.  If the tokenizer's file says so, other marks after a letter and Latin-1 capitals are led back too, and
    words of lower-case letters go to the model itself, without the patterns.  Words over LONG bytes are not held.  When `most` words are
    held they become the older half; a word in use comes back from there, and the others are forgotten when the next half is full.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.older = Tokenizer.from_file(path), most, {}
        self.model = self.tokenizer.model if _treats_letters_alone(self.tokenizer) else None

    def __missing__(self, word: bytes) -> bytes:
        out = self.older.get(word)
        if out is None:
            if len(word) > 1 and word[-1] in b".," and word[-2:-1].isalpha():
                out = self[word[:-1]] + self[word[-1:]]
            elif (lower := word.lower()) != word and b"<|" not in word:  # special tokens have "<|" and keep their case
                out = self[lower]
            elif self.model is None or b"<|" in word:
                out = self.encoded(word.decode())
            else:
                out = self.by_model(word)
        if len(word) > LONG:
            return out
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def encoded(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def by_model(self, word: bytes) -> bytes:
        """The ids of a word without ASCII capitals and special tokens."""
        text = word.decode()
        bare = text if text.isalpha() else text.rstrip(string.punctuation)
        if not bare.isalpha() or max(bare) > "\xff":
            return self.encoded(text)
        if bare != text:
            return self[bare.encode()] + self[text[len(bare) :].encode()]
        if (lower := text.lower()) != text:
            return self[lower.encode()]
        return array("I", [t.id for t in self.model.tokenize(text.translate(_BYTE_LETTERS))]).tobytes()


def word_ids(path: str) -> WordIds:
    """One cache for each Python worker."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def _cut(path: str, room: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(map(ids_of.__getitem__, text.as_buffer().to_pybytes().split())) + end
                n = len(ids) // 4
                for start in range(0, n, room):
                    piece = ids[4 * start : 4 * (start + room)]
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return giving_back(cut)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", room: int = 4096, end_id: int = 2) -> DataFrame:
    """Each text's ids and the closing id, cut from the start into pieces of `room` ids and a rest."""
    return docs.select(F.col(id_col).cast("long"), text_of(text_col).cast("binary")).mapInArrow(_cut(tokenizer_path, room, end_id), PIECES)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths must not rise.

    The tree's leaves hold what is free in each bin, inner nodes the larger of their children, so the first bin with room
    is found by a walk from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    free = [room] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for k, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < length:
                node += 1
        bins[k], offsets[k] = node - leaves, room - free[node]
        free[node] -= length
        node >>= 1
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node >>= 1
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def _pack(room: int):
    def pack(key, pieces):  # without hints: Spark takes key and table
        column = lambda name: pc.fill_null(pieces[name], np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((column("ids_crc32"), column("start"), column("doc_id"), -column("length")))
        bins, offsets = first_fit_decreasing(column("length")[order], room)
        out = pieces.take(pa.array(order)).drop_columns(["group", "row"])
        return out.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    return pack


def pack_pieces(pieces: DataFrame, *, room: int = 4096, group_pieces: int = 8192, seed: int = 42) -> DataFrame:
    """Pieces, which have a row number in `row`, with sequence_id and offset instead of it.

    Groups have about group_pieces pieces, however often an id occurs; sequence_id holds the group in its upper half.

    Every group leaves at most about half its last sequence open.  Equal pieces may change places between reruns.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(room), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", room: int = 4096, end_id: int = 2, group_pieces: int = 8192, seed: int = 42) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty and yield the closing id alone.  Very long texts yield many pieces, which are dealt to
    different groups.  Null ids and repeated rows are packed like any others; an empty table gives an empty result.
    Other columns of docs are not read.
    """
    pieces = tokenized_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, room=room, end_id=end_id)
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), workspace(docs.sparkSession, "packing") + "/pieces")
    return pack_pieces(pieces, room=room, group_pieces=group_pieces, seed=seed)
