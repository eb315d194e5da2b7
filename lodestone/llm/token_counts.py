"""Token counts of a unigram tokenizer by dynamic programming on a trie.

Distinct pre-tokens (a word mark and a word) are inserted in a trie.  A node keeps the forward score of its prefix, that
is the best sum of log probabilities of pieces that spells it, and the number of pieces; both are computed once, when the node is made,
from the nodes above it.  The node where a pre-token ends so holds its count.  Each Python worker has one trie of a bounded
size, and a document's count is the sum over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_of

MARK = "▁"
LONG = 1000


class Pieces:
    """Log probabilities of pieces, the suffixes of pieces, and the score of an unknown character, which falls back to its bytes."""

    def __init__(self, scores: dict[str, float], unknown: float) -> None:
        self.scores, self.unknown = scores, unknown
        self.suffixes = {p[i:] for p in scores for i in range(len(p))}
        self.longest = max(map(len, scores), default=1)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The ordinary pieces of a SentencePiece model.

        A model that stores ranks instead of log probabilities (as merges do) gives its pieces those of Zipf's law:
        P(piece of rank r) = 1 / (r H), r from 1 by the stored scores.  Nothing is fitted to the documents, so a
        document's count depends on it and the vocabulary alone.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(ids, key=lambda i: (-sp.get_score(i), i))
        harmonic = sum(1 / r for r in range(1, len(ranked) + 1))
        scores = {sp.id_to_piece(i): -math.log(r * harmonic) for r, i in enumerate(ranked, 1)}
        return cls(scores, min(scores.values(), default=0.0) - 10)


class TrieCounts(dict):
    """Pieces in the best spelling of each word (UTF-8); of equally good ones the shortest counts.

    The trie and the counts are dropped when the trie has most_nodes nodes.  Words over LONG characters would fill it and
    are seldom met again: their scores are computed outside, with no more held than the longest piece spans.
    """

    def __init__(self, pieces: Pieces, most_nodes: int = 600_000) -> None:
        self.pieces, self.most_nodes = pieces, most_nodes
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, text: str) -> int:
        """The node where text ends."""
        children, score, count, scores, suffixes = self.children, self.score, self.count, self.pieces.scores, self.pieces.suffixes
        node, path = 0, [0]
        for d, ch in enumerate(text):
            key = node * 0x110000 + ord(ch)
            node = children.get(key, -1)
            if node < 0:
                best, fewest = (score[path[d]] + self.pieces.unknown, count[path[d]] + len(ch.encode())) if ch not in scores else (float("-inf"), 0)
                for j in range(d, -1, -1):
                    piece = text[j : d + 1]
                    if piece not in suffixes:
                        break
                    own = scores.get(piece)
                    if own is not None:
                        s, n = score[path[j]] + own, count[path[j]] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                node = children[key] = len(score)
                score.append(best)
                count.append(fewest)
            path.append(node)
        return node

    def walk(self, text: str) -> int:
        """The count of text by the same scores, without the trie."""
        scores, unknown, width = self.pieces.scores, self.pieces.unknown, self.pieces.longest
        last = [(0.0, 0)]  # best score and count of the prefixes that a piece can still begin at, the longest last
        for d, ch in enumerate(text):
            best, fewest = (last[-1][0] + unknown, last[-1][1] + len(ch.encode())) if ch not in scores else (float("-inf"), 0)
            for k in range(1, len(last) + 1):
                own = scores.get(text[d + 1 - k : d + 1])
                if own is not None:
                    s, n = last[-k][0] + own, last[-k][1] + 1
                    if s > best or s == best and n < fewest:
                        best, fewest = s, n
            last.append((best, fewest))
            del last[:-width]
        return last[-1][1]

    def __missing__(self, word: bytes) -> int:
        text = MARK + word.decode()
        if len(text) > LONG:
            return self.walk(text)
        if len(self.score) >= self.most_nodes:
            self._reset()
        out = self[word] = self.count[self.insert(text)]
        return out


_tries: dict[str, TrieCounts] = {}


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tries:
            _tries[path] = TrieCounts(Pieces.load(path))
        of = _tries[path].__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                own = text.as_buffer().to_pybytes().split()
                words.append(len(own))
                tokens.append(sum(map(of, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return count


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens.

    A character that no piece has counts as its UTF-8 bytes.  Null texts count as empty and have no tokens.  Very long
    words are walked once like any others, outside the trie.  Null ids and repeated rows are counted like any others; an empty table gives
    an empty result.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col).cast("binary"))
    return rows.mapInArrow(_count(model_path), "doc_id long, n_words long, n_tokens long")
