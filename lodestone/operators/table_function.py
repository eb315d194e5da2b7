"""Documents to chunks as a table function, for those who write SQL.

    SELECT * FROM chunk_documents(TABLE(SELECT doc_id, text FROM documents) PARTITION BY (doc_id), 300, 30)

The same steps as chunking.folded_pieces with token windows; the function is registered for a session by `register`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone import constants as C
from lodestone.functions.text import SPACES
from lodestone.operators import chunking as K

_WORD = re.compile(r"[A-Za-z][A-Za-z'-]*")


def looks_like_heading(line: str, n: int) -> bool:
    """See functions.text.heading_line, of which this is the plain form."""
    if re.match(r"#{1,6}\s+\S", line):
        return True
    if line[0] in "-*•" or not 0 < n <= C.HEADING_MAX_WORDS or line[-1] in ".!":
        return False
    if line[-1] in ":?" or (n <= C.NUMBERED_HEADING_MAX_WORDS and re.match(r"[0-9]+\.\s+\S", line)):
        return True
    words = _WORD.findall(line)
    return bool(words) and sum("A" <= w[0] <= "Z" for w in words) >= C.HEADING_TITLE_SHARE * len(words)


def chunk_text(text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Iterator[tuple[int, int, str, int, str]]:
    """section_no, piece_no, text, tokens and norm of a text's pieces; its lines are its paragraphs."""
    lines = [x for x in (line.strip(SPACES) for line in text.split("\n")) if x]
    tokens = [K._TOKEN.findall(x.lower()) for x in lines]
    lines, tokens = [x for x, t in zip(lines, tokens) if t], [t for t in tokens if t]
    counts = list(map(len, tokens))
    headings = [("\r" not in x or len([y for y in re.split(r"\r", x) if y.strip(SPACES)]) == 1) and looks_like_heading(x.strip(SPACES), n) for x, n in zip(lines, counts)]
    kept = K.kept_positions([" ".join(t) for t in tokens], counts, headings)
    parts = K.merged_positions(K.section_positions([headings[i] for i in kept]), [counts[i] for i in kept], C.MIN_SECTION_TOKENS)
    for section_no, part in enumerate(parts):
        words = [w for i in part for w in tokens[kept[i]]]
        stride = size - overlap
        windows = [words[b : b + size] for b in range(0, max(1, len(words) - overlap), stride)]
        pieces = [{"piece": " ".join(w), "blocks": [{"text": " ".join(w), "norm": " ".join(w), "n": len(w)}]} for w in windows]
        for piece_no, piece in enumerate(K.folded_texts(pieces, C.MIN_SECTION_TOKENS)):
            found = K._TOKEN.findall(piece.lower())
            yield section_no, piece_no, piece, len(found), " ".join(found)


class ChunkDocuments:
    """doc_id, section_no, piece_no, text, tokens, norm of the documents of a table with doc_id and text; null texts have no pieces.

    The table may be partitioned by any columns, or not at all: documents are cut each by itself.
    """

    @staticmethod
    def analyze(row: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not row.isTable or not {"doc_id", "text"} <= set(row.dataType.names):
            raise ValueError("chunk_documents takes a table with doc_id and text")
        width, shared = (a.value if a is not None else d for a, d in ((size, C.CHUNK_SIZE), (overlap, C.CHUNK_OVERLAP)))
        if width is None or shared is None or not 0 <= shared < width:
            raise ValueError("windows must be longer than what they share, and both be constants")
        out = StructType().add("doc_id", LongType()).add("section_no", IntegerType()).add("piece_no", IntegerType())
        return AnalyzeResult(out.add("text", StringType()).add("tokens", IntegerType()).add("norm", StringType()))

    def eval(self, row: Row, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Iterator[tuple]:
        if row["text"] is not None:
            for piece in chunk_text(row["text"], size, overlap):
                yield row["doc_id"], *piece


def register(spark: SparkSession, name: str = "chunk_documents") -> None:
    """Makes the function known to a session's SQL."""
    spark.udtf.register(name, udtf(ChunkDocuments))
