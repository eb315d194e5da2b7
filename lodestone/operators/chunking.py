"""From pages to chunks: paragraph dedupe, sections, merging, splitting, folding, filtering, tagging.

A page becomes pieces without a shuffle; only dropping repeats across the pages of a source needs one.  What depends on all
that came before in a document (which paragraphs stay, where sections begin and how they are joined) is decided in Arrow
batches, in time that grows with the document's length: only norms, counts and headings go there, and positions come back.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from tokenizers import Encoding, Tokenizer

from lodestone import constants as C
from lodestone.batches import SLICE, by_slices, give_back
from lodestone.functions import text as T
from lodestone.operators.tagging import tag_of

PARAGRAPH = r"\n\s*\n"
_STRINGS = "array<string>"


def described(paragraphs: Column) -> Column:
    """text, norm, n (tokens) and heading of each paragraph with a token."""
    first = F.transform(paragraphs, lambda p: F.struct(p.alias("text"), T.tokens(p).alias("tokens"), T.only_line(p).alias("line")))
    first = F.filter(first, lambda x: F.size(x["tokens"]) > 0)
    second = F.transform(first, lambda x: F.struct(x["text"].alias("text"), F.array_join(x["tokens"], " ").alias("norm"), F.size(x["tokens"]).alias("n"), x["line"].alias("line")))
    return F.transform(second, lambda x: F.struct(x["text"].alias("text"), x["norm"].alias("norm"), x["n"].alias("n"), T.heading_line(x["line"], x["n"]).alias("heading")))


def occurrences(automaton: ahocorasick.Automaton, text: str) -> Iterator[int]:
    """The numbers of the automaton's norms at each place of a text where one ends."""
    return (number for _, number in automaton.iter(text))


def kept_positions(norms: list[str], counts: list[int], headings: list[bool]) -> list[int]:
    """Positions of the paragraphs that stay (see dedupe_paragraphs).

    Where a paragraph first stands in a long one is found for all of them in one pass over the long ones, by an automaton of the
    norms that can be dropped.  It doesn't matter whether that long one stays itself: if it goes, it stands in an earlier one that
    has all its parts too.
    """
    numbers: dict[str, int] = {}
    for norm, n, heading in zip(norms, counts, headings):
        if n >= C.DEDUPE_MIN_TOKENS and not heading:
            numbers.setdefault(norm, len(numbers))
    first = [len(norms)] * len(numbers)  # the position of the first long paragraph that has it
    if numbers and max(counts) >= C.DEDUPE_CONTAINER_TOKENS:
        automaton = ahocorasick.Automaton()
        for norm, number in numbers.items():
            automaton.add_word(norm, number)
        automaton.make_automaton()
        scanned = set()
        for i, (norm, n) in enumerate(zip(norms, counts)):
            if n >= C.DEDUPE_CONTAINER_TOKENS and norm not in scanned:
                scanned.add(norm)
                for number in occurrences(automaton, norm):
                    first[number] = min(first[number], i)
    droppable = [n >= C.DEDUPE_MIN_TOKENS for n in counts]
    inside = [can and not heading and first[numbers[norm]] < i for i, (norm, can, heading) in enumerate(zip(norms, droppable, headings))]
    earliest: dict[str, int] = {}  # of equal norms that don't stand inside another
    for i, (norm, gone) in enumerate(zip(norms, inside)):
        if not gone:
            earliest.setdefault(norm, i)
    return [i for i, norm in enumerate(norms) if not inside[i] and (earliest[norm] == i or not droppable[i])]


def section_positions(headings: list[bool]) -> list[list[int]]:
    """Positions by section; a heading opens one unless it stands first."""
    out: list[list[int]] = []
    for i, heading in enumerate(headings):
        if heading or not out:
            out.append([])
        out[-1].append(i)
    return out


def merged_positions(parts: list[list[int]], counts: list[int], least: int) -> list[list[int]]:
    """Sections joined until they have `least` tokens; a rest goes to the last."""
    out: list[list[int]] = []
    held = least  # tokens of the last one
    for part in parts:
        n = sum(counts[i] for i in part)
        if held < least:
            out[-1] += part
            held += n
        else:
            out.append(list(part))
            held = n
    if held < least and len(out) > 1:
        rest = out.pop()
        out[-1] += rest
    return out


def _by_document(paragraphs: pa.ListArray) -> Iterator[tuple[list, ...]]:
    """The fields of each document's paragraphs, each as a list."""
    ends = paragraphs.offsets.to_pylist()
    fields = paragraphs.values.slice(ends[0], ends[-1] - ends[0]).flatten()
    for i, (begin, end) in enumerate(zip(ends, ends[1:])):  # one document at a time as Python objects
        yield tuple(f.slice(begin - ends[0], end - begin).to_pylist() if paragraphs[i].is_valid else [] for f in fields)


_DESCRIBED = ArrayType(StructType([StructField("text", StringType()), StructField("norm", StringType()), StructField("n", IntegerType()), StructField("heading", BooleanType())]))


def _once(f):
    """f so that the optimizer doesn't copy it into filters, where it would run again, and in the few tasks of a scan."""
    return f.asNondeterministic()


def _kept(paragraphs: pa.Array) -> pa.Array:
    begins = paragraphs.offsets.to_pylist()
    kept = [kept_positions(*rest) for _, *rest in _by_document(paragraphs)]
    ends = np.cumsum([0, *map(len, kept)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), paragraphs.values.take(pa.array([b + i for b, own in zip(begins, kept) for i in own], pa.int64())))


def _joined(texts: list[str], groups: list[list[int]], glue: str) -> list[str]:
    return [glue.join(texts[i] for i in g) for g in groups]


def dedupe_paragraphs(paragraphs: Column) -> Column:
    """Of described paragraphs those that stay: 8 tokens or more repeat none that stayed, and unless a heading stand in none that stayed with 12 or more."""
    return _once(F.arrow_udf(by_slices(_kept), _DESCRIBED))(paragraphs)


def sections(paragraphs: Column, glue: str = "\n\n") -> Column:
    """Described paragraphs as sections; a heading opens one unless it stands first."""

    def opened(paragraphs: pa.Array) -> pa.Array:
        return pa.array([_joined(texts, section_positions(headings), glue) for texts, _, _, headings in _by_document(paragraphs)], pa.list_(pa.string()))

    return _once(F.arrow_udf(by_slices(opened), ArrayType(StringType())))(paragraphs)


def kept_sections(least: int = C.MIN_SECTION_TOKENS):
    """Norms, counts and headings of paragraphs as positions by section, in one go: those that stay of dedupe_paragraphs, cut into
    sections, and sections joined until they have `least` tokens.

    Tokens don't cross paragraphs, so a section has as many as its paragraphs together.
    """

    def cut(paragraphs: pa.Array) -> pa.Array:
        out = []
        for norms, counts, headings in _by_document(paragraphs):
            kept = kept_positions(norms, counts, headings)
            parts = merged_positions(section_positions([headings[i] for i in kept]), [counts[i] for i in kept], least)
            out.append([[kept[i] for i in part] for part in parts])
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    return _once(F.arrow_udf(by_slices(cut), ArrayType(ArrayType(IntegerType()))))


def token_windows(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Windows of `size` tokens, `overlap` of which each shares with the next; texts without tokens have none."""
    stride = size - overlap

    def cut(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(t) - size) / stride)).cast("int")
        return F.when(F.size(t) == 0, F.array().cast(_STRINGS)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(t, i * stride + 1, F.lit(size)), " ")))

    return T.let(T.tokens(text), cut)


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    """A tokenizer of a worker, read once; strings of special tokens in a text are ordinary text."""
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def windows_of(encoded: Encoding, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """First and past-the-last character, and number of ids, of windows over a text's ids; the last one ends with the last id."""
    n, stride = len(encoded), size - overlap
    out = []
    for begin in range(0, max(1, n - overlap) if n else 0, stride):
        end = min(n, begin + size)
        out.append((encoded.token_to_chars(begin)[0], encoded.token_to_chars(end - 1)[1], end - begin))
        if end == n:
            break
    return out


def tokenizer_windows(path: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP):
    """Windows of `size` ids of a tokenizer file, `overlap` of which each shares with the next: start, end (in characters), n, text.

    A text is encoded once, and windows are cut from it at the places of their ids, so that their texts are parts of it as it was
    written.  Null texts and texts without ids have none.
    """

    @F.arrow_udf("array<struct<start: int, end: int, n: int, text: string>>")
    def cut(texts: pa.Array) -> pa.Array:
        encode, out = _tokenizer(path).encode, []
        for text in texts.to_pylist():
            spans = windows_of(encode(text, add_special_tokens=False), size, overlap) if text else []
            out.append([{"start": a, "end": b, "n": n, "text": text[a:b]} for a, b, n in spans])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n", pa.int32()), ("text", pa.string())])))

    return _once(cut)


_TOKEN = regex.compile(T.TOKEN)


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text.lower()))


def split_recursively(text: str, size: int, overlap: int, length: Callable[[str], int], separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size`: parts between the coarsest separator are packed, and too long ones split at finer ones.

    A new piece starts with the last parts of the one before, `overlap` long at most.
    """
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, finer = separators[level], separators[level + 1 :]
    gap = length(sep)
    out: list[str] = []
    window: list[tuple[str, int]] = []
    held = 0

    def close() -> None:
        piece = sep.join(p for p, _ in window).strip()
        if piece:
            out.append(piece)

    for part in text.split(sep) if sep else list(text):
        if not part:
            continue
        n = length(part)
        if n > size and finer:
            close()
            window, held = [], 0
            out += split_recursively(part, size, overlap, length, finer)
            continue
        if window and held + gap + n > size:
            close()
            while window and (held > overlap or held + gap + n > size):
                held -= window.pop(0)[1] + (gap if window else 0)
        window.append((part, n))
        held += n + (gap if len(window) > 1 else 0)
    close()
    return out


def recursive_pieces(size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, length: Callable[[str], int] = count_tokens):
    """The recursive splitter over Arrow batches; length may be any token counter."""

    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else split_recursively(t, size, overlap, length) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(by_slices(pieces), _STRINGS)


def described_pieces(pieces: Column, separator: str = PARAGRAPH) -> Column:
    """Stripped pieces that aren't empty: piece (of the first alone, which stays as it is), and blocks with text, norm and n (tokens) of each paragraph."""
    bare = F.filter(F.transform(pieces, T.strip), lambda p: p != "")
    tokens = lambda p: F.transform(T.split_blocks(p, separator), lambda b: F.struct(b.alias("text"), T.tokens(b).alias("tokens")))
    return F.transform(
        bare,
        lambda p, i: F.struct(F.when(i == 0, p).alias("piece"), F.transform(tokens(p), lambda b: F.struct(b["text"].alias("text"), F.array_join(b["tokens"], " ").alias("norm"), F.size(b["tokens"]).alias("n"))).alias("blocks")),
    )


def folded_texts(pieces: list[dict], least: int) -> list[str]:
    """The texts of described pieces without leading paragraphs that the piece before has; short ones join the piece before."""
    out: list[list[str]] = []  # parts of each text
    known: set[str] = set()  # norms of the last one
    for piece in pieces:
        blocks = piece["blocks"]
        if not out:
            out.append([piece["piece"]])
            known = {b["norm"] for b in blocks}
            continue
        first = next((i for i, b in enumerate(blocks) if not b["norm"] or b["norm"] not in known), None)
        if first is None:
            continue
        rest = blocks[first:]
        text, norms = "\n\n".join(b["text"] for b in rest), {b["norm"] for b in rest}
        if sum(b["n"] for b in rest) < least:
            out[-1].append(text)
            known |= norms
        else:
            out.append([text])
            known = norms
    return ["\n\n".join(parts) for parts in out]


def _fold_rows(least: int):
    """Rows whose last column is described pieces as a row for each folded text, with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):  # so that few rows are Python objects at a time
                batch = whole.slice(begin, SLICE)
                folded = [folded_texts(p or [], least) for p in batch.column(batch.num_columns - 1).to_pylist()]
                of = pa.array([i for i, own in enumerate(folded) for _ in own], pa.int64())
                kept = [column.take(of) for column in batch.columns[:-1]]
                numbers, texts = [n for own in folded for n in range(len(own))], [t for own in folded for t in own]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "piece_no", "text"])
            del whole, batch
            give_back()

    return run


def section_texts(pages: DataFrame, *, text_col: str = "text", separator: str = PARAGRAPH, least: int = C.MIN_SECTION_TOKENS) -> DataFrame:
    """pages with sections: an array of sections of the deduplicated text, merged until they have `least` tokens."""
    step = pages.withColumn("_paragraphs", described(T.split_blocks(F.coalesce(F.col(text_col), F.lit("")), separator)))
    bare = F.transform("_paragraphs", lambda p: F.struct(p["norm"].alias("norm"), p["n"].alias("n"), p["heading"].alias("heading")))  # texts stay here
    step = step.withColumn("_positions", kept_sections(least)(bare))
    texts = lambda part: F.array_join(F.transform(part, lambda i: F.get(F.col("_paragraphs"), i)["text"]), "\n\n")
    return step.withColumn("sections", F.transform("_positions", texts)).drop("_paragraphs", "_positions")


def drop_repeats(pieces: DataFrame, by: list[str], order: list[str], *, text_col: str = "text") -> DataFrame:
    """The first piece of each norm among those that share `by`."""
    norm = pieces.withColumn("_norm", T.normal(F.col(text_col)))
    w = Window.partitionBy(*by, F.xxhash64("_norm"), "_norm").orderBy(*order)
    return norm.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_norm")


def folded_pieces(pages: DataFrame, *, split: Callable[[Column], Column] | None = None, separator: str = PARAGRAPH, keep: tuple[str, ...] = ()) -> DataFrame:
    """source, page, section_no, piece_no, text and the columns to keep for pages (source, page, text): all pieces, before any is dropped.

    split makes an array of pieces of a section; the default is the recursive splitter.
    """
    split = split or recursive_pieces()
    cut = section_texts(pages.select("source", "page", "text", *keep), separator=separator)
    cut = cut.select("source", "page", *keep, F.posexplode("sections").alias("section_no", "section"))
    cut = cut.withColumn("_pieces", described_pieces(split(F.col("section")), separator)).drop("section")
    out = StructType([*cut.schema.fields[:-1], StructField("piece_no", IntegerType()), StructField("text", StringType())])
    return cut.mapInArrow(_fold_rows(C.MIN_SECTION_TOKENS), out).select("source", "page", "section_no", "piece_no", "text", *keep)


def chunks_of(pieces: DataFrame) -> DataFrame:
    """Folded pieces as chunks, with disaster_type: those of 40 tokens or more, of a source's repeats the first.

    Repeats have equally many tokens, so the short ones go before the shuffle.
    """
    cut = pieces.where(T.token_count(F.col("text")) >= C.MIN_MEANINGFUL_TOKENS)
    return drop_repeats(cut, ["source"], ["page", "section_no", "piece_no"]).withColumn("disaster_type", tag_of(F.col("source"), F.col("text")))


def chunk_pages(pages: DataFrame, **how) -> DataFrame:
    """source, page, section_no, piece_no, text, disaster_type for pages (source, page, text); see folded_pieces and chunks_of."""
    return chunks_of(folded_pieces(pages, **how))


def chunk_report(pieces: DataFrame) -> DataFrame:
    """source, pieces, chunks, short, repeated: what becomes of each source's pieces (source, text).

    A piece that is short and repeats another counts as a repeat if an equal one came before, as short otherwise.
    """
    each = pieces.groupBy("source", T.normal(F.col("text")).alias("_norm")).agg(F.count("*").alias("n"), F.max(T.token_count(F.col("text"))).alias("_tokens"))
    short = F.col("_tokens") < C.MIN_MEANINGFUL_TOKENS
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return each.groupBy("source").agg(total("n", "pieces"), total((~short).cast("long"), "chunks"), total(F.when(short, 1), "short"), total(F.col("n") - 1, "repeated"))


def chunk_blocks(blocks: DataFrame) -> DataFrame:
    """One chunk for each hand-made block (source, block_no, page, text); only repeats of a source are dropped."""
    return drop_repeats(blocks, ["source"], ["block_no"]).withColumn("disaster_type", tag_of(F.col("source"), F.col("text")))
