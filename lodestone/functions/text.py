"""Column functions over text.  All are built from Spark's own functions; the only UDF is NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.batches import by_slices

#: A token: letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"
#: White space as Python's str.strip sees it.
_SPACE = r"[\s\p{Z}]"
#: The same as characters: ASCII white space and all separators of Unicode.
SPACES = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def nfkc(c: Column) -> Column:
    """NFKC normal form."""

    def normalize(s: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in s.to_pylist()], pa.string())

    return F.arrow_udf(by_slices(normalize), "string")(c)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once; inside lambdas Spark would work it out wherever it stands.

    Where a Python function is applied to the result, the body must not use the variable of an outer lambda inside a lambda of its
    own: Spark 4.1 then leaves the function unplanned ("Cannot evaluate expression").
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def any_of(tests: list[Column]) -> Column:
    """Whether one of the tests holds."""
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def ends_with(c: Column, marks: tuple[str, ...] = C.TERMINAL) -> Column:
    return any_of([c.endswith(m) for m in marks])


def clean(c: Column, *, normal_form: bool = True) -> Column:
    """NFKC, no soft hyphens, plain fi and fl, single spaces, at most one blank line, no outer white space."""
    c = nfkc(c) if normal_form else c
    c = F.replace(F.replace(F.replace(c, F.lit("­"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(TOKEN))


def normal(c: Column) -> Column:
    """The tokens, joined by spaces."""
    return F.array_join(tokens(c), " ")


def word_count(c: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(c, F.lit(r"[^\s\p{Z}]+"))


def split_blocks(c: Column, separator: str = r"\n\s*\n") -> Column:
    """Stripped non-empty parts between separators."""
    return F.filter(F.transform(F.split(c, separator, -1), strip), lambda p: p != "")


def snippet(c: Column, limit: int = C.SNIPPET_CHARS) -> Column:
    """One line, cut after limit characters."""
    one = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one)


def card_snippet(c: Column, limit: int = C.SNIPPET_CHARS) -> Column:
    """White space collapsed; cut to limit - 1 characters without trailing space."""
    one = F.trim(F.regexp_replace(c, rf"{_SPACE}+", " "))
    return F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("..."))).otherwise(one)


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.coalesce(c, F.lit("")), r"[\\/]", -1), -1)


def is_paragraph(c: Column) -> Column:
    """Many words, or a closing mark."""
    return let(strip(c), lambda s: (s != "") & ((word_count(s) >= C.PARAGRAPH_MIN_WORDS) | ends_with(s)))


def is_link_fragment(c: Column) -> Column:
    def rule(s: Column) -> Column:
        short = (word_count(s) < C.LINK_FRAGMENT_MAX_WORDS) & ~ends_with(s)
        return (s != "") & (s.isin(*C.LINK_EXACT) | any_of([s.contains(m) for m in C.LINK_MARKERS]) | short)

    return let(strip(c), rule)


def only_line(block: Column) -> Column:
    """The block's line, stripped, if it has exactly one that isn't blank; else null."""
    bare = strip(block)
    lines = F.filter(F.transform(F.split(bare, r"\r\n|[\n\r]", -1), strip), lambda x: x != "")
    one = F.when(F.size(lines) == 1, F.get(lines, F.lit(0)))
    return F.when(bare == "", F.lit(None).cast("string")).when(bare.rlike(r"[\n\r]"), one).otherwise(bare)


def is_heading(block: Column) -> Column:
    """Whether a block is one line that looks like a heading."""
    line = only_line(block)
    return heading_line(line, token_count(line))


def heading_line(line: Column, n: Column) -> Column:
    """Whether a stripped line with n tokens looks like a heading; null doesn't."""
    words = F.regexp_extract_all(line, F.lit(r"[A-Za-z][A-Za-z'-]*"), F.lit(0))
    titled = let(words, lambda alpha: (F.size(alpha) > 0) & (F.size(F.filter(alpha, lambda w: w.rlike(r"^[A-Z]"))) >= C.HEADING_TITLE_SHARE * F.size(alpha)))
    return (
        F.when(line.isNull(), False)
        .when(line.rlike(r"^#{1,6}\s+\S"), True)
        .when(line.rlike(r"^[-*•]"), False)
        .when((n == 0) | (n > C.HEADING_MAX_WORDS), False)
        .when(line.rlike(r"[.!]$"), False)
        .when(line.rlike(r"[:?]$"), True)
        .when(line.rlike(r"^\d+\.\s+\S") & (n <= C.NUMBERED_HEADING_MAX_WORDS), True)
        .otherwise(titled)
    )


def occurrences(c: Column, phrase: str) -> Column:
    """Non-overlapping occurrences; what the phrase isn't in is only searched for it."""
    return F.when(~F.contains(c, F.lit(phrase)), F.lit(0).cast("long")).otherwise((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def safety_score(c: Column, phrases: tuple[str, ...] = C.SAFETY_PHRASES) -> Column:
    low = F.lower(c)
    out = F.lit(0).cast("long")
    for p in phrases:
        out = out + occurrences(low, p)
    return out


def has_citation(c: Column) -> Column:
    return c.rlike(r"\[[0-9]+\]")


def strip_canned(c: Column, phrase: str = C.LOW_CONFIDENCE_MESSAGE) -> Column:
    """A cited answer without the no-answer sentence; other answers stay."""
    bare = F.replace(c, F.lit(phrase), F.lit(""))
    bare = strip(F.regexp_replace(F.regexp_replace(bare, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))
    return F.when(has_citation(c) & c.contains(phrase), bare).otherwise(c)


def strip_leading_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*(\[[0-9]+\]\s*)+\n", "")


def markdown_links_to_text(c: Column) -> Column:
    for pattern in C.MARKDOWN_LINKS:
        c = F.regexp_replace(c, pattern, "$1")
    return c


def confidence_bucket(score: Column, gated: Column) -> Column:
    """Label of a score; none for gated or missing ones."""
    return (
        F.when(gated | score.isNull(), F.lit(None).cast("string"))
        .when(score >= C.HIGH_CONFIDENCE, "high confidence")
        .when(score >= C.PARTIAL_CONFIDENCE, "partial match")
        .otherwise("low match")
    )


def first_tag(c: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """The first tag, in order, of which a phrase is in the lower-cased text."""
    low, out = F.lower(c), F.when(F.lit(False), F.lit(None).cast("string"))
    for tag, alternates in phrases.items():
        out = out.when(any_of([low.contains(a) for a in alternates]), tag)
    return out


def append_canonical(c: Column, tag: Column) -> Column:
    """The text, followed by its tag unless the tag is null or in it."""
    return F.when(tag.isNull() | F.lower(c).contains(F.lower(tag)), c).otherwise(F.concat(c, F.lit(" "), tag))


def answer_blocks(c: Column) -> Column:
    """Blocks of an answer: kind (bullets, numbered, paragraph) and items."""
    blocks = F.filter(F.split(strip(c), r"\n{2,}", -1), lambda b: b != "")

    def one(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n", -1), strip), lambda x: x != "")
        several = F.size(lines) > 1
        bullets = several & F.forall(lines, lambda x: x.rlike(r"^[-*]\s+"))
        numbered = several & F.forall(lines, lambda x: x.rlike(r"^[0-9]+\.\s+"))
        kind = F.when(bullets, "bullets").when(numbered, "numbered").otherwise("paragraph")
        items = (
            F.when(bullets, F.transform(lines, lambda x: F.regexp_replace(x, r"^[-*]\s+", "")))
            .when(numbered, F.transform(lines, lambda x: F.regexp_replace(x, r"^[0-9]+\.\s+", "")))
            .otherwise(F.array(F.array_join(lines, " ")))
        )
        return F.struct(kind.alias("kind"), items.alias("items"))

    return F.transform(blocks, one)


def citation_numbers(c: Column) -> Column:
    """Numbers in citation marks, in order; those with over nine digits are none."""
    found = F.regexp_extract_all(c, F.lit(r"\[([0-9]+)\]"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.when(F.length(x) <= 9, x.cast("int"))), lambda n: n.isNotNull())


def linked_citations(c: Column, n_citations: Column) -> Column:
    """The numbers that link to one of n citations."""
    return F.filter(citation_numbers(c), lambda n: (n >= 1) & (n <= n_citations))
