"""Cleaning of scraped pages in three dialects.

A document is an array of lines; every rule is an expression over it, so that cleaning is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T

_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def split_lines(c: Column) -> Column:
    """Lines without their ends; a last line end opens no line, and an empty text has none."""
    parts = F.split(c, _LINES, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_or_empty(lines: Column, i: int) -> Column:
    return F.coalesce(F.get(lines, F.lit(i)), F.lit(""))


def _after_header(lines: Column, is_header: Column) -> tuple[Column, Column]:
    """Title and body: four lines are cut if they are a header; fewer than four lines have no title."""
    long_enough = F.size(lines) >= 4
    title = F.when(long_enough, T.strip(line_or_empty(lines, 0))).otherwise("")
    return title, F.when(long_enough & is_header, F.slice(lines, F.lit(5), F.greatest(F.size(lines) - 4, F.lit(0)))).otherwise(lines)


def strip_header(lines: Column, dialect: str) -> tuple[Column, Column]:
    """Title and body of a page with a reader-mode header: an address in line 4; but for the ready dialect also author and reading time."""
    if dialect == "ready":
        return _after_header(lines, line_or_empty(lines, 3).rlike(C.URL_LINE))
    author = C.CROSS_AUTHOR if dialect == "cross" else C.EMD_AUTHOR
    is_header = (T.strip(line_or_empty(lines, 1)) == author) & T.strip(line_or_empty(lines, 2)).rlike(C.READ_TIME) & T.strip(line_or_empty(lines, 3)).rlike(C.URL_LINE)
    return _after_header(lines, is_header)


def _first_true(flags: Column) -> Column:
    """Position (from 1) of the first true; 0 if there is none."""
    return F.coalesce(F.array_position(flags, True), F.lit(0)).cast("int")


def strip_top_contents(lines: Column) -> Column:
    """Without all lines before the first paragraph."""
    at = _first_true(F.transform(lines, T.is_paragraph))
    return F.when(at == 0, F.slice(lines, 1, 0)).otherwise(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)))


def cut_trailing_links(lines: Column) -> Column:
    """Without the trailing run of link titles: if the last non-blank line is a link fragment and no paragraph, all after the
    last line before it that ends a sentence; blank lines between that and the first cut line stay."""
    flags = _flags(lines)
    last = _last_at(flags, lambda f: f > 0)
    enters = (last > 0) & T.let(F.get(lines, last - 1), lambda bottom: ~T.is_paragraph(bottom) & T.is_link_fragment(bottom))
    return F.when(enters, _cut_open_tail(lines, flags, last - 1)).otherwise(lines)


def cut_trailing_chrome(lines: Column) -> Column:
    """Without the trailing lines that end no sentence; blank lines above the first of them stay."""
    return _cut_open_tail(lines, _flags(lines), F.size(lines))


def _flags(lines: Column) -> Column:
    """0 for blank lines, 1 for those that end a sentence, 2 for others."""
    return F.transform(lines, lambda x: T.let(T.strip(x), lambda bare: F.when(bare == "", 0).when(T.ends_with(bare), 1).otherwise(2)))


def _last_at(flags: Column, test) -> Column:
    """Position (from 1) of the last element that passes; 0 if there is none."""
    return F.aggregate(flags, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda s, f: F.struct((s["i"] + 1).alias("i"), F.when(test(f), s["i"] + 1).otherwise(s["at"]).alias("at")), lambda s: s["at"])


def _cut_open_tail(lines: Column, flags: Column, until: Column) -> Column:
    """Lines up to the one before the first open line (flag 2) after the last closing one (flag 1) among the first `until`; the rest if none is open."""
    closing = _last_at(F.slice(flags, F.lit(1), until), lambda f: f == 1)
    tail = F.slice(flags, closing + 1, F.greatest(F.size(flags) - closing, F.lit(0)))
    first_open = _first_true(F.transform(tail, lambda f: f == 2))
    return F.when(first_open == 0, lines).otherwise(F.slice(lines, F.lit(1), closing + first_open - 1))


def collapse_blank_lines(lines: Column) -> Column:
    """Runs of blank lines become one empty line, and none stand first or last."""
    none = F.lit(None).cast("string")
    # each line with the one before it; the pair past the last line has no line
    kept = F.zip_with(lines, F.concat(F.array(none), lines), lambda x, before: F.when(~T.is_blank(x), x).when(x.isNotNull() & ~F.coalesce(T.is_blank(before), F.lit(False)), ""))


    def bare_ends(kept: Column) -> Column:
        first = F.when(F.get(kept, F.lit(0)) == "", 2).otherwise(1)
        n = F.size(kept) - F.when(F.get(kept, F.size(kept) - 1) == "", 1).otherwise(0)
        return F.slice(kept, first, F.greatest(n - first + 1, F.lit(0)))

    return T.let(F.filter(kept, lambda x: x.isNotNull()), bare_ends)


def skip_sections(lines: Column, sections: Column) -> Column:
    """Without known blocks: from a start line up to before its end line (or to the end, if that is null).

    sections is an array of (start, end) in order of precedence.  Each start counts once.
    """
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skipping"), F.lit(None).cast("string").alias("until"), F.array().cast("array<int>").alias("used"))

    def step(s: Column, line: Column) -> Column:
        bare = T.strip(line)
        hit = F.get(F.filter(F.transform(sections, lambda x, i: F.when((x["start"] == bare) & ~F.array_contains(s["used"], i), i)), lambda i: i.isNotNull()), F.lit(0))
        ends = s["skipping"] & s["until"].isNotNull() & (s["until"] == bare)
        begins = ~s["skipping"] & hit.isNotNull()
        keep = ends | (~s["skipping"] & ~begins)
        return F.struct(
            F.when(keep, F.array_append(s["out"], line)).otherwise(s["out"]).alias("out"),
            F.when(ends, False).when(begins, True).otherwise(s["skipping"]).alias("skipping"),
            F.when(begins, F.get(sections, hit)["end"]).otherwise(s["until"]).alias("until"),
            F.when(begins, F.array_append(s["used"], hit)).otherwise(s["used"]).alias("used"),
        )

    return F.aggregate(lines, state, step, lambda s: s["out"])


def sections_of(source: Column) -> Column:
    """The blocks to skip, by file name."""
    kind = "array<struct<start: string, end: string>>"
    out = F.when(F.lit(False), F.lit(None).cast(kind))
    for name, pairs in C.EMD_SECTIONS.items():
        out = out.when(source == name, F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).cast("string").alias("end")) for a, b in pairs]))
    return F.coalesce(out, F.array().cast(kind))


def ready_line_dropped(line: Column) -> Column:
    return line.rlike(C.URL_LINE) | line.rlike(C.READY_BOILERPLATE) | T.let(T.strip(line), lambda s: s.isin(*C.READY_NOISE) | s.rlike(C.READY_LAST_UPDATED))


def cross_line(line: Column) -> Column:
    """A line of the cross dialect; null if it is page chrome."""

    def rule(s: Column) -> Column:
        drop = s.rlike(C.URL_LINE) | s.isin(*C.CROSS_NOISE) | T.any_of([s.startswith(p) for p in C.CROSS_DROP_PREFIXES] + [s.contains(p) for p in C.CROSS_DROP_CONTAINS])
        out = s
        for old, new in C.CROSS_REWRITES:
            out = F.replace(out, F.lit(old), F.lit(new))
        return F.when(s == "", s).when(~drop, T.strip(F.regexp_replace(out, C.CROSS_SHOP, "")))

    return T.let(T.markdown_links_to_text(T.strip(line)), rule)


def line_spacing(line: Column) -> Column:
    for old, new in C.EMD_SPACING:
        line = F.replace(line, F.lit(old), F.lit(new))
    for pattern, new in ((r"[ \t]{2,}", " "), (r"\s+([,.;:!?])", "$1"), (r"\(\s+", "(")):
        line = F.regexp_replace(line, pattern, new)
    return T.strip(line)


def strip_annotations(line: Column) -> Column:
    """Without markdown links, link annotations and addresses."""
    line = F.regexp_replace(T.markdown_links_to_text(line), C.EMD_ANNOTATION, " ")
    return line_spacing(F.regexp_replace(line, r"https?://\S+", ""))


def emd_line(line: Column) -> Column:
    """A line of the emd dialect; null if it is page chrome; known captions become sentences."""

    def rule(s: Column) -> Column:
        drop = s.rlike(C.URL_LINE) | s.isin(*C.EMD_NOISE) | T.any_of([s.startswith(p) for p in C.EMD_DROP_PREFIXES])
        out = F.when(s == "", s).when(drop, F.lit(None).cast("string"))
        for prefix, sentence in C.EMD_CAPTIONS:
            out = out.when(s.startswith(prefix), sentence)
        return out.otherwise(s)

    return T.let(strip_annotations(line), rule)


def _present(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.isNotNull())


def finish(title: Column, lines: Column, *, spacing: bool = False) -> Column:
    """Title as a first heading, the lines, at most one blank line in a row, one line end at the end."""
    text = T.nfkc(F.concat(F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""), F.array_join(lines, "\n")))
    if spacing:
        text = F.array_join(F.transform(split_lines(text), lambda x: F.when(T.is_blank(x), "").otherwise(line_spacing(x))), "\n")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[\s\p{Z}]+$", ""), F.lit("\n"))


def clean_scrapes(files: DataFrame, dialect: str) -> DataFrame:
    """source, text (cleaned), in_lines, out_lines for files (source, text) of a dialect: ready, cross or emd.  Null texts count as empty.

    Write the result before filtering on text: Spark would push the filter down and repeat the rules inside it.
    """
    lines = split_lines(F.coalesce(F.col("text"), F.lit("")))
    cut = files.withColumn("_lines", lines)
    title, body = strip_header(F.col("_lines"), dialect)
    cut = cut.withColumns({"_title": title, "_body": body})
    c = F.col("_body")
    if dialect == "ready":
        steps = [strip_top_contents, lambda x: F.transform(F.filter(x, lambda y: ~ready_line_dropped(y)), T.markdown_links_to_text), cut_trailing_links]
    elif dialect == "cross":
        steps = [lambda x: _present(F.transform(x, cross_line)), collapse_blank_lines]
    elif dialect == "emd":
        steps = [lambda x: _present(F.transform(x, emd_line)), lambda x: skip_sections(x, sections_of(F.col("source"))), cut_trailing_chrome, collapse_blank_lines]
    else:
        raise ValueError(f"unknown dialect {dialect}")
    for step in steps:  # a column for each step, so that no expression is repeated inside another
        cut = cut.withColumn("_body", step(c))
    out = cut.select("source", finish(F.col("_title"), c, spacing=dialect == "emd").alias("text"), F.size("_lines").alias("in_lines"))
    return out.withColumn("out_lines", F.regexp_count("text", F.lit("\n")))


def shrinkage(cleaned: DataFrame) -> DataFrame:
    """Totals of lines in and out and the share that went, in per cent."""
    i, o = F.sum("in_lines"), F.sum("out_lines")
    return cleaned.agg(i.cast("long").alias("in_lines"), o.cast("long").alias("out_lines"), F.round(100 * (1 - o / F.greatest(i, F.lit(1))), 6).alias("shrink_percent"))


def thin_files(cleaned: DataFrame, least: int = 5) -> DataFrame:
    """Files with fewer than `least` paragraphs."""
    n = F.size(F.filter(F.split("text", "\n\n", -1), lambda p: T.strip(p) != ""))
    return cleaned.select("source", n.alias("paragraphs")).where(F.col("paragraphs") < least)
