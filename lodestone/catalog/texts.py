"""Line and text operators over all documents.  Documents have no blank lines, so a line is the paragraph here."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.catalog import ORACLES, query, strip_sql, tokens_sql
from lodestone.catalog.search import chunks
from lodestone.functions import text as T
from lodestone.operators import chunking as K
from lodestone.operators import cleaning as L
from lodestone.operators import table_function
from lodestone.tables import consecutive_ids

LINE = "\n"


def pages(spark, sf_dir):
    """Documents as pages: a page for each document of a source."""
    return chunks(spark, sf_dir).select("id", "source", F.col("id").alias("page"), "text", "disaster_type")


def lines(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", "source", F.posexplode(T.split_blocks(F.col("text"), LINE)).alias("line_no", "line"))


def _joined(column) -> F.Column:
    return F.md5(F.array_join(column, "\n").cast("binary"))


STRIPPED = strip_sql("x")
LINES = rf"""
parts AS (SELECT doc_id AS id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIPPED}), lambda x: x <> '') AS ls FROM documents),
lines AS (SELECT id, source, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM parts),
described AS (SELECT *, len({tokens_sql("line")}) AS n, array_to_string({tokens_sql("line")}, ' ') AS norm FROM lines)
"""
_WORDS = "len(regexp_extract_all(line, '[^\\s\\p{Z}]+'))"
_ALPHA = "regexp_extract_all(line, '[A-Za-z][A-Za-z''-]*')"
HEADING = f"""CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN TRUE WHEN regexp_matches(line, '^[-*•]') THEN FALSE WHEN n = 0 OR n > 10 THEN FALSE
  WHEN regexp_matches(line, '[.!]$') THEN FALSE WHEN regexp_matches(line, '[:?]$') THEN TRUE WHEN regexp_matches(line, '^\\d+\\.\\s+\\S') AND n <= 6 THEN TRUE
  WHEN len({_ALPHA}) = 0 THEN FALSE ELSE len(list_filter({_ALPHA}, lambda w: regexp_matches(w, '^[A-Z]'))) / len({_ALPHA}) >= 0.5 END"""
MARKED = f"{LINES}, marked AS (SELECT *, {HEADING} AS heading FROM described)"
ENDS = "regexp_matches(line, '[.!?:]$')"
PARAGRAPH = f"({_WORDS} >= 15 OR {ENDS})"
FRAGMENT = f"(line IN ({', '.join(repr(x) for x in C.LINK_EXACT)}) OR {' OR '.join(f'contains(line, {m!r})' for m in C.LINK_MARKERS)} OR ({_WORDS} < 10 AND NOT {ENDS}))"


@query(f"WITH {MARKED} SELECT id, CAST(line_no AS BIGINT) AS line_no, heading FROM marked")
def heading_flags(spark, sf_dir):
    return lines(spark, sf_dir).select("id", F.col("line_no").cast("long").alias("line_no"), T.is_heading(F.col("line")).alias("heading"))


@query(f"WITH {LINES} SELECT id, CAST(line_no AS BIGINT) AS line_no, {PARAGRAPH} AS paragraph, {FRAGMENT} AS link_fragment FROM lines")
def line_predicates(spark, sf_dir):
    x = F.col("line")
    return lines(spark, sf_dir).select("id", F.col("line_no").cast("long").alias("line_no"), T.is_paragraph(x).alias("paragraph"), T.is_link_fragment(x).alias("link_fragment"))


@query(f"WITH {LINES} SELECT id, CAST(min(line_no) AS BIGINT) AS line_no, md5(norm) AS norm FROM described WHERE norm <> '' GROUP BY id, norm")
def line_dedupe_exact(spark, sf_dir):
    """The first of a document's lines with equal norms."""
    d = lines(spark, sf_dir).select("id", "line_no", F.col("line").alias("text")).where(T.normal(F.col("text")) != "")
    return K.drop_repeats(d, ["id"], ["line_no"]).select("id", F.col("line_no").cast("long").alias("line_no"), F.md5(T.normal(F.col("text")).cast("binary")).alias("norm"))


DEDUPED = f"""{MARKED},
solid AS (SELECT * FROM marked WHERE norm <> ''),
contained AS (SELECT DISTINCT a.id, a.line_no FROM solid a JOIN solid b ON a.id = b.id AND b.line_no < a.line_no AND a.n >= 8 AND NOT a.heading AND b.n >= 12 AND contains(b.norm, a.norm)),
open AS (SELECT s.* FROM solid s ANTI JOIN contained c USING (id, line_no)),
exact AS (SELECT DISTINCT a.id, a.line_no FROM solid a JOIN open b ON a.id = b.id AND b.line_no < a.line_no AND a.n >= 8 AND a.norm = b.norm),
kept AS (SELECT o.* FROM open o ANTI JOIN exact e USING (id, line_no))
"""


@query(f"WITH {DEDUPED} SELECT id, count(*) AS n_kept, md5(string_agg(line, chr(10) ORDER BY line_no)) AS kept FROM kept GROUP BY id")
def line_dedupe_contained(spark, sf_dir):
    """Lines that stay when a document's lines are deduplicated as paragraphs."""
    d = pages(spark, sf_dir).withColumn("_d", K.described(T.split_blocks(F.col("text"), LINE))).withColumn("_k", K.dedupe_paragraphs(F.col("_d")))
    return d.select("id", F.size("_k").cast("long").alias("n_kept"), _joined(F.col("_k.text")).alias("kept")).where("n_kept > 0")


SECTIONED = f"""{DEDUPED},
numbered AS (SELECT *, sum(CAST(heading AND before > 0 AS INTEGER)) OVER (PARTITION BY id ORDER BY line_no) AS section_no
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) - 1 AS before FROM kept)),
sections AS (SELECT id, section_no, string_agg(line, chr(10) || chr(10) ORDER BY line_no) AS section, sum(n) AS tokens FROM numbered GROUP BY id, section_no)
"""


@query(f"WITH {SECTIONED} SELECT id, CAST(section_no AS BIGINT) AS section_no, md5(section) AS section FROM sections")
def section_ids(spark, sf_dir):
    d = K.section_texts(pages(spark, sf_dir), separator=LINE, least=0).select("id", F.posexplode("sections").alias("section_no", "section"))
    return d.select("id", F.col("section_no").cast("long").alias("section_no"), F.md5(F.col("section").cast("binary")).alias("section"))


MERGED = f"""{SECTIONED},
ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section_no) AS k, count(*) OVER (PARTITION BY id) AS m FROM sections),
folded AS (
  SELECT id, k, m, 0 AS grp, tokens AS acc, tokens >= 80 AS closed FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.id, o.k, o.m, CASE WHEN f.closed THEN f.grp + 1 ELSE f.grp END, CASE WHEN f.closed THEN o.tokens ELSE f.acc + o.tokens END,
         CASE WHEN f.closed THEN o.tokens ELSE f.acc + o.tokens END >= 80
  FROM folded f JOIN ordered o ON o.id = f.id AND o.k = f.k + 1),
placed AS (SELECT *, max(grp) OVER (PARTITION BY id) AS last, max(CASE WHEN k = m THEN CAST(closed AS INTEGER) END) OVER (PARTITION BY id) AS whole FROM folded),
merged AS (SELECT p.id, CASE WHEN grp = last AND whole = 0 AND last > 0 THEN grp - 1 ELSE grp END AS part_no, string_agg(section, chr(10) || chr(10) ORDER BY p.k) AS part
  FROM placed p JOIN ordered o ON o.id = p.id AND o.k = p.k GROUP BY ALL)
"""


@query(f"WITH RECURSIVE {MERGED} SELECT id, CAST(part_no AS BIGINT) AS part_no, md5(part) AS part FROM merged")
def short_section_merge(spark, sf_dir):
    d = K.section_texts(pages(spark, sf_dir), separator=LINE).select("id", F.posexplode("sections").alias("part_no", "part"))
    return d.select("id", F.col("part_no").cast("long").alias("part_no"), F.md5(F.col("part").cast("binary")).alias("part"))


WINDOWS = f"""tok AS (SELECT doc_id AS id, {tokens_sql("text")} AS t FROM documents),
windows AS (SELECT id, piece_no, array_to_string(list_slice(t, piece_no * 270 + 1, piece_no * 270 + 300), ' ') AS piece
  FROM (SELECT id, t, unnest(generate_series(0, greatest(0, CAST(ceil((len(t) - 300) / 270) AS BIGINT)))) AS piece_no FROM tok WHERE len(t) > 0))"""


def _windows(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", F.posexplode(K.token_windows(F.col("text"))).alias("piece_no", "piece"))


@query(f"WITH {WINDOWS} SELECT id, piece_no, md5(piece) AS piece FROM windows")
def window_chunks_300_30(spark, sf_dir):
    return _windows(spark, sf_dir).select("id", F.col("piece_no").cast("long").alias("piece_no"), F.md5(F.col("piece").cast("binary")).alias("piece"))


@query(f"WITH {WINDOWS} SELECT id, piece_no, len(string_split(piece, ' ')) >= 40 AS kept FROM windows")
def low_content_filter(spark, sf_dir):
    return _windows(spark, sf_dir).select("id", F.col("piece_no").cast("long").alias("piece_no"), (T.token_count(F.col("piece")) >= C.MIN_MEANINGFUL_TOKENS).alias("kept"))


CHUNKS = f"""{MERGED},
cut AS (SELECT id, part_no, k, list_slice(t, k * 270 + 1, k * 270 + 300) AS w
  FROM (SELECT id, part_no, t, unnest(generate_series(0, greatest(0, CAST(ceil((len(t) - 300) / 270) AS BIGINT)))) AS k FROM (SELECT *, {tokens_sql("part")} AS t FROM merged) WHERE len(t) > 0)),
told AS (SELECT *, row_number() OVER (PARTITION BY id, part_no ORDER BY k) - 1 AS r FROM (SELECT *, lag(w) OVER (PARTITION BY id, part_no ORDER BY k) AS before FROM cut) WHERE before IS NULL OR w <> before),
pieces AS (SELECT id, part_no, CASE WHEN len(w) < {C.MIN_SECTION_TOKENS} AND r > 0 THEN r - 1 ELSE r END AS piece_no, string_agg(array_to_string(w, ' '), chr(10) || chr(10) ORDER BY r) AS text FROM told GROUP BY ALL),
chunks AS (
  SELECT source, lang, id AS page, part_no AS section_no, piece_no, text,
         CASE WHEN {" OR ".join(f"contains(lower(text), '{p}')" for p in C.OVERRIDE_PHRASES["earthquake"])} THEN 'earthquake' ELSE 'general' END AS disaster_type
  FROM (SELECT p.*, d.source, d.lang, row_number() OVER (PARTITION BY d.source, array_to_string({tokens_sql("p.text")}, ' ') ORDER BY p.id, part_no, piece_no) AS nth
        FROM pieces p JOIN documents d ON d.doc_id = p.id WHERE len({tokens_sql("p.text")}) >= {C.MIN_MEANINGFUL_TOKENS}) WHERE nth = 1)
"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT source, page, CAST(section_no AS INTEGER) AS section_no, CAST(piece_no AS INTEGER) AS piece_no, md5(text) AS text, disaster_type FROM chunks")
def chunk_emit(spark, sf_dir):
    """The chunks of all documents with token windows as the splitter."""
    out = K.chunk_pages(pages(spark, sf_dir), split=K.token_windows, separator=LINE)
    return out.select("source", "page", "section_no", "piece_no", F.md5(F.col("text").cast("binary")).alias("text"), "disaster_type")


def _pieces(spark, sf_dir):
    return K.folded_pieces(pages(spark, sf_dir), split=K.token_windows, separator=LINE)


@query(f"WITH RECURSIVE {CHUNKS} SELECT id AS page, CAST(part_no AS INTEGER) AS section_no, CAST(piece_no AS INTEGER) AS piece_no, md5(text) AS text FROM pieces")
def tail_fold(spark, sf_dir):
    """All pieces after folding, before any is dropped."""
    return _pieces(spark, sf_dir).select("page", "section_no", "piece_no", F.md5(F.col("text").cast("binary")).alias("text"))


@query(
    f"""WITH RECURSIVE {CHUNKS}, normed AS (SELECT source, array_to_string({tokens_sql("p.text")}, ' ') AS norm, len({tokens_sql("p.text")}) < {C.MIN_MEANINGFUL_TOKENS} AS few FROM pieces p JOIN documents d ON d.doc_id = p.id),
    each AS (SELECT source, norm, bool_and(few) AS few, count(*) AS n FROM normed GROUP BY source, norm)
    SELECT source, CAST(sum(n) AS BIGINT) AS pieces, count(*) FILTER (NOT few) AS chunks, count(*) FILTER (few) AS short, CAST(sum(n - 1) AS BIGINT) AS repeated FROM each GROUP BY source"""
)
def chunk_report(spark, sf_dir):
    """What becomes of each source's pieces."""
    return K.chunk_report(_pieces(spark, sf_dir))


@query()
def chunk_emit_recursive(spark, sf_dir):
    """The chunks of all documents with the recursive splitter."""
    out = K.chunk_pages(pages(spark, sf_dir), separator=LINE)
    return out.select("source", "page", "section_no", "piece_no", F.md5(F.col("text").cast("binary")).alias("text"), "disaster_type")


@query("SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS chunk_id, source, doc_id AS id FROM documents")
def ordered_chunk_ids(spark, sf_dir):
    return consecutive_ids(chunks(spark, sf_dir).select("source", "id"), [F.col("source"), F.col("id")], "chunk_id").select("chunk_id", "source", "id")


@query(f"WITH {LINES}, firsts AS (SELECT id, min(line_no) AS first FROM lines WHERE {PARAGRAPH} GROUP BY id) SELECT id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM lines JOIN firsts USING (id) WHERE line_no >= first GROUP BY id")
def strip_top_toc(spark, sf_dir):
    body = L.strip_top_contents(T.split_blocks(F.col("text"), LINE))
    return chunks(spark, sf_dir).withColumn("_b", body).where(F.size("_b") > 0).select("id", F.size("_b").cast("long").alias("n_lines"), _joined(F.col("_b")).alias("body"))


@query(
    f"""WITH {LINES},
    ends AS (SELECT id, max(line_no) AS bottom, coalesce(max(line_no) FILTER ({ENDS}), -1) AS closing FROM lines GROUP BY id),
    enters AS (SELECT l.id, NOT {PARAGRAPH} AND {FRAGMENT} AS cut FROM lines l JOIN ends e ON e.id = l.id AND l.line_no = e.bottom),
    kept AS (SELECT l.* FROM lines l JOIN ends USING (id) JOIN enters USING (id) WHERE NOT cut OR line_no <= closing)
    SELECT id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM kept GROUP BY id"""
)
def cut_trailing_links(spark, sf_dir):
    body = L.cut_trailing_links(T.split_blocks(F.col("text"), LINE))
    return chunks(spark, sf_dir).withColumn("_b", body).where(F.size("_b") > 0).select("id", F.size("_b").cast("long").alias("n_lines"), _joined(F.col("_b")).alias("body"))


@query(
    f"""WITH {LINES}, ends AS (SELECT id, coalesce(max(line_no) FILTER ({ENDS}), -1) AS closing FROM lines GROUP BY id)
    SELECT id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM lines JOIN ends USING (id) WHERE line_no <= closing GROUP BY id"""
)
def cut_trailing_chrome(spark, sf_dir):
    body = L.cut_trailing_chrome(T.split_blocks(F.col("text"), LINE))
    return chunks(spark, sf_dir).withColumn("_b", body).where(F.size("_b") > 0).select("id", F.size("_b").cast("long").alias("n_lines"), _joined(F.col("_b")).alias("body"))


@query(
    r"""SELECT doc_id AS id, CASE WHEN length(one) > 220 THEN substr(one, 1, 220) || '...' ELSE one END AS snippet,
    CASE WHEN length(flat) > 220 THEN rtrim(substr(flat, 1, 219)) || '...' ELSE flat END AS card
    FROM (SELECT doc_id, replace(text, chr(10), ' ') AS one, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS flat FROM documents)"""
)
def snippets(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", T.snippet(F.col("text")).alias("snippet"), T.card_snippet(F.col("text")).alias("card"))


@query("SELECT doc_id AS id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(173), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS text FROM documents")
def clean_text(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", F.md5(T.clean(F.col("text"), normal_form=False).cast("binary")).alias("text"))


@query()
def clean_nfkc(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", F.md5(T.clean(F.col("text")).cast("binary")).alias("text"))


@query("SELECT doc_id AS id, coalesce(CASE WHEN contains(lower(text), 'flood') THEN 'flood' END, 'none') AS tag FROM documents")
def phrase_tag(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", F.coalesce(T.first_tag(F.col("text"), {"flood": ("flood",)}), F.lit("none")).alias("tag"))


@query()
def tokenizer_windows_300_30(spark, sf_dir):
    """Windows of 300 ids of a public tokenizer, 30 of them shared, over all documents."""
    import public_tokenizers

    cut = K.tokenizer_windows(public_tokenizers.path("word_bpe_49k.json"))(F.col("text"))
    pieces = chunks(spark, sf_dir).select("id", F.posexplode(cut).alias("piece_no", "w"))
    return pieces.select("id", "piece_no", "w.start", "w.end", "w.n", F.md5(F.col("w.text").cast("binary")).alias("piece"))


@query(ORACLES["chunk_emit"])
def chunk_table_function(spark, sf_dir):
    """The rows of chunk_emit by one SQL statement over the documents."""
    table_function.register(spark)
    chunks(spark, sf_dir).select(F.col("id").alias("doc_id"), "source", "text").createOrReplaceTempView("documents_to_chunk")
    anchors = " OR ".join(f"contains(lower(text), '{p}')" for p in C.OVERRIDE_PHRASES["earthquake"])
    return spark.sql(
        f"""SELECT source, page, section_no, piece_no, md5(CAST(text AS BINARY)) AS text, CASE WHEN {anchors} THEN 'earthquake' ELSE 'general' END AS disaster_type
        FROM (
          SELECT d.source, c.doc_id AS page, c.section_no, c.piece_no, c.text, row_number() OVER (PARTITION BY d.source, xxhash64(c.norm), c.norm ORDER BY c.doc_id, c.section_no, c.piece_no) AS nth
          FROM chunk_documents(TABLE(SELECT doc_id, text FROM documents_to_chunk) PARTITION BY (doc_id), 300, 30) c JOIN documents_to_chunk d ON d.doc_id = c.doc_id
          WHERE c.tokens >= {C.MIN_MEANINGFUL_TOKENS})
        WHERE nth = 1"""
    )
