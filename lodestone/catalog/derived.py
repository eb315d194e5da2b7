"""Operators whose input the standard tables lack, over rows derived from those tables: model replies and answers from
conversations, raw scrapes and sidecars from documents, addresses from pages, features from suppliers, words from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.catalog import ORACLES, Derived, query, strip_sql, tokens_sql
from lodestone.functions import text as T
from lodestone.operators import chunking as K
from lodestone.operators import cleaning as L
from lodestone.operators import evaluation as E
from lodestone.operators import generation as G
from lodestone.operators import layout as P
from lodestone.operators import parsing as Q
from lodestone.operators.tagging import tag_of
from lodestone.sources import files as S
from lodestone.streaming.frames import EVENTS as EVENTS_OF_STREAMS
from lodestone.streaming.frames import assembled_events
from lodestone.tables import workspace

# --- parsing ----------------------------------------------------------------------------------------------------------

TAGS = ["earthquake", "extreme_heat", "flood", "general", "home_fire", "hurricane", "power_outage", "tornado", "tsunami", "wildfire", "winter_weather"]
_ID = "conv_id * 1000 + turn"
#: A turn's text on one line, without what JSON would have to escape.
_FLAT = "substr(replace(replace(replace(text, chr(10), ' '), chr(34), ''), chr(92), ''), 1, 160)"
_QUERY = f"""CASE ({_ID}) % 11 WHEN 0 THEN {_FLAT} || ' a twister is coming' WHEN 1 THEN 'Flash flood near a house fire ' || {_FLAT} WHEN 2 THEN ' no power  ' WHEN 3 THEN '   '
  WHEN 4 THEN 'FLOODING ' || {_FLAT} ELSE {_FLAT} END"""
#: Users' turns as queries, and what a parsing model might reply: valid and broken JSON, known and unknown tags, nothing.
REPLIES = Derived(
    "conversations",
    "role = 'user'",
    id=_ID,
    query=_QUERY,
    raw=f"""CASE ({_ID}) % 9 WHEN 0 THEN '{{"normalized": "' || {_FLAT} || '", "disaster_type": "earthquake"}}' WHEN 1 THEN 'Sure: {{"normalized": " ' || {_FLAT} || ' ", "disaster_type": null}} done'
  WHEN 2 THEN '{{"normalized": "x", "disaster_type": "zombie"}}' WHEN 3 THEN '{{"normalized": "   ", "disaster_type": "flood"}}' WHEN 4 THEN '{{"normalized": "' || {_FLAT} || ' twister", "disaster_type": "general"}}'
  WHEN 5 THEN 'normalized: ' || {_FLAT} WHEN 6 THEN '{{"normalized": "' || {_FLAT} WHEN 7 THEN '{{"normalized": 5, "disaster_type": 7}}' END""",
)
#: Documents as chunks with the tags of the index.
TAGGED = Derived("documents", id="doc_id", disaster_type=f"CASE doc_id % {len(TAGS)} {' '.join(f'WHEN {i} THEN {t!r}' for i, t in enumerate(TAGS))} END")
_TAG_LIST = ", ".join(f"'{t}'" for t in TAGS)
_VALID = rf"""
found AS (SELECT *, TRY_CAST(nullif(regexp_extract(coalesce(raw, ''), '\{{.*\}}', 0, 's'), '') AS JSON) AS j FROM {REPLIES.sql}),
typed AS (SELECT *, j ->> '$.normalized' AS n, j ->> '$.disaster_type' AS t, coalesce(json_type(j, '$.normalized'), 'NULL') AS nk, coalesce(json_type(j, '$.disaster_type'), 'NULL') AS tk FROM found),
valid AS (SELECT *, j IS NOT NULL AND nk = 'VARCHAR' AND {strip_sql("coalesce(n, '')")} <> '' AND (tk = 'NULL' OR (tk = 'VARCHAR' AND t IN ({_TAG_LIST}))) AS ok FROM typed)
"""


@query(f"WITH {_VALID} SELECT id, ok, CASE WHEN ok THEN {strip_sql('n')} END AS normalized, CASE WHEN ok AND t <> 'general' THEN t END AS disaster_type FROM valid")
def parse_json_validate(spark, sf_dir):
    v = Q.validate(F.coalesce("raw", F.lit("")), F.array(*map(F.lit, TAGS)))
    return REPLIES.frame(spark, sf_dir).select("id", v.alias("v")).select("id", F.col("v").isNotNull().alias("ok"), "v.normalized", "v.disaster_type")


def synonym_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {a!r})' for a in alternates)} THEN '{tag}'" for tag, alternates in C.SYNONYMS.items()) + " END"


@query(f"SELECT id, {synonym_sql('query')} AS tag FROM {REPLIES.sql}")
def synonym_tagging(spark, sf_dir):
    return REPLIES.frame(spark, sf_dir).select("id", T.first_tag(F.col("query"), C.SYNONYMS).alias("tag"))


APPENDS = Derived("conversations", "role = 'user'", id=_ID, text=_QUERY, tag=f"CASE ({_ID}) % 4 WHEN 0 THEN 'power_outage' WHEN 1 THEN 'flood' WHEN 2 THEN 'earthquake' END")


@query(f"SELECT id, CASE WHEN tag IS NULL OR contains(lower(text), lower(tag)) THEN text ELSE text || ' ' || tag END AS text FROM {APPENDS.sql}")
def canonical_backfill(spark, sf_dir):
    return APPENDS.frame(spark, sf_dir).select("id", T.append_canonical(F.col("text"), F.col("tag")).alias("text"))


@query(
    f"""WITH {_VALID},
    texts AS (SELECT *, {strip_sql("query")} AS original, CASE WHEN ok THEN {strip_sql("n")} ELSE {strip_sql("query")} END AS body FROM valid),
    tagged AS (SELECT *, CASE WHEN ok THEN coalesce(CASE WHEN t <> 'general' THEN t END, {synonym_sql("body")}) END AS tag FROM texts)
    SELECT id AS query_id, CASE WHEN original = '' THEN query ELSE original END AS original,
      CASE WHEN original = '' THEN query WHEN tag IS NULL OR contains(lower(body), lower(tag)) THEN body ELSE body || ' ' || tag END AS rewritten,
      CASE WHEN original <> '' THEN tag END AS disaster_type FROM tagged"""
)
def parse_query_rules(spark, sf_dir):
    return Q.parse_queries(REPLIES.frame(spark, sf_dir).withColumnRenamed("id", "query_id"), TAGGED.frame(spark, sf_dir))


@query(f"SELECT tag FROM (VALUES {', '.join(f'({t!r})' for t in C.SYNONYMS)}) s(tag) WHERE tag NOT IN (SELECT disaster_type FROM {TAGGED.sql} WHERE disaster_type <> 'tsunami')")
def synonym_audit(spark, sf_dir):
    return Q.unknown_synonyms(TAGGED.frame(spark, sf_dir).where("disaster_type <> 'tsunami'"))


#: Documents' languages as expected and as found.
LABELLED = Derived("documents", expected="CASE WHEN doc_id % 11 > 0 THEN lang END", predicted="CASE WHEN doc_id % 5 = 0 THEN 'xx' WHEN doc_id % 7 > 0 THEN lang END")


@query(f"SELECT count(*) AS labelled, round(avg(CASE WHEN expected = predicted THEN 1 ELSE 0 END), 6) AS accuracy FROM {LABELLED.sql} WHERE expected IS NOT NULL")
def tag_accuracy(spark, sf_dir):
    return E.accuracy(LABELLED.frame(spark, sf_dir))


# --- answers ----------------------------------------------------------------------------------------------------------

_CANNED = C.LOW_CONFIDENCE_MESSAGE
_BREAK = "chr(10) || chr(10)"
#: Assistants' turns as cited answers, with lists, marks at the beginning, the no-answer sentence.
ANSWERS = Derived(
    "conversations",
    "role <> 'user'",
    id=_ID,
    text=f"""CASE ({_ID}) % 13 WHEN 1 THEN text || ' [1].' WHEN 3 THEN text || ' [42] [a] [1.5] [ 1 ] [2][3]' WHEN 5 THEN '[1][2] [3]' || chr(10) || text WHEN 7 THEN text || ' [1].  {_CANNED}' || {_BREAK} || {_BREAK} || 'Then wait [2].'
  WHEN 9 THEN 'Do this:' || {_BREAK} || '- ' || replace(text, chr(10), chr(10) || '- ') || {_BREAK} || '1. first [9]' || chr(10) || '2. second' || {_BREAK} || '- lonely [0]' WHEN 11 THEN '{_CANNED}' WHEN 12 THEN '  ' || chr(10) ELSE text END""",
)


@query(f"SELECT id, regexp_matches(text, '\\[[0-9]+\\]') AS cited FROM {ANSWERS.sql}")
def citation_markers(spark, sf_dir):
    return ANSWERS.frame(spark, sf_dir).select("id", T.has_citation(F.col("text")).alias("cited"))


@query(
    f"""SELECT id, CASE WHEN regexp_matches(text, '\\[[0-9]+\\]') AND contains(text, '{_CANNED}')
    THEN {strip_sql(f"regexp_replace(regexp_replace(replace(text, '{_CANNED}', ''), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")} ELSE text END AS text FROM {ANSWERS.sql}"""
)
def canned_strip(spark, sf_dir):
    return ANSWERS.frame(spark, sf_dir).select("id", T.strip_canned(F.col("text")).alias("text"))


@query(f"SELECT id, regexp_replace(text, '^\\s*(\\[[0-9]+\\]\\s*)+\\n', '') AS text FROM {ANSWERS.sql}")
def leading_citation_strip(spark, sf_dir):
    return ANSWERS.frame(spark, sf_dir).select("id", T.strip_leading_citations(F.col("text")).alias("text"))


@query(
    f"""WITH b AS (SELECT id, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS block_no FROM (SELECT id, list_filter(regexp_split_to_array({strip_sql("text")}, '\\n{{2,}}'), lambda x: x <> '') AS bs FROM {ANSWERS.sql})),
    l AS (SELECT *, list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM b),
    k AS (SELECT *, CASE WHEN len(ls) > 1 AND len(list_filter(ls, lambda x: regexp_matches(x, '^[-*]\\s+'))) = len(ls) THEN 'bullets'
                         WHEN len(ls) > 1 AND len(list_filter(ls, lambda x: regexp_matches(x, '^[0-9]+\\.\\s+'))) = len(ls) THEN 'numbered' ELSE 'paragraph' END AS kind FROM l)
    SELECT id, CAST(block_no AS BIGINT) AS block_no, kind, CASE WHEN kind = 'paragraph' THEN array_to_string(ls, ' ')
      WHEN kind = 'bullets' THEN array_to_string(list_transform(ls, lambda x: regexp_replace(x, '^[-*]\\s+', '')), '|')
      ELSE array_to_string(list_transform(ls, lambda x: regexp_replace(x, '^[0-9]+\\.\\s+', '')), '|') END AS items FROM k"""
)
def answer_block_types(spark, sf_dir):
    b = ANSWERS.frame(spark, sf_dir).select("id", F.posexplode(T.answer_blocks(F.col("text"))).alias("block_no", "b"))
    return b.select("id", F.col("block_no").cast("long").alias("block_no"), "b.kind", F.array_join("b.items", "|").alias("items"))


@query(f"SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS INTEGER)), lambda n: n >= 1 AND n <= 3), ',') AS links FROM {ANSWERS.sql}")
def inline_citation_links(spark, sf_dir):
    return ANSWERS.frame(spark, sf_dir).select("id", F.array_join(F.transform(T.linked_citations(F.col("text"), F.lit(3)), lambda n: n.cast("string")), ",").alias("links"))


PATHS = Derived("pages", id="page_id", path="CASE page_id % 5 WHEN 0 THEN replace(url, '/', chr(92)) WHEN 1 THEN url || '/' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE url END")


@query(f"SELECT id, list_last(regexp_split_to_array(coalesce(path, ''), '[\\\\/]')) AS name FROM {PATHS.sql}")
def basenames(spark, sf_dir):
    return PATHS.frame(spark, sf_dir).select("id", T.basename(F.col("path")).alias("name"))


#: Conversations as event streams: turns are their tokens, the first one is the meta event.
EVENTS = Derived(
    "conversations",
    query_id="conv_id",
    seq="CAST(turn AS INT)",
    type="CASE WHEN turn = 0 THEN 'meta' WHEN role = 'system' THEN 'done' ELSE 'token' END",
    text="CASE WHEN turn > 0 AND role <> 'system' THEN text END",
    gated="CASE WHEN turn = 0 THEN conv_id % 2 = 0 END",
    top_score="CASE WHEN turn = 0 AND conv_id % 3 > 0 THEN CAST(conv_id % 8 AS DOUBLE) / 8 END",
)


@query(
    f"""SELECT query_id, seq, 'data: ' || '{{"type":' || to_json(type) || coalesce(',"text":' || to_json(text), '') || coalesce(',"gated":' || to_json(gated), '')
    || coalesce(',"top_score":' || to_json(top_score), '') || ',"citations":[]}}' || chr(10) || chr(10) AS frame FROM {EVENTS.sql}"""
)
def sse_frames(spark, sf_dir):
    return G.sse_frames(EVENTS.frame(spark, sf_dir).withColumn("citations", F.array().cast("array<string>")))


_BODY = f"""': note' || chr(10) || 'data: {{"type": "meta", "gated": false, "top_score": 0.5}}' || {_BREAK} || 'data: {{"type": "token", "text": "' || {_FLAT} || '"}}' || {_BREAK} || 'data: {{"type": "done"}}' || {_BREAK}"""
#: Streams that may be cut anywhere near their end.
STREAMS = Derived("conversations", stream_id=_ID, body=f"substr({_BODY}, 1, CAST(length({_BODY}) - ({_ID}) % 40 AS INT))")


@query(
    f"""WITH l AS (SELECT stream_id, unnest(ls[:-2]) AS line, generate_subscripts(ls[:-2], 1) - 1 AS line_no FROM (SELECT stream_id, string_split(body, chr(10)) AS ls FROM {STREAMS.sql}))
    SELECT stream_id, CAST(line_no AS INTEGER) AS line_no, j ->> '$.type' AS type, j ->> '$.text' AS text, CAST(j ->> '$.gated' AS BOOLEAN) AS gated, CAST(j ->> '$.top_score' AS DOUBLE) AS top_score
    FROM (SELECT *, CAST(substr(line, 7) AS JSON) AS j FROM l WHERE starts_with(line, 'data: '))"""
)
def sse_parse(spark, sf_dir):
    return G.parse_sse(STREAMS.frame(spark, sf_dir))


@query(ORACLES["sse_parse"])
def sse_stream_parse(spark, sf_dir):
    """The same streams cut into pieces of seven bytes, as they arrive in two parts, with a restart of the query in between."""
    at = workspace(spark, "pieces")
    body = F.encode("body", "UTF-8")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("body"), F.lit(1)) - 1) / 7)), lambda k: F.substring(body, (k * 7 + 1).cast("int"), F.lit(7)))
    pieces = STREAMS.frame(spark, sf_dir).select("stream_id", F.posexplode(cut).alias("seq", "piece")).withColumn("seq", F.col("seq").cast("long"))
    for part in (0, 1):  # a stream's pieces are dealt out by hash, so that many come before those that precede them
        pieces.where(F.pmod(F.xxhash64("stream_id", "seq"), F.lit(2)) == part).write.mode("append").parquet(f"{at}/in")
        events = assembled_events(spark.readStream.schema(pieces.schema).parquet(f"{at}/in"))
        events.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(EVENTS_OF_STREAMS).parquet(f"{at}/out")


BODIES = Derived("conversations", request_id=_ID, body=f"""CASE ({_ID}) % 6 WHEN 0 THEN '{{"query": " ' || {_FLAT} || ' "}}' WHEN 1 THEN '{{"query": "  "}}' WHEN 2 THEN '{{}}' WHEN 3 THEN {_FLAT} WHEN 4 THEN '{{"query": "' || {_FLAT} ELSE '{{"query": "x", "y": 1}}' END""")


@query(
    f"""SELECT request_id, CASE WHEN error IS NULL THEN q END AS query, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status, error FROM (
    SELECT *, CASE WHEN j IS NULL THEN 'invalid json' WHEN q = '' THEN 'query required' END AS error FROM (
    SELECT request_id, j, {strip_sql("coalesce(j ->> '$.query', '')")} AS q FROM (SELECT request_id, TRY_CAST(body AS JSON) AS j FROM {BODIES.sql})))"""
)
def request_validation(spark, sf_dir):
    return G.validate_requests(BODIES.frame(spark, sf_dir))


PAYLOADS = Derived(
    "conversations",
    request_id=_ID,
    body=f"""CASE ({_ID}) % 5 WHEN 0 THEN '{{"answer": "' || {_FLAT} || '", "citations": [1, 2], "gated": true, "confidence": 0.5}}' WHEN 1 THEN '{{"answer": 5, "citations": "no"}}' WHEN 2 THEN 'null' WHEN 3 THEN {_FLAT}
  ELSE '{{"answer": "' || {_FLAT} || '", "citations": [], "gated": false, "confidence": "high"}}' END""",
)


@query(
    f"""SELECT request_id, CASE WHEN json_type(j, '$.answer') = 'VARCHAR' THEN j ->> '$.answer' ELSE '' END AS answer,
    CASE WHEN json_type(j, '$.citations') = 'ARRAY' THEN CAST(json_array_length(j, '$.citations') AS INTEGER) ELSE 0 END AS n_citations,
    coalesce(CASE WHEN json_type(j, '$.gated') = 'BOOLEAN' THEN CAST(j ->> '$.gated' AS BOOLEAN) END, FALSE) AS gated,
    CASE WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(j ->> '$.confidence' AS DOUBLE) END AS confidence
    FROM (SELECT request_id, TRY_CAST(body AS JSON) AS j FROM {PAYLOADS.sql})"""
)
def response_normalizer(spark, sf_dir):
    return G.normalize_response(PAYLOADS.frame(spark, sf_dir))


STUB = {"earthquake": "earthquake|quake|shake", "water": "water|drink", "outage": "fridge|food|power|outage"}
ASKED = Derived("conversations", "role = 'user'", id=_ID, query=f"CASE ({_ID}) % 7 WHEN 0 THEN 'Will it SHAKE? ' || {_FLAT} WHEN 1 THEN {_FLAT} || ' water' WHEN 2 THEN 'fridge food' WHEN 3 THEN 'hi' WHEN 4 THEN 'quake water' ELSE {_FLAT} END")


@query(f"SELECT id, CASE WHEN length(query) < 3 THEN NULL {' '.join(f'WHEN regexp_matches(lower(query), {p!r}) THEN {k!r}' for k, p in STUB.items())} END AS route FROM {ASKED.sql}")
def stub_routing(spark, sf_dir):
    """Which canned answer a development stub gives; none is gated."""
    low, out = F.lower("query"), F.when(F.length("query") < 3, F.lit(None).cast("string"))
    for key, pattern in STUB.items():
        out = out.when(low.rlike(pattern), key)
    return ASKED.frame(spark, sf_dir).select("id", out.alias("route"))


# --- tags -------------------------------------------------------------------------------------------------------------

#: Documents under the names of known and unknown files, some with an anchor phrase.
FILES = Derived(
    "documents",
    id="doc_id",
    source="CASE doc_id % 9 WHEN 0 THEN 'ready_gov_floods.txt' WHEN 1 THEN 'ready_gov_' || lang || '.txt' WHEN 2 THEN 'red_cross_survival_kit.txt' WHEN 3 THEN 'wa_emd_tsunami.txt' WHEN 4 THEN 'When-an-Earthquake-Strikes.pdf' WHEN 5 THEN '2-Weeks-Ready-Community-Brochure-Build-Kits.pdf' WHEN 6 THEN 'ready_gov_floods.pdf' ELSE source || '.pdf' END",
    text="CASE doc_id % 4 WHEN 0 THEN text || ' What to do During the Shaking' WHEN 1 THEN 'Drop and Cover. ' || text ELSE text END",
)


def _tag_sql() -> str:
    out = "CASE "
    for prefix, table in C.TAGS_BY_SLUG.items():
        cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
        out += f"WHEN starts_with(source, '{prefix}') AND ends_with(source, '.txt') THEN CASE substr(source, {len(prefix) + 1}, length(source) - {len(prefix) + 4}) {cases} ELSE 'general' END "
    for tag, phrases in C.OVERRIDE_PHRASES.items():
        out += f"WHEN {' OR '.join(f'contains(lower(text), {p!r})' for p in phrases)} THEN '{tag}' "
    return out + "ELSE CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TAGS_BY_PDF.items()) + " ELSE 'general' END END"


@query(f"SELECT id, {_tag_sql()} AS tag FROM {FILES.sql}")
def source_tagging(spark, sf_dir):
    return FILES.frame(spark, sf_dir).select("id", tag_of(F.col("source"), F.col("text")).alias("tag"))


@query(f"SELECT id, {' OR '.join(f'contains(lower(text), {p!r})' for p in C.OVERRIDE_PHRASES['earthquake'])} AS promoted FROM {FILES.sql}")
def override_phrases(spark, sf_dir):
    return FILES.frame(spark, sf_dir).select("id", T.first_tag(F.col("text"), C.OVERRIDE_PHRASES).isNotNull().alias("promoted"))


# --- cleaning ---------------------------------------------------------------------------------------------------------

#: Documents as raw scrapes of the three dialects, with whole and broken headers, page chrome and blank lines.
RAW = Derived(
    "documents",
    id="doc_id",
    dialect="CASE doc_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'cross' ELSE 'emd' END",
    source="CASE WHEN doc_id = 2 THEN 'wa_emd_tsunami.txt' ELSE 'f' || doc_id || '.txt' END",
    text=f"""CASE WHEN doc_id % 17 = 0 THEN substr(text, 1, 40) ELSE ' About ' || lang || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'Someone' WHEN doc_id % 3 = 2 THEN '{C.EMD_AUTHOR}' ELSE 'Unknown' END || chr(10) || '3 Min read' || chr(10)
  || CASE WHEN doc_id % 7 = 0 THEN 'no address' ELSE 'https://example.org/' || doc_id END || chr(10) || chr(10) || 'Before' || chr(10) || replace(text, '. ', '.' || {_BREAK} || 'Unknown' || chr(10) || 'See [the plan](http://example.org/p) first.' || chr(10) || 'https://example.org/x' || {_BREAK} || chr(10))
  || chr(10) || 'Get the app at Google PlayTM now.' || chr(10) || 'Storm Toolkit' || chr(10) || 'More Info' || chr(10) END""",
)
_RAW_LINES = f"SELECT *, string_split(text, chr(10)) AS parts FROM {RAW.sql}"


@query(
    rf"""WITH l AS (SELECT id, dialect, CASE WHEN list_last(parts) = '' THEN parts[:-2] ELSE parts END AS ls FROM ({_RAW_LINES})),
    h AS (SELECT *, len(ls) >= 4 AS long, regexp_matches(coalesce(ls[4], ''), '^https?://\S+\s*$') AND (dialect = 'ready' OR
      (trim(ls[2]) = CASE dialect WHEN 'cross' THEN 'Unknown' ELSE 'efelle creative' END AND regexp_matches(trim(ls[3]), '(?i)^\d+\s+min\s+read$'))) AS header FROM l)
    SELECT id, CASE WHEN long THEN trim(ls[1]) ELSE '' END AS title, CAST(CASE WHEN long AND header THEN len(ls) - 4 ELSE len(ls) END AS INTEGER) AS n_lines FROM h"""
)
def strip_header(spark, sf_dir):
    rows = RAW.frame(spark, sf_dir).withColumn("_l", L.split_lines(F.col("text")))
    title, body = None, None
    for dialect in ("ready", "cross", "emd"):
        t, b = L.strip_header(F.col("_l"), dialect)
        title = F.when(F.col("dialect") == dialect, t) if title is None else title.when(F.col("dialect") == dialect, t)
        body = F.when(F.col("dialect") == dialect, b) if body is None else body.when(F.col("dialect") == dialect, b)
    return rows.select("id", title.alias("title"), F.size(body).alias("n_lines"))


@query()
def clean_scrapes(spark, sf_dir):
    """All documents as scrapes, cleaned each in its dialect."""
    ids = RAW.frame(spark, sf_dir).select("id", "source")
    out = None
    for dialect in ("ready", "cross", "emd"):
        rows = L.clean_scrapes(RAW.frame(spark, sf_dir).where(F.col("dialect") == dialect).select("source", "text"), dialect)
        out = rows if out is None else out.unionByName(rows)
    return out.join(ids, "source").select("id", "text", "in_lines", F.col("out_lines").cast("long").alias("out_lines"))


#: Documents as cleaned texts: paragraphs of their sentences, and lines before and after.
CLEANED = Derived(
    "documents",
    id="doc_id",
    text=f"'# ' || lang || {_BREAK} || replace(text, '. ', '.' || {_BREAK}) || chr(10)",
    in_lines="CAST(length(text) - length(replace(text, chr(10), '')) + 9 AS INT)",
    out_lines="CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT)",
)


@query(f"SELECT CAST(sum(in_lines) AS BIGINT) AS in_lines, CAST(sum(out_lines) AS BIGINT) AS out_lines, round(100 * (1 - sum(out_lines) / greatest(sum(in_lines), 1)), 6) AS shrink_percent FROM {CLEANED.sql}")
def shrinkage(spark, sf_dir):
    return L.shrinkage(CLEANED.frame(spark, sf_dir))


@query(f"SELECT id, CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {strip_sql('p')} <> '')) AS INTEGER) AS paragraphs FROM {CLEANED.sql} WHERE len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {strip_sql('p')} <> '')) < 5")
def thin_files(spark, sf_dir):
    return L.thin_files(CLEANED.frame(spark, sf_dir).withColumn("source", F.col("id"))).withColumnRenamed("source", "id")


_SPARSE = f"chr(10) || replace(replace(text, '. ', '.' || {_BREAK} || ' ' || {_BREAK}), ', ', ',' || chr(10) || chr(9) || chr(10)) || {_BREAK}"
#: Documents' lines with runs of blank ones between sentences, before and after.
BLANKS = Derived("documents", id="doc_id", lines=(f"split({_SPARSE}, chr(10))", f"string_split({_SPARSE}, chr(10))"))


@query(
    f"""WITH l AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM {BLANKS.sql}),
    m AS (SELECT *, {strip_sql("line")} = '' AS blank FROM l), n AS (SELECT *, lag(blank) OVER (PARTITION BY id ORDER BY k) AS before, min(k) FILTER (NOT blank) OVER (PARTITION BY id) AS a, max(k) FILTER (NOT blank) OVER (PARTITION BY id) AS b FROM m)
    SELECT i.id, coalesce(string_agg(CASE WHEN blank THEN '' ELSE line END, '|' ORDER BY k), '') AS lines FROM {BLANKS.sql} i LEFT JOIN n ON n.id = i.id AND k BETWEEN a AND b AND NOT (blank AND before) GROUP BY i.id"""
)
def collapse_blank_lines(spark, sf_dir):
    return BLANKS.frame(spark, sf_dir).select("id", F.array_join(L.collapse_blank_lines(F.col("lines")), "|").alias("lines"))


_E1, _E2 = C.EMD_SECTIONS["wa_emd_tsunami.txt"][0]
_MARKED = f"'top' || chr(10) || replace(replace(text, ', ', ',' || chr(10) || '{_E1}' || chr(10)), '. ', '.' || chr(10) || '{_E2}' || chr(10)) || chr(10) || 'Resources' || chr(10) || 'end'"
#: Documents as files of which two have blocks to skip.
SECTIONS = Derived("documents", id="doc_id", source="CASE doc_id % 3 WHEN 0 THEN 'wa_emd_tsunami.txt' WHEN 1 THEN 'wa_emd_hazard_mitigation_grants.txt' ELSE 'other.txt' END", lines=(f"split({_MARKED}, chr(10))", f"string_split({_MARKED}, chr(10))"))


@query(
    f"""WITH l AS (SELECT id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM {SECTIONS.sql}),
    s AS (SELECT id, min(line_no) AS a FROM l WHERE (source = 'wa_emd_tsunami.txt' AND line = '{_E1}') OR (source = 'wa_emd_hazard_mitigation_grants.txt' AND line = 'Resources') GROUP BY id),
    r AS (SELECT s.id, a, coalesce(min(line_no), 1000000) AS b FROM s LEFT JOIN l ON l.id = s.id AND line_no > a AND line = '{_E2}' AND source = 'wa_emd_tsunami.txt' GROUP BY ALL)
    SELECT l.id, md5(string_agg(line, '|' ORDER BY line_no)) AS lines FROM l LEFT JOIN r ON r.id = l.id WHERE r.a IS NULL OR line_no < a OR line_no >= b GROUP BY l.id"""
)
def skip_sections(spark, sf_dir):
    kept = L.skip_sections(F.col("lines"), L.sections_of(F.col("source")))
    return SECTIONS.frame(spark, sf_dir).select("id", F.md5(F.array_join(kept, "|").cast("binary")).alias("lines"))


# --- sources ----------------------------------------------------------------------------------------------------------

#: Documents as sidecars: a block for each sentence, some with a mark of their page.
SIDECARS = Derived(
    "documents",
    source="'s' || doc_id || '.md'",
    text=f"CASE doc_id % 4 WHEN 0 THEN '' ELSE '<!-- page: ' || (doc_id % 9 + 1) || ' -->' END || replace(replace(text, ', ', '  ' || chr(10) || {_BREAK}), '. ', '.' || chr(10) || '---' || chr(10) || '<!-- PAGE: 12 --> ') || chr(10) || '---  ' || chr(10) || '   ' || chr(10) || '---' || chr(10)",
)


@query(
    rf"""WITH p AS (SELECT source, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS block_no FROM (SELECT source, regexp_split_to_array(text, '(?m)^---\s*$') AS bs FROM {SIDECARS.sql})),
    m AS (SELECT *, regexp_extract(block, '(?i)<!--\s*page:\s*(\d+)\s*-->', 1) AS mark, regexp_replace(block, '(?i)<!--\s*page:\s*(\d+)\s*-->', '') AS bare FROM p),
    c AS (SELECT source, CAST(block_no AS INTEGER) AS block_no, CASE WHEN mark = '' THEN 1 ELSE CAST(mark AS INTEGER) END AS page, {strip_sql("regexp_replace(regexp_replace(bare, '[ \t]+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM m)
    SELECT * FROM c WHERE text <> ''"""
)
def sidecar_blocks(spark, sf_dir):
    return S.sidecar_blocks(SIDECARS.frame(spark, sf_dir), normal_form=False)


#: Documents as hand-made blocks: some repeat others of their source, some have an anchor phrase.
BLOCKS = Derived(
    "documents",
    source="source || '.pdf'",
    block_no="CAST(doc_id AS INT)",
    page="CAST(doc_id % 7 + 1 AS INT)",
    text="CASE doc_id % 5 WHEN 0 THEN 'Drop and cover in ' || lang WHEN 1 THEN 'DROP and cover, in ' || lang || '!' ELSE text END",
)


@query(
    f"""SELECT source, block_no, page, md5(text) AS text, {_tag_sql()} AS disaster_type
    FROM (SELECT *, row_number() OVER (PARTITION BY source, array_to_string({tokens_sql("text")}, ' ') ORDER BY block_no) AS nth FROM {BLOCKS.sql}) WHERE nth = 1"""
)
def sidecar_emit(spark, sf_dir):
    """A chunk for each block, the first of a source's equal ones."""
    out = K.chunk_blocks(BLOCKS.frame(spark, sf_dir))
    return out.select("source", "block_no", "page", F.md5(F.col("text").cast("binary")).alias("text"), "disaster_type")


#: All documents as files, and those with a label as sidecars.
PDFS = Derived("documents", source="'f' || doc_id", text="lang")
SIDES = Derived("labels", source="'f' || doc_id", text="'side'")


@query(f"SELECT source, text FROM {PDFS.sql} WHERE source NOT IN (SELECT source FROM {SIDES.sql})")
def source_precedence_anti(spark, sf_dir):
    return S.without_sidecar(PDFS.frame(spark, sf_dir), SIDES.frame(spark, sf_dir))


#: Documents as files of several folders, whose names differ in case only.
FOLDERS = Derived("documents", source="CASE doc_id % 2 WHEN 0 THEN 'File' || (doc_id % 97) || '.TXT' ELSE 'file' || (doc_id % 97) || '.txt' END", text="'text of ' || doc_id", rank="CAST((doc_id * 7919) % 100003 AS INT)")


@query(f"SELECT lower(source) AS source, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(source) ORDER BY rank, source) AS k FROM {FOLDERS.sql}) WHERE k = 1")
def multi_folder_first(spark, sf_dir):
    return S.first_of(FOLDERS.frame(spark, sf_dir))


def _feature(key: str, address: str) -> str:
    return f"""'{{"geometry": {{"coordinates": [-' || (s_suppkey % 180) || '.5, ' || (s_suppkey % 90) || '.25]}}, "properties": {{"OBJECTID": ' || ({key}) || ', "NAME": "' || s_name || '", "ADDRESS": {address}}}}}'"""


#: Suppliers as layers of two features each.
GEO = Derived("supplier", kind="CASE s_nationkey % 2 WHEN 0 THEN 'shelter' ELSE 'hospital' END", json=f"""'{{"features": [' || {_feature("s_suppkey", "null")} || ', ' || {_feature("s_suppkey + 1000000", '"1 Main St"')} || ']}}'""")


@query(
    f"""SELECT kind, CAST(f ->> '$.properties.OBJECTID' AS BIGINT) AS object_id, f ->> '$.properties.NAME' AS name, f ->> '$.properties.ADDRESS' AS address,
    CAST(f ->> '$.geometry.coordinates[1]' AS DOUBLE) AS lat, CAST(f ->> '$.geometry.coordinates[0]' AS DOUBLE) AS lng FROM (SELECT kind, unnest(CAST(CAST(json AS JSON) -> '$.features' AS JSON[])) AS f FROM {GEO.sql})"""
)
def geojson_points(spark, sf_dir):
    return S.geojson_points(GEO.frame(spark, sf_dir))


#: Customers as one feature each: points, lines, areas, or without geometry.
SHAPES = Derived(
    "customer",
    kind="CASE c_nationkey % 2 WHEN 0 THEN 'zone' ELSE 'route' END",
    json="""'{"features": [{"geometry": ' || CASE c_custkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{"type": "Point", "coordinates": [-' || (c_custkey % 180) || '.5,' || (c_custkey % 90) || '.25]}'
  WHEN 2 THEN '{"type": "LineString", "coordinates": [[' || (c_custkey % 180) || '.5,1.0],[-2.5,' || (c_custkey % 90) || '.0]]}' ELSE '{"type": "Polygon", "coordinates": [[[0.0,0.5],[4.0,0.5],[4.0,' || (c_custkey % 90 + 1) || '.0],[0.0,0.5]]]}' END
  || ', "properties": {"OBJECTID": "' || c_custkey || '", "NAME": "' || c_name || '"}}]}'""",
)


@query(
    f"""WITH f AS (SELECT kind, unnest(CAST(CAST(json AS JSON) -> '$.features' AS JSON[])) AS f FROM {SHAPES.sql}),
    g AS (SELECT *, list_transform(regexp_extract_all(CAST(f -> '$.geometry.coordinates' AS VARCHAR), '-?[0-9]+[.][0-9]+'), lambda x: CAST(x AS DOUBLE)) AS xy FROM f)
    SELECT kind, CAST(f ->> '$.properties.OBJECTID' AS BIGINT) AS object_id, f ->> '$.properties.NAME' AS name, f ->> '$.geometry.type' AS geometry_type, CAST(len(xy) / 2 AS INTEGER) AS n_positions,
      list_min(list_filter(xy, lambda x, i: i % 2 = 1)) AS west, list_min(list_filter(xy, lambda x, i: i % 2 = 0)) AS south, list_max(list_filter(xy, lambda x, i: i % 2 = 1)) AS east, list_max(list_filter(xy, lambda x, i: i % 2 = 0)) AS north FROM g"""
)
def geojson_features(spark, sf_dir):
    """The extent of features of any geometry."""
    return S.geojson_features(SHAPES.frame(spark, sf_dir)).drop("coordinates")


# --- layout -----------------------------------------------------------------------------------------------------------

class _Words(Derived):
    """Documents' words laid out as pages of 400 in two columns, five to a line, with tops that differ a little within a line.

    Pages are INT, as in the SQL, so long as all numbers fit; else they are BIGINT, where the SQL's cast fails.
    """

    SPLIT = r"regexp_extract_all(text, '[^ \\n\\r\\t]+', 0)"

    def __init__(self) -> None:
        nth = "CAST(pos AS INT) % 400"
        row, place, column = f"CAST(floor(({nth}) / 5) AS INT) % 40", f"({nth}) % 5", f"CAST(floor(({nth}) / 200) AS INT)"
        left = f"CAST({column} * 300 + 40 + ({place}) * 44 AS DOUBLE)"
        super().__init__(
            "documents",
            page=("doc_id * 1000 + floor(pos / 400)", "CAST(doc_id * 1000 + floor(pos / 400) AS INT)"),
            text="word",
            x0=left,
            x1=f"{left} + 36.0 - CAST(pos AS INT) % 3",
            top=f"CAST(({row}) * 12 + ({place}) % 3 AS DOUBLE)",
            page_left="CAST(0.0 AS DOUBLE)",
            page_right="CAST(600.0 AS DOUBLE)",
        )

    def frame(self, spark, sf_dir):
        documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        rows = documents.selectExpr("doc_id", f"posexplode({self.SPLIT}) AS (pos, word)").selectExpr(*self._expressions(0))
        # a text of 2^31 bytes has 2^30 words at most, so documents below have no page that doesn't fit, and their texts aren't split
        far = documents.where("doc_id > 2144799 OR doc_id < -2147483").selectExpr("doc_id", f"size({self.SPLIT}) AS n")
        beyond = far.where("n > 0 AND (doc_id * 1000 + (n - 1) div 400 > 2147483647 OR doc_id < 0)")
        return rows.withColumn("page", F.col("page").cast("int")) if beyond.isEmpty() else rows

    @property
    def sql(self):
        words = "(SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n\\r\\t]+') AS w FROM documents))"
        return f"(SELECT {', '.join(self._expressions(1))} FROM {words})"


WORDS = _Words()


def lines_sql(words: str, by: str) -> str:
    return f"""(SELECT {by}, CAST(line_no AS INTEGER) AS line_no, string_agg(text, ' ' ORDER BY top, x0, text) AS line FROM (
      SELECT *, sum(CASE WHEN abs(top - before) >= 3.0 THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS line_no FROM (
      SELECT *, lag(top) OVER (PARTITION BY {by} ORDER BY top, x0, text) AS before FROM {words})) GROUP BY {by}, line_no)"""


@query(f"SELECT * FROM {lines_sql(WORDS.sql, 'page')}")
def pdf_lines(spark, sf_dir):
    return P.lines_of_words(WORDS.frame(spark, sf_dir), ["page"])


COLUMNS = f"""(WITH bins AS (SELECT DISTINCT page, page_left, unnest(generate_series(greatest(0, CAST(trunc((x0 - page_left) / 4.0) AS BIGINT)), least(greatest(1, CAST(trunc((page_right - page_left) / 4.0) AS BIGINT) + 1) - 1, CAST(trunc((x1 - page_left) / 4.0) AS BIGINT)))) AS bin FROM {WORDS.sql}),
  runs AS (SELECT *, sum(CASE WHEN (bin - before - 1) * 4.0 >= 12.0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY bin) AS run FROM (SELECT *, lag(bin) OVER (PARTITION BY page ORDER BY bin) AS before FROM bins)),
  cols AS (SELECT page, page_left + min(bin) * 4.0 AS x_start, page_left + (max(bin) + 1) * 4.0 AS x_end FROM runs GROUP BY page, page_left, run)
  SELECT page, x_start, x_end, CAST(row_number() OVER (PARTITION BY page ORDER BY x_start) AS INTEGER) AS column_no FROM cols WHERE x_end - x_start >= 50.0)"""


@query(f"SELECT * FROM {COLUMNS}")
def pdf_columns(spark, sf_dir):
    return P.column_ranges(WORDS.frame(spark, sf_dir), ["page"])


@query(
    f"""WITH c AS (SELECT * FROM {COLUMNS}), n AS (SELECT page, count(*) AS k FROM c GROUP BY page),
    w AS (SELECT w.*, 1 AS column_no FROM {WORDS.sql} w LEFT JOIN n USING (page) WHERE coalesce(k, 0) <= 1
      UNION ALL SELECT w.*, column_no FROM {WORDS.sql} w JOIN n USING (page) JOIN c ON c.page = w.page AND x0 >= x_start AND x0 < x_end WHERE k > 1),
    p AS (SELECT page, column_no, string_agg(line, chr(10) ORDER BY line_no) AS part FROM {lines_sql("w", "page, column_no")} GROUP BY page, column_no)
    SELECT page, md5(string_agg(part, chr(10) || chr(10) ORDER BY column_no)) AS text FROM p GROUP BY page"""
)
def page_texts(spark, sf_dir):
    return P.page_texts(WORDS.frame(spark, sf_dir), ["page"]).select("page", F.md5(F.col("text").cast("binary")).alias("text"))
