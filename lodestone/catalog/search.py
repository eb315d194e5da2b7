"""Index, search, retrieval, answers and evaluation over documents, embeddings and benchmark.

documents are the chunks (lang is the tag), embeddings their vectors where ids agree, and benchmark items the queries; an
item's tag comes from its id, one value in five being absent from the index, and its vector is the one with its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.catalog import query, tokens_sql
from lodestone.functions import text as T
from lodestone.operators import dense as D
from lodestone.operators import evaluation as E
from lodestone.operators import generation as G
from lodestone.operators import index as I
from lodestone.operators import phrases as P
from lodestone.operators import pruned as R
from lodestone.operators import search as S
from lodestone.operators import segments as X
from lodestone.operators.parsing import known_tags
from lodestone.plans.retrieve import retrieve
from lodestone.tables import spread, workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source", F.lit(1).alias("page"), F.col("lang").alias("disaster_type"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("tag"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text queries."""
    tag = F.element_at(F.array(F.lit(None).cast("string"), F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("xx")), (F.col("item_id") % 5 + 1).cast("int"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", tag.alias("tag"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return q.join(v, "query_id", "left")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector, with the next label as its tag."""
    v = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0)
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), ((F.col("label") + 1) % 10).cast("string").alias("tag"))


def _state(spark: SparkSession, sf_dir: str, *names: str) -> tuple[str, ...]:
    """Names this session, a folder and its tables' files with their sizes and times: another state of the files has another key."""
    files = None
    for name in names:
        own = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        files = own if files is None else files.unionByName(own)
    seen = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return (spark.sparkContext.applicationId, sf_dir, str(seen))


_indexes: dict[tuple[str, ...], I.Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of a folder's tables, written once in a session for each state of its files and then read by each search, as a
    saved index would be."""
    key = _state(spark, sf_dir, "documents", "embeddings")
    if key not in _indexes:
        _indexes[key] = I.build_index(chunks(spark, sf_dir), vectors(spark, sf_dir).select("id", "embedding"), workspace(spark, "index"))
    return _indexes[key]


LEXICAL = f"""
tok AS MATERIALIZED (SELECT doc_id AS id, {tokens_sql("text")} AS t FROM documents),
occ AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok),
posts AS MATERIALIZED (SELECT term, id, any_value(dl) AS dl, count(*) AS tf FROM occ GROUP BY term, id),
corpus AS (SELECT count(*) AS n, avg(CAST(len(t) AS DOUBLE)) AS avgdl FROM tok),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM posts GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus),
means AS MATERIALIZED (SELECT avg(raw) AS mean FROM raws),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raws, means),
q AS (SELECT item_id AS query_id, text, [NULL, 'en', 'fr', 'de', 'xx'][CAST(item_id % 5 + 1 AS INTEGER)] AS tag, embedding AS qvec
      FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
qocc AS (SELECT query_id, tag, unnest({tokens_sql("text")}) AS term FROM q),
qterms AS (SELECT query_id, tag, term, count(*) AS qtf FROM qocc GROUP BY ALL)
"""


def bm25_sql(name: str, filtered: bool, k: int = 15) -> str:
    """CTEs name_scores and name (the top k with ranks)."""
    keep = "WHERE qterms.tag IS NULL OR qterms.tag = lang" if filtered else ""
    return f"""
{name}_scores AS (
  SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
  FROM qterms JOIN terms USING (term) JOIN posts USING (term) JOIN documents ON doc_id = id, corpus {keep}
  GROUP BY query_id, id),
{name} AS (
  SELECT query_id, id, score, rank - 1 AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_scores WHERE score > 0)
  WHERE rank <= {k})
"""


def dense_sql(name: str, queries: str, vectors: str, where: str = "", k: int = 15) -> str:
    return f"""
{name} AS (
  SELECT query_id, id, score, rank - 1 AS rank FROM (
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT query_id, v.id, round(list_inner_product(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score
      FROM {queries} qq, {vectors} v WHERE qvec IS NOT NULL {where}))
  WHERE rank <= {k})
"""


VECS = "(SELECT vec_id AS id, embedding, CAST(label AS VARCHAR) AS tag FROM embeddings)"
VQ = "(SELECT vec_id AS query_id, embedding AS qvec, CAST((label + 1) % 10 AS VARCHAR) AS tag FROM embeddings WHERE vec_id % 20 = 0)"
ALIGNED = "(SELECT vec_id AS id, embedding, lang AS tag FROM embeddings JOIN documents ON doc_id = vec_id)"
RRF = """
rrf AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank ASC NULLS LAST, sparse_rank ASC) - 1 AS pos FROM (
    SELECT query_id, id, round(sum(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + sparse_rank), 0)), 12) AS rrf, max(dense_rank) AS dense_rank, max(sparse_rank) AS sparse_rank
    FROM (SELECT query_id, id, rank AS dense_rank, NULL AS sparse_rank FROM dense UNION ALL SELECT query_id, id, NULL, rank FROM sparse) GROUP BY query_id, id))
"""
HYBRID = f"WITH {LEXICAL}, {bm25_sql('sparse', True)}, {dense_sql('dense', 'q', ALIGNED, 'AND (qq.tag IS NULL OR qq.tag = v.tag)')}, {RRF}"
RERANKED = f"""{HYBRID},
pairs AS (
  SELECT rrf.query_id, rrf.id, pos, d.text, d.source, d.lang, list_distinct({tokens_sql("q.text")}) AS qt, {tokens_sql("d.text")} AS dt
  FROM rrf JOIN q USING (query_id) JOIN documents d ON d.doc_id = rrf.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) - 1 AS final_rank
  FROM (SELECT *, CASE WHEN len(qt) = 0 THEN 0.0 ELSE round(len(list_intersect(qt, dt)) / len(qt), 9) END AS score FROM pairs))
"""
GATED = f"""{RERANKED},
tags AS (SELECT DISTINCT lang FROM documents),
best AS (SELECT query_id, max(score) AS top_score FROM ranked GROUP BY query_id),
gates AS (
  SELECT query_id, CASE WHEN NOT empty THEN top_score END AS top_score, empty OR low AS gated,
         CASE WHEN empty THEN '{C.EMPTY_FILTER_MESSAGE}' WHEN low THEN '{C.LOW_CONFIDENCE_MESSAGE}' END AS message
  FROM (SELECT q.query_id, top_score, q.tag IS NOT NULL AND lang IS NULL AS empty, top_score IS NULL OR top_score < 0.1 AS low
        FROM q LEFT JOIN tags ON lang = q.tag LEFT JOIN best USING (query_id)))
"""
HITS = f"{GATED}, hits AS (SELECT * FROM ranked WHERE final_rank < 4 AND query_id IN (SELECT query_id FROM gates WHERE NOT gated))"


@query(f"SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_stats(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return chunks(spark, sf_dir).select("id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


#: The statistics alone: a document's distinct terms, no postings, lengths or queries.
TERM_STATS = f"""
WITH t AS (SELECT unnest(list_distinct({tokens_sql("text")})) AS term FROM documents),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d CROSS JOIN (SELECT count(*) AS n FROM documents) c),
i AS (SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM r CROSS JOIN (SELECT avg(raw) AS mean FROM r) m)
"""


@query(f"{TERM_STATS} SELECT term, df, idf FROM i")
def term_df_idf(spark, sf_dir):
    return index_of(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"{TERM_STATS} SELECT df, count(*) AS terms, CAST(sum(length(term)) AS BIGINT) AS letters, min(term) AS first, max(term) AS last, max(idf) AS idf FROM i GROUP BY df")
def idf_by_df(spark, sf_dir):
    """The term statistics, a row for each number of documents."""
    t = index_of(spark, sf_dir).terms
    return t.groupBy("df").agg(F.count("*").alias("terms"), F.sum(F.length("term")).alias("letters"), F.min("term").alias("first"), F.max("term").alias("last"), F.round(F.max("idf"), 6).alias("idf"))


@query(f"WITH {LEXICAL} SELECT (SELECT count(*) FROM posts) AS postings, (SELECT count(*) FROM dfs) AS terms, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT lang) FROM documents) AS tags")
def index_build(spark, sf_dir):
    """The rows of a whole index, built anew and written at each call."""
    c = chunks(spark, sf_dir)
    index = I.build_index(c, vectors(spark, sf_dir).select("id", "embedding"), workspace(spark, "index"))
    rows = [index.by_chunk.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")), *(d.agg(F.count("*").alias(n)) for n, d in (("terms", index.terms), ("vectors", index.vectors), ("tags", index.tags)))]
    return rows[0].crossJoin(rows[1]).crossJoin(rows[2]).crossJoin(rows[3])  # one row each


@query(f"WITH {LEXICAL} SELECT n, round(avgdl, 6) AS avgdl FROM corpus")
def doc_length_stats(spark, sf_dir):
    return I.corpus_stats(chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


RANKED = "SELECT query_id, id, round(score, 6) AS score, rank FROM"


@query(f"WITH {LEXICAL}, {bm25_sql('sparse', False)} {RANKED} sparse")
def bm25_topk(spark, sf_dir):
    return _ranked(S.bm25_topk(items(spark, sf_dir), index_of(spark, sf_dir)))


@query(f"WITH {LEXICAL}, {bm25_sql('sparse', True)} {RANKED} sparse")
def bm25_filtered_topk(spark, sf_dir):
    return _ranked(S.bm25_topk(items(spark, sf_dir), index_of(spark, sf_dir), filtered=True))


@query(f"WITH {dense_sql('dense', VQ, VECS)} {RANKED} dense")
def dense_topk(spark, sf_dir):
    return _ranked(S.dense_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir)))


@query(f"WITH {dense_sql('dense', VQ, VECS, 'AND qq.tag = v.tag')} {RANKED} dense")
def dense_prefilter_topk(spark, sf_dir):
    return _ranked(S.dense_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), mode="prefilter"))


@query(
    f"""WITH {dense_sql("wide", VQ, VECS, k=60)}
    SELECT query_id, id, round(score, 6) AS score, rank - 1 AS rank FROM (
      SELECT w.*, row_number() OVER (PARTITION BY w.query_id ORDER BY score DESC, w.id) AS rank
      FROM (SELECT query_id, id, score FROM wide) w JOIN {VQ} q USING (query_id) JOIN {VECS} v ON v.id = w.id WHERE q.tag = v.tag) WHERE rank <= 15"""
)
def dense_overfetch_filter(spark, sf_dir):
    return _ranked(S.dense_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), mode="overfetch"))


_lists: dict[tuple[str, ...], D.Lists] = {}


def lists_of(spark: SparkSession, sf_dir: str) -> D.Lists:
    """The inverted lists of a folder's embeddings, built once in a session for each state of its files."""
    key = _state(spark, sf_dir, "embeddings")
    if key not in _lists:
        _lists[key] = D.build_lists(vectors(spark, sf_dir), workspace(spark, "lists"))
    return _lists[key]


@query()
def dense_lists_topk(spark, sf_dir):
    """The best of the lists nearest to each query; of the exact best, most are among them (see dense_lists_recall)."""
    return _ranked(D.lists_topk(vector_queries(spark, sf_dir), lists_of(spark, sf_dir)))


@query()
def dense_lists_recall(spark, sf_dir):
    """What share of the exact best 15 the lists find for each query, and what share of all vectors was scored for all."""
    q, lists = vector_queries(spark, sf_dir), lists_of(spark, sf_dir)
    found = D.recall_of(D.lists_topk(q, lists), D.dense_topk(q, vectors(spark, sf_dir)))
    return found.select("query_id", F.round("recall", 6).alias("recall"), F.lit(round(D.scored_share(q, lists), 6)).alias("scored_share"))


@query(
    f"""WITH p AS (SELECT doc_id AS id FROM documents WHERE len({tokens_sql("text")}) > 0)
    SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM p) AS posting_ids,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS chunks_without_vector,
    (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS vectors_without_chunk,
    (SELECT count(*) FROM p WHERE id NOT IN (SELECT doc_id FROM documents)) AS postings_without_chunk"""
)
def index_alignment(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return I.alignment(index.chunks.select("id"), index.vectors.select("id"), index.by_chunk.select("id"))


def _fused(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("rrf", 9).alias("rrf"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("dense_rank", "sparse_rank", "pos")])


FUSED = "SELECT query_id, id, round(rrf, 9) AS rrf, coalesce(CAST(dense_rank AS BIGINT), -1) AS dense_rank, coalesce(CAST(sparse_rank AS BIGINT), -1) AS sparse_rank, CAST(pos AS BIGINT) AS pos FROM rrf"


@query(f"WITH {LEXICAL}, {bm25_sql('sparse', False)}, {dense_sql('dense', 'q', VECS)}, {RRF} {FUSED}")
def rrf_fusion(spark, sf_dir):
    index, q = index_of(spark, sf_dir), items(spark, sf_dir)
    return _fused(S.rrf(S.dense_topk(q, index.vectors), S.bm25_topk(q, index)))


@query(f"{HYBRID} {FUSED}")
def hybrid_candidates(spark, sf_dir):
    return _fused(S.candidates(items(spark, sf_dir), index_of(spark, sf_dir)))


@query(f"{RERANKED} SELECT query_id, id, round(score, 6) AS score, CAST(pos AS BIGINT) AS pos, CAST(final_rank AS BIGINT) AS final_rank FROM ranked")
def rerank_coverage(spark, sf_dir):
    index, q = index_of(spark, sf_dir), items(spark, sf_dir)
    out = S.rerank(S.candidates(q, index), q, index.chunks)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("pos").cast("long").alias("pos"), F.col("final_rank").cast("long").alias("final_rank"))


@query(f"{GATED} SELECT query_id, round(top_score, 6) AS top_score, gated, message FROM gates")
def confidence_gate(spark, sf_dir):
    found = retrieve(items(spark, sf_dir), index_of(spark, sf_dir))
    return found.gates.select("query_id", F.round("top_score", 6).alias("top_score"), "gated", "message")


@query(f"{HITS} SELECT query_id, CAST(final_rank AS BIGINT) AS final_rank, id AS chunk_id, text, source, 1 AS page, lang AS disaster_type, round(score, 6) AS score FROM hits")
def retrieve_top4(spark, sf_dir):
    hits = retrieve(items(spark, sf_dir), index_of(spark, sf_dir)).hits
    return hits.select("query_id", F.col("final_rank").cast("long").alias("final_rank"), F.col("id").alias("chunk_id"), "text", "source", "page", "disaster_type", F.round("score", 6).alias("score"))


SAFETY = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{p.replace(chr(39), chr(39) * 2)}', ''))) // {len(p)}" for p in C.SAFETY_PHRASES)
ORDERED = f"""{HITS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY safety DESC, final_rank) AS order_no FROM (SELECT *, {SAFETY} AS safety FROM hits)),
said AS (SELECT query_id, string_agg(trim(regexp_extract(regexp_replace(text, '^\\s+', ''), '^[^.!?\\n]*[.!?]?')) || ' [' || order_no || ']', ' ' ORDER BY order_no) AS answer, count(*) AS n FROM ordered GROUP BY query_id)
"""


@query(f"{ORDERED} SELECT g.query_id, CASE WHEN gated THEN message ELSE answer END AS answer, coalesce(n, 0) AS n_citations, gated, round(top_score, 6) AS top_score FROM gates g LEFT JOIN said USING (query_id)")
def answer_extractive(spark, sf_dir):
    out = _answers(spark, sf_dir)
    return out.select("query_id", "answer", F.size("citations").cast("long").alias("n_citations"), "gated", F.round("top_score", 6).alias("top_score"))


def _answers(spark, sf_dir):
    from lodestone.plans.retrieve import answer

    return answer(items(spark, sf_dir), index_of(spark, sf_dir))


@query(f"{ORDERED} SELECT query_id, id AS chunk_id, CAST(safety AS BIGINT) AS safety, order_no FROM ordered")
def safety_reorder(spark, sf_dir):
    out = G.safety_order(retrieve(items(spark, sf_dir), index_of(spark, sf_dir)).hits)
    return out.select("query_id", F.col("id").alias("chunk_id"), "safety", F.col("order_no").cast("long").alias("order_no"))


@query(
    f"""{ORDERED} SELECT query_id, '{C.PROMPT_HEAD}' || string_agg(chr(10) || chr(10) || '[' || order_no || '] source=' || o.source || ' page=1 disaster=' || lang || chr(10) || o.text, '' ORDER BY order_no)
    || chr(10) || chr(10) || 'Question: ' || any_value(q.text) || chr(10) || '{C.PROMPT_TAIL}' AS prompt FROM ordered o JOIN q USING (query_id) GROUP BY query_id"""
)
def prompt_assembly(spark, sf_dir):
    q = items(spark, sf_dir)
    hits = G.hit_arrays(G.safety_order(retrieve(q, index_of(spark, sf_dir)).hits))
    return hits.join(q.select("query_id", "text"), "query_id").select("query_id", G.user_message(F.col("text"), F.col("hits")).alias("prompt"))


@query(
    f"""{ORDERED},
    told AS (SELECT g.query_id, CASE WHEN gated THEN message ELSE answer END AS answer, coalesce(n, 0) AS n, gated, round(top_score, 6) AS top_score FROM gates g LEFT JOIN said USING (query_id)),
    words AS (SELECT *, list_concat(['meta'], CASE WHEN gated THEN [answer] ELSE regexp_extract_all(answer, '\\s*\\S+|\\s+$') END, ['done']) AS w FROM told),
    rows AS (SELECT query_id, gated, top_score, n, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS seq FROM words)
    SELECT query_id, CAST(seq AS INTEGER) AS seq, CASE seq WHEN 0 THEN 'meta' WHEN m - 1 THEN 'done' ELSE 'token' END AS type, CASE WHEN seq BETWEEN 1 AND m - 2 THEN word END AS text,
    CASE WHEN seq = 0 THEN gated END AS gated, CASE WHEN seq = 0 THEN top_score END AS top_score, CASE WHEN seq = 0 THEN CAST(n AS INTEGER) END AS n_citations FROM rows"""
)
def answer_events(spark, sf_dir):
    out = G.events(_answers(spark, sf_dir))
    return out.select("query_id", "seq", "type", "text", "gated", F.round("top_score", 6).alias("top_score"), F.size("citations").alias("n_citations"))


@query(f"SELECT doc_id AS id, CAST({SAFETY} AS BIGINT) AS safety FROM documents")
def safety_score(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", T.safety_score(F.col("text")).alias("safety"))


@query("SELECT lang AS disaster_type, doc_id AS id, count(*) OVER (PARTITION BY lang) AS n_of_tag FROM documents")
def browse_by_tag(spark, sf_dir):
    return E.rows_of_tag(chunks(spark, sf_dir).select("id", "disaster_type"))


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 5")
def top_sources(spark, sf_dir):
    return E.top_values(chunks(spark, sf_dir), "source", 5)


@query("SELECT md5(text) AS text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return E.duplicates(chunks(spark, sf_dir).select(F.md5(F.col("text").cast("binary")).alias("text")), "text")


@query(f"{GATED} SELECT query_id, round(top_score, 6) AS top_score FROM gates JOIN q USING (query_id) WHERE NOT gated AND tag IS NOT NULL")
def gate_check(spark, sf_dir):
    """Queries with a tag taken as those that should have been gated: the ones answered all the same."""
    q = items(spark, sf_dir)
    return E.gate_failures(retrieve(q, index_of(spark, sf_dir)).gates, q.where("tag IS NOT NULL")).select("query_id", F.round("top_score", 6).alias("top_score"))


# --- aggregations over chunks -----------------------------------------------------------------------------------------


@query("SELECT lang AS disaster_type, count(*) AS n FROM documents GROUP BY lang")
def count_by_tag(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("disaster_type").agg(F.count("*").alias("n"))


@query("SELECT source, lang AS disaster_type, count(*) AS n FROM documents GROUP BY ALL")
def count_by_source_and_tag(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("source", "disaster_type").agg(F.count("*").alias("n"))


@query("SELECT lang AS disaster_type, count(*) AS n, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 5), ',') AS first_ids FROM documents GROUP BY lang")
def ids_by_tag(spark, sf_dir):
    """The lowest five ids by rank, so that no group's ids are gathered in one place."""
    c = chunks(spark, sf_dir)
    first = S.top(c.select("disaster_type", "id"), 5, [F.asc("id")], by="disaster_type").groupBy("disaster_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return c.groupBy("disaster_type").agg(F.count("*").alias("n")).join(first, "disaster_type")


@query("SELECT DISTINCT lang AS tag FROM documents")
def distinct_tags(spark, sf_dir):
    return known_tags(chunks(spark, sf_dir))


_N = f"CAST(len({tokens_sql('text')}) AS BIGINT)"
_BUCKET = "CASE " + " ".join(f"WHEN n >= {a} AND n < {b} THEN '{a}-{b}'" for a, b in zip(C.LENGTH_EDGES, C.LENGTH_EDGES[1:])) + " END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM (SELECT {_N} AS n FROM documents) x GROUP BY {_BUCKET} HAVING {_BUCKET} IS NOT NULL".replace("count(*) AS n FROM", "count(*) AS n_chunks FROM"))
def length_histogram(spark, sf_dir):
    return E.length_histogram(chunks(spark, sf_dir)).withColumnRenamed("n", "n_chunks")


@query(f"SELECT count(*) AS n, min(k) AS shortest, max(k) AS longest, round(avg(k), 6) AS mean, round(median(k), 6) AS median, round(avg(CAST(k < 30 OR k > 450 AS INTEGER)), 6) AS odd_share FROM (SELECT {_N} AS k FROM documents)")
def length_quantiles(spark, sf_dir):
    return E.length_summary(chunks(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{p}' AS phrase, CAST(coalesce(sum(CAST(contains(lower(text), '{p}') AS BIGINT)), 0) AS BIGINT) AS n FROM documents" for p in C.CRITICAL_PHRASES))
def critical_phrase_hits(spark, sf_dir):
    return E.phrase_hits(chunks(spark, sf_dir))


@query("SELECT DISTINCT n_name AS source FROM nation WHERE n_name NOT IN (SELECT source FROM documents)")
def source_coverage_anti(spark, sf_dir):
    """Expected sources (here the nations' names) without a chunk."""
    expected = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source")).distinct()
    return expected.join(chunks(spark, sf_dir).select("source").distinct(), "source", "left_anti")


# --- evaluation -------------------------------------------------------------------------------------------------------


def truth(spark, sf_dir):
    """Good documents whose id leaves the item's id modulo 40 are relevant to it."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return good.join(q, F.col("doc_id") % 40 == F.col("query_id") % 40).select("query_id", F.col("doc_id").alias("id"))


QUALITY = """
truth AS (SELECT item_id AS query_id, doc_id AS id FROM labels JOIN benchmark ON doc_id % 40 = item_id % 40 WHERE quality = 1),
pools AS (SELECT query_id, id, rank, (query_id, id) IN (SELECT (query_id, id) FROM truth) AS hit FROM sparse),
of_pool AS (SELECT query_id, count(*) AS n, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first FROM pools GROUP BY query_id),
of_truth AS (SELECT query_id, count(*) AS relevant FROM truth GROUP BY query_id),
quality AS (SELECT query_id, coalesce(round(hits / n, 6), 0) AS precision, least(1.0, coalesce(round(hits / relevant, 6), 0)) AS recall, coalesce(round(1 / (first + 1), 6), 0) AS rr FROM of_pool FULL JOIN of_truth USING (query_id))
"""


def _quality(spark, sf_dir):
    return E.pool_quality(S.bm25_topk(items(spark, sf_dir), index_of(spark, sf_dir)), truth(spark, sf_dir), 15)


@query(f"WITH {LEXICAL}, {bm25_sql('sparse', False)}, {QUALITY} SELECT query_id, precision, recall, rr FROM quality")
def precision_recall_at_k(spark, sf_dir):
    return _quality(spark, sf_dir)


MEANS = f"WITH {LEXICAL}, {bm25_sql('sparse', False)}, {QUALITY}, scores AS (SELECT count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM quality)"


@query(f"{MEANS} SELECT * FROM scores")
def mrr(spark, sf_dir):
    return E.mean_quality(_quality(spark, sf_dir))


@query(
    f"""{MEANS}, r AS (SELECT 'candidates' AS stage, 'precision' AS metric, precision AS value, CAST(NULL AS DOUBLE) AS threshold FROM scores
    UNION ALL SELECT 'candidates', 'recall', recall, 0.5 FROM scores UNION ALL SELECT 'final', 'mrr', mrr, 0.5 FROM scores)
    SELECT *, CASE WHEN threshold IS NULL THEN 'PASS' WHEN value < threshold THEN 'FAIL' WHEN value < 0.7 THEN 'WARN' ELSE 'PASS' END AS status FROM r"""
)
def quality_summary(spark, sf_dir):
    return E.summary(E.mean_quality(_quality(spark, sf_dir)))


@query(f"WITH {LEXICAL}, {bm25_sql('sparse', False)} SELECT query_id, id FROM sparse JOIN documents ON doc_id = id JOIN q USING (query_id) WHERE q.tag IS NOT NULL AND q.tag IS DISTINCT FROM lang")
def filter_violations(spark, sf_dir):
    """Hits of the unfiltered search that a filter would have kept out."""
    index, q = index_of(spark, sf_dir), items(spark, sf_dir)
    return E.filter_violations(S.bm25_topk(q, index).join(index.chunks.select("id", "disaster_type"), "id"), q)


@query(f"{GATED} SELECT query_id, round(top_score, 6) AS top_score FROM gates WHERE NOT gated AND top_score < 0.3")
def score_watch(spark, sf_dir):
    return E.weak_scores(retrieve(items(spark, sf_dir), index_of(spark, sf_dir)).gates).select("query_id", F.round("top_score", 6).alias("top_score"))


@query(f"{GATED} SELECT query_id, CASE WHEN gated OR top_score IS NULL THEN NULL WHEN top_score >= 0.7 THEN 'high confidence' WHEN top_score >= 0.3 THEN 'partial match' ELSE 'low match' END AS bucket FROM gates")
def confidence_bucket(spark, sf_dir):
    return retrieve(items(spark, sf_dir), index_of(spark, sf_dir)).gates.select("query_id", T.confidence_bucket(F.col("top_score"), F.col("gated")).alias("bucket"))


@query()
def pandas_udf_embed(spark, sf_dir):
    """Unit vectors of all documents by the default embedder."""
    return I.embed_chunks(chunks(spark, sf_dir)).select("id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query("SELECT doc_id AS id, item_id AS phrase_id, (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS n FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def passages_in_documents(spark, sf_dir):
    """Every benchmark passage that a document has."""
    return P.find_phrases(chunks(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase")))


@query(f"SELECT doc_id AS id, CAST({SAFETY} AS BIGINT) AS safety FROM documents")
def safety_by_automaton(spark, sf_dir):
    """The safety score of every document, all phrases in one pass."""
    return chunks(spark, sf_dir).select("id", P.phrase_totals(C.SAFETY_PHRASES)(F.lower("text")).alias("safety"))


_blocked: dict[tuple[str, ...], R.BlockedIndex] = {}


def blocks_of(spark: SparkSession, sf_dir: str) -> R.BlockedIndex:
    """The blocked postings of a folder's documents, built once in a session for each state of its files."""
    key = _state(spark, sf_dir, "documents", "embeddings")
    if key not in _blocked:
        _blocked[key] = R.build_blocks(index_of(spark, sf_dir), workspace(spark, "blocks"))
    return _blocked[key]


@query(f"WITH {LEXICAL}, {bm25_sql('sparse', False)} {RANKED} sparse")
def bm25_pruned_topk(spark, sf_dir):
    """The rows of bm25_topk, from a part of the postings (see bm25_postings_read)."""
    return _ranked(R.pruned_topk(items(spark, sf_dir), blocks_of(spark, sf_dir), workspace(spark, "pruned")).found)


@query()
def bm25_postings_read(spark, sf_dir):
    """How many postings each pass of bm25_pruned_topk takes, and how many of the queries' terms there are."""
    return R.pruned_topk(items(spark, sf_dir), blocks_of(spark, sf_dir), workspace(spark, "pruned")).reads


# --- sketches, samples ------------------------------------------------------------------------------------------------


def _within(quartiles: DataFrame, counted: DataFrame, *by: str) -> DataFrame:
    """by, n and whether each quartile has its rank, by counting all rows below and up to it; ties may reach over it."""
    joined = counted.join(F.broadcast(quartiles), list(by)) if by else counted.crossJoin(F.broadcast(quartiles))  # a row per source, or one
    rows = joined.groupBy(*by, "n").agg(*[F.avg(F.when(test(F.col("_k"), F.col(q)), 1.0).otherwise(0.0)).alias(f"{q}_{name}") for q in ("q1", "median", "q3") for name, test in (("below", lambda a, b: a < b), ("upto", lambda a, b: a <= b))])
    good = lambda q, share: (F.col(f"{q}_below") <= share + E.RANK_ERROR) & (F.col(f"{q}_upto") >= share - E.RANK_ERROR)
    return rows.select(*by, "n", (good("q1", 0.25) & good("median", 0.5) & good("q3", 0.75)).alias("within"))


def _lengths(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return E.length_sketches(c), c.select("source", T.token_count(F.col("text")).cast("long").alias("_k"))


@query("SELECT source, count(*) AS n, TRUE AS within FROM documents GROUP BY source")
def sketched_quartiles_by_source(spark, sf_dir):
    """Whether the sketched quartiles of every source's lengths keep to their error in rank."""
    sketches, counted = _lengths(spark, sf_dir)
    return _within(E.sketched_quartiles(sketches), counted, "source")


@query("SELECT count(*) AS n, TRUE AS within FROM documents")
def sketched_quartiles_merged(spark, sf_dir):
    """The same of the sources' sketches merged into one."""
    sketches, counted = _lengths(spark, sf_dir)
    return _within(E.sketched_quartiles(E.merged_sketches(sketches)), counted)


@query()
def seeded_sample(spark, sf_dir):
    """A hundred documents in a seeded order."""
    return E.sampled(chunks(spark, sf_dir).select("id", "source"), 100)


# --- segments ---------------------------------------------------------------------------------------------------------

#: Documents that are left when a third of the even ones is deleted.
_LEFT = "(SELECT * FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 6 = 4))"


@query(f"WITH {LEXICAL.replace('FROM documents', f'FROM {_LEFT}')}, {bm25_sql('sparse', False)} {RANKED} sparse")
def segmented_topk(spark, sf_dir):
    """The search over an index of two segments, even and odd documents, with a third of the even ones deleted."""
    at, c, v = workspace(spark, "segments"), chunks(spark, sf_dir), vectors(spark, sf_dir).select("id", "embedding")
    for k in (0, 1):
        half = F.col("id") % 2 == k
        X.append_segment(c.where(half), v.where(half), at, k)
    X.delete_chunks(c.where((F.col("id") % 2 == 0) & (F.col("id") % 6 == 4)).select("id"), at, upto=1, batch=0)
    return _ranked(S.bm25_topk(items(spark, sf_dir), X.load_segments(spark, at)))
