"""Grounded answers: safety order, prompts, answers, events."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.schemas import ANSWER

SYSTEM_PROMPT = (
    "Answer from the numbered context blocks only, put warnings that apply first, and mark every statement with its block, like [1]. "
    f"If no block helps, reply exactly: {C.LOW_CONFIDENCE_MESSAGE}"
)


def safety_order(hits: DataFrame) -> DataFrame:
    """hits (query_id, final_rank, text, ...) with safety, and order_no from 1 by (most safety phrases, final_rank)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("safety"), F.asc("final_rank"))
    return hits.withColumn("safety", T.safety_score(F.col("text"))).withColumn("order_no", F.row_number().over(w))


def hit_of(row: Column) -> Column:
    """A hit as answers cite it."""
    return F.struct(row["id"].alias("chunk_id"), row["text"].alias("text"), row["source"].alias("source"), row["page"].alias("page"), row["disaster_type"].alias("disaster_type"), row["score"].alias("score"))


def safety_sorted(rows: Column) -> Column:
    """An array of hits with their safety by (most safety phrases, final_rank), each as answers cite it."""
    keyed = F.transform(rows, lambda h: F.struct((-h["safety"]).alias("less"), h["final_rank"].alias("final_rank"), hit_of(h).alias("hit")))
    return F.transform(F.array_sort(keyed), lambda x: x["hit"])


def hit_arrays(ordered: DataFrame) -> DataFrame:
    """query_id and hits: an array of hits in their order."""
    hit = F.struct("order_no", F.struct(F.col("id").alias("chunk_id"), "text", "source", "page", "disaster_type", "score").alias("hit"))
    return ordered.groupBy("query_id").agg(F.array_sort(F.collect_list(hit))["hit"].alias("hits"))


def user_message(question: Column, hits: Column) -> Column:
    """Numbered context blocks, the question, the instruction."""
    block = lambda h, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] source="), h["source"], F.lit(" page="), h["page"].cast("string"), F.lit(" disaster="), h["disaster_type"], F.lit("\n"), h["text"])
    parts = F.concat(F.array(F.lit(C.PROMPT_HEAD)), F.transform(hits, block), F.array(F.concat(F.lit("\nQuestion: "), question), F.lit(C.PROMPT_TAIL)))
    return F.array_join(parts, "\n")


def first_sentence(text: Column) -> Column:
    return T.strip(F.regexp_extract(T.strip(text), r"^[^.!?\n]*[.!?]?", 0))


def extractive_answer(hits: Column) -> Column:
    """The default answer: the first sentence of each hit and its number."""
    return F.array_join(F.transform(hits, lambda h, i: F.concat(first_sentence(h["text"]), F.lit(" ["), (i + 1).cast("string"), F.lit("]"))), " ")


Model = Callable[[str], str]
Stream = Callable[[str], Iterable[str]]
Chat = Callable[[list[dict[str, str]]], str]

_log = logging.getLogger(__name__)


def chat_messages(prompt: str) -> list[dict[str, str]]:
    """The chat for an answering model: the system prompt, and a user message with context blocks and question."""
    return [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": prompt}]


def chat_model(chat: Chat) -> Model:
    """A model of a chat function; also for a chat function that yields tokens, which makes a Stream."""
    return lambda prompt: chat(chat_messages(prompt))


def _model_replies(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for query_id, prompt in zip(batch["query_id"], batch["prompt"]):
                try:
                    replies.append(model(prompt))
                except Exception:  # a model may fail in any way; the query gets a gated answer, the log says why
                    _log.exception("the model failed on query %s", query_id)
                    replies.append(None)
            yield pd.DataFrame({"query_id": batch["query_id"], "reply": replies})

    return run


def generate(asked: DataFrame, *, model: Model | None = None, retry_uncited: bool = False) -> DataFrame:
    """One row per query: query_id, answer, citations, gated, top_score.

    asked has query_id, question, hits (in safety order), top_score, gated, message.  Gated queries never reach the model:
    they take their message.  Without a model the answer is extractive.  If the model fails the answer is the no-answer
    sentence, gated, and the failure is logged.  A cited answer loses that sentence.  With retry_uncited an answer
    without marks is asked for once more.
    """
    empty = F.array().cast(ANSWER.split("citations ")[1].split(", gated")[0])
    if model is None:
        both = asked.withColumn("reply", F.when(~F.col("gated"), extractive_answer(F.col("hits"))))
    else:
        prompts = asked.where(~F.col("gated")).select("query_id", user_message(F.col("question"), F.col("hits")).alias("prompt"))
        ask = _model_replies(model if not retry_uncited else _twice(model))
        both = asked.join(prompts.mapInPandas(ask, "query_id long, reply string"), "query_id", "left")
    failed = F.col("reply").isNull()
    own = F.when(F.col("gated"), F.coalesce("message", F.lit(C.LOW_CONFIDENCE_MESSAGE))).when(failed, C.LOW_CONFIDENCE_MESSAGE)
    answer = own.otherwise(T.strip_canned(T.strip(F.col("reply"))))
    closed = F.col("gated") | failed
    return both.select("query_id", answer.alias("answer"), F.when(closed, empty).otherwise(F.col("hits")).alias("citations"), closed.alias("gated"), "top_score")


def token_stream(stream: Stream, prompt: str) -> Iterator[str]:
    """The model's tokens as they come; if it fails, what it said so far and then the no-answer sentence."""
    try:
        yield from (token for token in stream(prompt) if token)
    except Exception:
        _log.exception("the model failed while it answered")
        yield C.LOW_CONFIDENCE_MESSAGE


def streamed_events(asked: DataFrame, stream: Stream | None = None) -> DataFrame:
    """query_id, seq, type, text, gated, top_score, citations: meta, a token each time the model yields one, done.

    asked is as for generate.  The meta event depends on retrieval alone.  A gated query's one token is its message.  A
    model that fails ends its answer with the no-answer sentence; the events before it stand.  Without a stream the
    extractive answer's words are the tokens.
    """
    if stream is None:
        return events(generate(asked))
    empty = F.array().cast(ANSWER.split("citations ")[1].split(", gated")[0])
    meta = asked.select("query_id", F.lit(0).alias("seq"), F.lit("meta").alias("type"), F.lit(None).cast("string").alias("text"), "gated", "top_score", F.when(F.col("gated"), empty).otherwise(F.col("hits")).alias("citations"))
    message = F.coalesce("message", F.lit(C.LOW_CONFIDENCE_MESSAGE))
    prompts = asked.select("query_id", "gated", F.when(F.col("gated"), message).otherwise(user_message(F.col("question"), F.col("hits"))).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query_id, gated, prompt in zip(batch["query_id"], batch["gated"], batch["prompt"]):
                n = 0
                for n, token in enumerate([prompt] if gated else token_stream(stream, prompt), 1):
                    yield pd.DataFrame({"query_id": [query_id], "seq": [n], "type": ["token"], "text": [token]})
                yield pd.DataFrame({"query_id": [query_id], "seq": [n + 1], "type": ["done"], "text": [None]})

    told = prompts.mapInPandas(run, "query_id long, seq int, type string, text string")
    return meta.unionByName(told, allowMissingColumns=True)


def _twice(model: Model) -> Model:
    def ask(prompt: str) -> str:
        import re

        reply = model(prompt)
        return reply if re.search(r"\[[0-9]+\]", reply) else model(prompt + "\nMark every statement with its block, like [1].")

    return ask


def events(answers: DataFrame) -> DataFrame:
    """query_id, seq, type, text, gated, top_score, citations: meta, the answer's tokens, done.

    A token is a word with the white space before it; a gated answer is one token.
    """
    words = F.when(F.col("gated"), F.array("answer")).otherwise(F.regexp_extract_all("answer", F.lit(r"\s*\S+|\s+$"), F.lit(0)))
    event = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    none = F.lit(None)
    every = F.concat(F.array(event("meta", none)), F.transform(words, lambda w: event("token", w)), F.array(event("done", none)))
    rows = answers.select("query_id", "gated", "top_score", "citations", F.posexplode(every).alias("seq", "event"))
    of_meta = lambda c: F.when(F.col("seq") == 0, F.col(c)).alias(c)
    return rows.select("query_id", "seq", "event.type", "event.text", of_meta("gated"), of_meta("top_score"), of_meta("citations"))


def sse_frames(event_rows: DataFrame) -> DataFrame:
    """query_id, seq, frame: server-sent events; fields without value are left out."""
    body = F.to_json(F.struct("type", "text", "gated", "top_score", "citations"))
    return event_rows.select("query_id", "seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))


def parse_sse(streams: DataFrame) -> DataFrame:
    """stream_id, line_no, type, text, gated, top_score of a stream's (stream_id, body) complete data lines."""
    lines = F.split("body", "\n", -1)
    whole = streams.select("stream_id", F.posexplode(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line_no", "line")).where(F.col("line").startswith("data: "))
    e = F.from_json(F.substring("line", F.lit(7), F.length("line")), "type string, text string, gated boolean, top_score double")
    return whole.select("stream_id", "line_no", e.alias("e")).select("stream_id", "line_no", "e.*")


def validate_requests(bodies: DataFrame) -> DataFrame:
    """request_id, query, status, error for HTTP bodies (request_id, body): 400 if not JSON or if the query is blank."""
    v = F.try_parse_json("body")
    query = T.strip(F.coalesce(F.try_variant_get(v, "$.query", "string"), F.lit("")))
    error = F.when(v.isNull(), "invalid json").when(query == "", "query required")
    return bodies.select("request_id", F.when(error.isNull(), query).alias("query"), F.when(error.isNull(), 200).otherwise(400).alias("status"), error.alias("error"))


def normalize_response(payloads: DataFrame) -> DataFrame:
    """request_id, answer, n_citations, gated, confidence of a backend's JSON (request_id, body); wrong types take defaults."""
    v = F.try_parse_json("body")
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("VOID"))
    return payloads.select(
        "request_id",
        F.when(kind("answer") == "STRING", F.try_variant_get(v, "$.answer", "string")).otherwise("").alias("answer"),
        F.when(kind("citations").startswith("ARRAY"), F.coalesce(F.size(F.try_variant_get(v, "$.citations", "array<variant>")), F.lit(0))).otherwise(0).alias("n_citations"),
        F.coalesce(F.when(kind("gated") == "BOOLEAN", F.try_variant_get(v, "$.gated", "boolean")), F.lit(False)).alias("gated"),
        F.when(kind("confidence").rlike("BIGINT|DOUBLE|DECIMAL"), F.try_variant_get(v, "$.confidence", "double")).alias("confidence"),
    )
