"""Query parsing: a model's JSON, validated; synonym rules; the canonical word."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T

_log = logging.getLogger(__name__)


def known_tags(chunks: DataFrame) -> DataFrame:
    """tag: the distinct tags of the index."""
    return chunks.select(F.col("disaster_type").alias("tag")).distinct()


def unknown_synonyms(chunks: DataFrame) -> DataFrame:
    """Tags of the synonym table that the index lacks; should be empty."""
    spark = chunks.sparkSession
    return spark.createDataFrame([(t,) for t in C.SYNONYMS], "tag string").join(known_tags(chunks), "tag", "left_anti")


def parser_messages(query: Column, tags: list[str]) -> Column:
    """The chat for a parsing model: instructions, six examples (a typo, a colloquial hazard, one of several words, none, an
    indirect one, off topic), the query."""
    rules = (
        "Correct spelling and phrasing of the user's query without adding or answering anything, and name the hazard it is about. "
        f"Allowed hazards: {', '.join(tags)}; null if none fits. Reply with JSON only: "
        '{"normalized": "<query>", "disaster_type": "<hazard or null>"}'
    )
    shots = (
        ("is my bilding safe in a erthquake", '{"normalized": "is my building safe in an earthquake", "disaster_type": "earthquake"}'),
        ("everything started to shake", '{"normalized": "everything started to shake", "disaster_type": "earthquake"}'),
        ("when to leave home in a wild fire", '{"normalized": "when to leave home in a wildfire", "disaster_type": "wildfire"}'),
        ("can i eat frozen food if the lights were out all night", '{"normalized": "can I eat frozen food if the lights were out all night", "disaster_type": "power_outage"}'),
        ("list for emergancy bag", '{"normalized": "list for emergency bag", "disaster_type": null}'),
        ("best pizza in town", '{"normalized": "best pizza in town", "disaster_type": null}'),
    )
    turns = [("system", rules), *[t for a, b in shots for t in (("user", a), ("assistant", b))]]
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*[message(r, F.lit(c)) for r, c in turns], message("user", query))


def validate(raw: Column, known: Column) -> Column:
    """normalized and disaster_type of a model's reply, or null if it isn't valid.

    The reply's outermost braces must hold JSON with a non-blank string and a tag that is null or known; any other tag spoils
    the whole reply.  The tag general counts as null.
    """
    v = F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    text, tag = (F.try_variant_get(v, f"$.{n}", "string") for n in ("normalized", "disaster_type"))
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("VOID"))
    tag_ok = (kind("disaster_type") == "VOID") | ((kind("disaster_type") == "STRING") & F.array_contains(known, tag))
    ok = (kind("normalized") == "STRING") & ~T.is_blank(text) & tag_ok
    return F.when(ok, F.struct(T.strip(text).alias("normalized"), F.when(tag != C.GENERAL, tag).alias("disaster_type")))


def parse_queries(queries: DataFrame, chunks: DataFrame, *, rules_on_failure: bool = False) -> DataFrame:
    """query_id, original, rewritten, disaster_type for queries (query_id, query, raw: a model's reply or null).

    A blank query comes back as it is.  If the reply is missing or not valid, the query passes untagged (or, if asked,
    goes through the rules all the same).  An untagged one gets the first tag of which it has a synonym, and the tag's
    name is appended if it isn't in the text.
    """
    known = known_tags(chunks).agg(F.array_sort(F.collect_set("tag")).alias("_known"))  # one row with the few tags
    step = queries.crossJoin(F.broadcast(known)).withColumn("_original", T.strip(F.col("query")))
    step = step.withColumn("_parsed", validate(F.coalesce("raw", F.lit("")), F.coalesce("_known", F.array().cast("array<string>"))))
    failed = F.col("_parsed").isNull()
    text = F.when(failed, F.col("_original")).otherwise(F.col("_parsed.normalized"))
    step = step.withColumns({"_text": text, "_use_rules": F.lit(rules_on_failure) | ~failed})
    step = step.withColumn("_tag", F.when(F.col("_use_rules"), F.coalesce(F.col("_parsed.disaster_type"), T.first_tag(F.col("_text"), C.SYNONYMS))))
    blank = F.col("_original") == ""
    return step.select(
        "query_id",
        F.when(blank, F.col("query")).otherwise(F.col("_original")).alias("original"),
        F.when(blank, F.col("query")).otherwise(T.append_canonical(F.col("_text"), F.col("_tag"))).alias("rewritten"),
        F.when(~blank, F.col("_tag")).alias("disaster_type"),
    )


def with_replies(queries: DataFrame, chunks: DataFrame, chat: Callable[[list[dict[str, str]]], str]) -> DataFrame:
    """queries with raw: what a parsing model replies to each query that isn't blank; null if it fails, which is logged."""
    tags = sorted(r["tag"] for r in known_tags(chunks).where("tag is not null").collect())  # the few tags
    asked = queries.where(~T.is_blank(F.coalesce("query", F.lit("")))).select("query_id", parser_messages(F.col("query"), tags).alias("messages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for messages in batch["messages"]:
                try:
                    replies.append(chat([dict(m) for m in messages]))
                except Exception:  # a model may fail in any way; the query then passes untagged
                    _log.exception("the parsing model failed")
                    replies.append(None)
            yield pd.DataFrame({"query_id": batch["query_id"], "raw": replies})

    return queries.join(asked.mapInPandas(run, "query_id long, raw string"), "query_id", "left")


def identity_reply(query: Column) -> Column:
    """The default model: the query as it is, untagged, as JSON."""
    return F.to_json(F.struct(query.alias("normalized"), F.lit(None).cast("string").alias("disaster_type")), {"ignoreNullFields": "false"})
