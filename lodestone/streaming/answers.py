"""Serving: a stream of requests in, a stream of events out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import generation as G
from lodestone.operators.index import Index
from lodestone.plans.retrieve import answer, answer_stream, prepared
from lodestone.schemas import REQUEST


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests (query_id, query) from JSON files that arrive in a folder."""
    return spark.readStream.schema(REQUEST).json(path)


def serve(requests: DataFrame, index: Index, out: str, checkpoint: str, *, model: G.Model | None = None, stream: G.Stream | None = None, chat=None, available_now: bool = True, sse: bool = False) -> StreamingQuery:
    """Writes the events (or their SSE frames) of each micro-batch of requests as JSON below out, a folder for each batch.

    model answers at once, stream token by token; chat parses the queries.

    A batch is written again under its own name if it is retried, so its events stand there once.  Ranking needs windows
    over the whole batch, which a streaming plan doesn't allow; so each batch runs as an ordinary query.
    """

    def batch(rows: DataFrame, number: int) -> None:
        asked = rows.where(F.trim(F.coalesce("query", F.lit(""))) != "")
        queries = prepared(asked, index, chat=chat)
        told = answer_stream(queries, index, stream) if stream else G.events(answer(queries, index, model=model))
        rows_out = G.sse_frames(told) if sse else told
        rows_out.write.mode("overwrite").json(f"{out}/batch={number}")

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
