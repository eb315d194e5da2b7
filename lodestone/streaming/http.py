"""Answers over HTTP: POST /answer, POST /stream (server-sent events), GET /health; and a proxy in front of them.

For one user at a time on the driver, like the command line; streams of requests go through streaming.answers.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators import generation as G
from lodestone.operators.index import Index
from lodestone.plans.retrieve import answer, grounded, prepared


def checked_query(body: bytes) -> tuple[int, dict]:
    """200 and the query, or 400 and an error, for a request's body."""
    try:
        payload = json.loads(body)
    except ValueError:
        return 400, {"error": "invalid json"}
    query = payload.get("query") if isinstance(payload, dict) else None
    if not isinstance(query, str) or not query.strip():
        return 400, {"error": "query required"}
    return 200, {"query": query}


class Service:
    """Answers of an index for one query at a time."""

    def __init__(self, spark: SparkSession, index: Index, *, model: G.Model | None = None, stream: G.Stream | None = None, chat=None, embed=None) -> None:
        self.spark, self.index, self.model, self.stream, self.chat, self.embed = spark, index, model, stream, chat, embed

    def _prepared(self, query: str):
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return prepared(asked, self.index, self.embed, chat=self.chat)

    def answer(self, query: str) -> dict:
        row = answer(self._prepared(query), self.index, model=self.model).first().asDict(recursive=True)
        return {k: row[k] for k in ("answer", "gated", "top_score", "citations")}

    def events(self, query: str) -> Iterator[dict]:
        """meta as soon as retrieval has ended, tokens as the model yields them, done."""
        row = grounded(self._prepared(query), self.index).withColumn("prompt", G.user_message(F.col("question"), F.col("hits"))).withColumn("said", G.extractive_answer(F.col("hits"))).first().asDict(recursive=True)
        yield {"type": "meta", "gated": row["gated"], "top_score": row["top_score"], "citations": [] if row["gated"] else row["hits"]}
        if row["gated"]:
            tokens = iter([row["message"] or C.LOW_CONFIDENCE_MESSAGE])
        else:
            tokens = G.token_stream(self.stream, row["prompt"]) if self.stream else iter([row["said"]])
        for token in tokens:
            yield {"type": "token", "text": token}
        yield {"type": "done"}


def _frame(event: dict) -> bytes:
    return f"data: {json.dumps(event, ensure_ascii=False)}\n\n".encode()


class _Handler(BaseHTTPRequestHandler):
    def log_message(self, *args) -> None:
        pass

    def _body(self) -> bytes:
        return self.rfile.read(int(self.headers.get("Content-Length") or 0))

    def _json(self, status: int, payload: dict) -> None:
        raw = json.dumps(payload, ensure_ascii=False).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def _events(self, frames: Iterator[bytes]) -> None:
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.send_header("Cache-Control", "no-cache")
        self.end_headers()
        for frame in frames:
            self.wfile.write(frame)
            self.wfile.flush()


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of the service; serve_forever() starts it."""

    class Handler(_Handler):
        def do_GET(self) -> None:
            self._json(*((200, {"ok": True}) if self.path == "/health" else (404, {"error": "not found"})))

        def do_POST(self) -> None:
            status, asked = checked_query(self._body())
            if self.path not in ("/answer", "/stream"):
                self._json(404, {"error": "not found"})
            elif status != 200:
                self._json(status, asked)
            elif self.path == "/answer":
                self._json(200, service.answer(asked["query"]))
            else:
                self._events(map(_frame, service.events(asked["query"])))

    return ThreadingHTTPServer((host, port), Handler)


def proxy(backend: str, host: str = "127.0.0.1", port: int = 3000, timeout: float = 600) -> ThreadingHTTPServer:
    """Checks requests, passes them to the backend's /stream and its events straight back; 502 if it can't be reached."""

    class Handler(_Handler):
        def do_POST(self) -> None:
            status, asked = checked_query(self._body())
            if status != 200:
                self._json(status, asked)
                return
            request = urllib.request.Request(f"{backend}/stream", json.dumps(asked).encode(), {"Content-Type": "application/json"})
            try:
                upstream = urllib.request.urlopen(request, timeout=timeout)
            except urllib.error.HTTPError as e:
                self._json(e.code, {"error": "backend error"})
                return
            except OSError as e:
                self._json(502, {"error": "backend unreachable", "detail": str(e)})
                return
            with upstream:
                self._events(iter(upstream.readline, b""))

    return ThreadingHTTPServer((host, port), Handler)
