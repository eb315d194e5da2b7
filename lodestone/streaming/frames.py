"""Event streams that arrive in pieces: keyed state puts the pieces of each stream together and lets its whole events go.

A piece may end anywhere, inside a character too, and may come before those that precede it.  The state of a stream is the unfinished
line, the number of lines so far, and the pieces that wait for an earlier one; it lives in the query's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "stream_id long, line_no int, type string, text string, gated boolean, top_score double"
_STATE = "next long, lines int, tail binary, waiting array<long>, pieces array<binary>"


def event_of(line: bytes) -> tuple | None:
    """type, text, gated, top_score of a data line; None of any other line; fields of another kind, and all of what isn't JSON, are null."""
    if not line.startswith(b"data: "):
        return None
    try:
        found = json.loads(line[6:])
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    number = found.get("top_score")
    text = lambda key: found[key] if isinstance(found.get(key), str) else None
    return (text("type"), text("text"), found["gated"] if isinstance(found.get("gated"), bool) else None, float(number) if isinstance(number, (int, float)) and not isinstance(number, bool) else None)


class Assembly:
    """What is known of one stream."""

    def __init__(self, first: int = 0, lines: int = 0, tail: bytes = b"", waiting: dict[int, bytes] | None = None) -> None:
        self.next, self.lines, self.tail, self.waiting = first, lines, tail, dict(waiting or {})

    def take(self, pieces: list[tuple[int, bytes]]) -> list[tuple]:
        """The events that the pieces (number from 0, bytes) complete, each with the number of its line; pieces that came before are passed over."""
        self.waiting.update((n, p) for n, p in pieces if n >= self.next)
        parts = [self.tail]
        while self.next in self.waiting:
            parts.append(self.waiting.pop(self.next))
            self.next += 1
        *whole, self.tail = b"".join(parts).split(b"\n")
        out = [(self.lines + i, *event) for i, event in enumerate(map(event_of, whole)) if event is not None]
        self.lines += len(whole)
        return out


def _rows(stream_id: int, events: list[tuple]) -> pd.DataFrame:
    """A stream's events as one block of objects: columns of kinds of their own cost more for each stream than all the rest."""
    block = np.empty((len(events), 6), object)
    block[:] = [(stream_id, *e) for e in events]
    return pd.DataFrame(block, columns=["stream_id", "line_no", "type", "text", "gated", "top_score"], copy=False)


def _assemble(idle_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # what is unfinished now stays so
            state.remove()
            return
        held = state.get if state.exists else (0, 0, b"", [], [])
        stream = Assembly(held[0], held[1], bytes(held[2]), {n: bytes(p) for n, p in zip(held[3], held[4])})
        events = stream.take([(int(n), bytes(p)) for batch in batches for n, p in zip(batch["seq"], batch["piece"]) if p is not None])
        state.update((stream.next, stream.lines, stream.tail, list(stream.waiting), list(stream.waiting.values())))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if events:
            yield _rows(key[0], events)

    return run


def assembled_events(pieces: DataFrame, *, idle_ms: int | None = None) -> DataFrame:
    """stream_id, line_no, type, text, gated, top_score for a stream of pieces (stream_id, seq, piece): see generation.parse_sse.

    Each piece has its stream's number and its own from 0; one that comes again is passed over.  Rows without stream_id or seq, or with a
    null piece, are left out.  With idle_ms a stream without new pieces for that long is forgotten, with what is unfinished; its later pieces
    would begin a new stream.  Such a query looks for idle streams again and again, so it suits a trigger that goes on, and never ends
    under availableNow.
    """
    known = pieces.where("stream_id IS NOT NULL AND seq IS NOT NULL AND piece IS NOT NULL").select("stream_id", "seq", "piece")
    return known.groupBy("stream_id").applyInPandasWithState(_assemble(idle_ms), EVENTS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
