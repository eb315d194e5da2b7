"""Schemas of the engine's tables."""

CHUNK = "id LONG, text STRING, source STRING, page INT, disaster_type STRING"
VECTOR = "id LONG, embedding ARRAY<FLOAT>"
POSTING = "term STRING, id LONG, tf LONG, dl LONG"
HIT = "STRUCT<chunk_id: LONG, text: STRING, source: STRING, page: INT, disaster_type: STRING, score: DOUBLE>"
RETRIEVAL = f"query_id LONG, hits ARRAY<{HIT}>, top_score DOUBLE, gated BOOLEAN, message STRING"
PARSED = "query_id LONG, original STRING, rewritten STRING, disaster_type STRING"
ANSWER = f"query_id LONG, answer STRING, citations ARRAY<{HIT}>, gated BOOLEAN, top_score DOUBLE"
EVENT = f"query_id LONG, seq INT, type STRING, text STRING, gated BOOLEAN, top_score DOUBLE, citations ARRAY<{HIT}>"
GOLD = "query STRING, disaster_type STRING, relevant_ids ARRAY<LONG>, notes STRING"
WORD_BOX = "page INT, text STRING, x0 DOUBLE, x1 DOUBLE, top DOUBLE"
REQUEST = "query_id LONG, query STRING"
GEO_FEATURES = "features ARRAY<STRUCT<geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, properties: STRUCT<OBJECTID: LONG, NAME: STRING, ADDRESS: STRING>>>"
