"""WARC archives: writing, reading and revisit resolution.

Records are written by Spark's text writer, gzip-compressed, so that any store Spark can write to will do and a failed
task leaves nothing behind.  A row of the writer is a batch: a warcinfo record and page records of some MB together (the
last line end is the writer's separator); an archive holds a bounded number of batches, so its bytes are bounded whatever
the sizes of the pages.  Archives are read as whole files.  Revisit resolution shuffles headers by payload digest; the groups decide which record stays a
response, and payloads only meet the list of revisit records when the new archives are written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import join_skewed, materialize, workspace

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "record_id string, record_type string, page_id long, date string, uri string, payload_digest string, payload_bytes long, refers_to long"

#: Bytes after which a batch of records ends, and batches in an archive: 32 MB, and what the last records of batches exceed.
BATCH_BYTES, ARCHIVE_BATCHES = 4 << 20, 8
INFO = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """A URL without control characters or spaces, which would break the header."""
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "urn:unknown")


def record(
    kind: str, record_id: str, page_id: int | None, uri: str, digest: str, length: int, payload: bytes = b"", *, date: str = "1970-01-01T00:00:00Z", refers_id: str | None = None, refers_page: int | None = None, refers_date: str | None = None
) -> bytes:
    """A record without its last line end.  length is that of the full payload, which revisit records leave out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_id}>"]
        if refers_date is not None:
            head.append(f"WARC-Refers-To-Date: {refers_date}")
        if refers_page is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_page}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n"


def info_record(record_id: str, date: str) -> bytes:
    """A warcinfo record without its last line end."""
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(INFO)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + INFO + b"\r\n"


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, HTTP headers and payload of each record; lengths, not separators, end a record's content."""
    buffer = bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            more = next(pieces, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        if not fill(8):
            if bytes(buffer).strip():
                raise ValueError("archive ends inside a record")
            return
        if buffer[:2] == b"\r\n":
            continue
        if buffer[:5] != b"WARC/":
            raise ValueError("no record where one should begin")
        at = 8192
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(at):
                if buffer.find(b"\r\n\r\n") < 0:
                    raise ValueError("archive ends inside a header")
            at *= 2
        head = dict(line.split(": ", 1) for line in buffer[:end].decode().split("\r\n")[1:])
        size = end + 4 + int(head["Content-Length"])
        if not fill(size):
            raise ValueError("archive ends inside a record")
        http, _, payload = bytes(buffer[end + 4 : size]).partition(b"\r\n\r\n")
        del buffer[:size]
        yield head, http, payload


def _inflate(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Decompresses one gzip member or several; plain bytes pass."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        d = zlib.decompressobj(31)
        piece = d.decompress(raw, step)
        while piece:
            yield piece
            piece = d.decompress(d.unconsumed_tail, step)
        raw = d.unused_data


def _read(with_payload: bool):
    names = [x.split()[0] for x in HEADERS.split(", ")] + ["payload"] * with_payload
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * with_payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                rows, size = [], 0
                for head, http, payload in parse(_inflate(content.as_buffer().to_pybytes())):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    whole = lambda name: int(head[name]) if name in head else None
                    rows.append((head["WARC-Record-ID"].strip("<>"), head["WARC-Type"], whole("X-Page-ID"), head["WARC-Date"], head["WARC-Target-URI"], head["WARC-Payload-Digest"].removeprefix("sha1:"), length, whole("X-Refers-To-Page-ID")) + (payload,) * with_payload)
                    size += len(payload) if with_payload else 200
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    return read


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit record of the archives in a folder: the columns of HEADERS, and the payload if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read(with_payload), HEADERS + ", payload binary" * with_payload)


def write_archives(batches: DataFrame, path: str, *, archive_batches: int = ARCHIVE_BATCHES) -> None:
    """Writes a binary column of batches as gzip-compressed archives of at most archive_batches batches each."""
    rows = batches.select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", archive_batches).mode("overwrite").text(path)


def _batched(records: Iterator[bytes], batch_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    """Rows of a warcinfo record and records of at least batch_bytes together, but for the last row."""
    held: list[bytes] = []
    size = 0

    def row() -> pa.RecordBatch:
        raw = b"\r\n".join([info_record(f"urn:uuid:{uuid.uuid4()}", date), *held])
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["value"])

    for x in records:
        held.append(x)
        size += len(x)
        if size >= batch_bytes:
            yield row()
            held, size = [], 0
    if held:
        yield row()


def _crawl(space: uuid.UUID, date: str, batch_bytes: int):
    """A response record for each page; its id comes from the row's number and this crawl's own name space."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page_id, url, html, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                payload = html.as_buffer().to_pybytes()
                yield record("response", f"urn:uuid:{uuid.uuid5(space, str(row))}", page_id, _uri(url), digest_of(payload), len(payload), payload, date=date)

    return lambda batches: _batched(records(batches), batch_bytes, date)


def crawl_to_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None, batch_bytes: int = BATCH_BYTES) -> None:
    """Writes pages as response records; date (default: now) is when they were fetched."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.coalesce(F.col(html_col), F.lit("")).cast("binary"), F.monotonically_increasing_id())
    write_archives(rows.mapInArrow(_crawl(uuid.uuid4(), date or now(), batch_bytes), "value binary"), path)


def _fresh(date: str, batch_bytes: int):
    """Records with fresh headers; of a revisit the date is still that of its own fetch."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for r in batch.to_pylist():
                revisit = r["refers_id"] is not None
                refers = {"refers_id": r["refers_id"], "refers_page": r["refers_to"], "refers_date": r["refers_date"]} if revisit else {}
                yield record("revisit" if revisit else "response", r["record_id"], r["page_id"], r["uri"], r["payload_digest"], r["payload_bytes"], r["payload"] or b"", date=r["date"], **refers)

    return lambda batches: _batched(records(batches), batch_bytes, date)


def resolve_revisits(spark: SparkSession, crawl: str, path: str, *, min_bytes: int = 0, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rewrites the archives in crawl to path, where equal payloads of min_bytes or more are stored once; returns the headers.

    Payloads are equal if digest and length are.  The record with the smallest page id stays a response (null ids come
    last, then the record id decides); the others become revisit records that refer to it.
    """
    at = workspace(spark, "warc-headers")
    headers = materialize(read_archives(spark, crawl), f"{at}/headers").drop("refers_to")
    long_enough = F.col("payload_bytes") >= min_bytes
    key = F.struct(F.col("page_id").isNull().alias("null"), "page_id", "record_id", "date")
    firsts = headers.where(long_enough).groupBy("payload_digest", "payload_bytes").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1").select("payload_digest", "payload_bytes", "n", F.col("first.record_id").alias("refers_id"), F.col("first.page_id").alias("refers_to"), F.col("first.date").alias("refers_date")), f"{at}/firsts")
    joined = join_skewed(headers, firsts, ["payload_digest", "payload_bytes"], "n", headers.count())
    later = F.coalesce(F.col("refers_id") != F.col("record_id"), F.lit(False))
    revisits = materialize(joined.where(later).drop("n"), f"{at}/revisits")

    responses = read_archives(spark, crawl, with_payload=True).drop("refers_to").join(revisits.select("record_id"), "record_id", "left_anti")
    cols = ["record_id", "page_id", "date", "uri", "payload_digest", "payload_bytes"]
    none = {"refers_id": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long"), "refers_date": F.lit(None).cast("string")}
    rows = responses.select(*cols, "payload").withColumns(none).unionByName(revisits.select(*cols, F.lit(None).cast("binary").alias("payload"), "refers_id", "refers_to", "refers_date"))
    write_archives(rows.mapInArrow(_fresh(now(), batch_bytes), "value binary"), path)
    return read_archives(spark, path)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Writes pages to archives in the shared folder, resolves revisits and reads the result: one row per page, HEADERS.

    A null html counts as an empty payload, a null url as urn:unknown.  Null page ids come last when the response is
    chosen; of repeated rows one is the response.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = pages.sparkSession
    at = workspace(spark, "warc")
    crawl_to_archives(pages, f"{at}/crawl", id_col=id_col, url_col=url_col, html_col=html_col, batch_bytes=batch_bytes)
    return resolve_revisits(spark, f"{at}/crawl", f"{at}/archive", min_bytes=min_bytes, batch_bytes=batch_bytes)
