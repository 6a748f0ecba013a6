"""WARC archives: records written, read back, and put together by capture.

Each page gives a request, a response (or a revisit of an equal payload's
response) and a metadata record; the request and the metadata name the
response's record in WARC-Concurrent-To. Archives are written by Spark's text
writer: a row is a whole record, its line end the blank lines that close a
record. So they land in any store that Spark can write to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridewise.llm.common import delete_tree, materialize, release, shared_dir

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 0
#: Closes each record.
CLOSE = "\r\n\r\n"
#: Opens each record; where the reader cuts, before it looks at lengths.
VERSION = "WARC/1.1\r\n"
#: Date of every record; a page has none.
DATE = "1970-01-01T00:00:00Z"

_NAMES = uuid.UUID("6f0e3f0c-7a51-5d3c-9d57-2f1c6a0f9b11")

_RECORD = (
    "record_id string, type string, uri string, concurrent_to string, refers_to string, refers_to_uri string, payload_digest string, "
    "payload_bytes long, page_id long, content_type string, block_bytes long, intact boolean"
)


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _identifier(kind: str, page: object, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{kind}|{page}|{digest}|{copy}')}>"


def _clean(value: object) -> str:
    """A header's value: no line ends, none empty."""
    return str(value or "").replace("\r", "%0D").replace("\n", "%0A")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"{VERSION}{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _records(batches):
    """Pages with verdicts (page_id, url, html, SHA-1 in hex, copy, of, of_url) -> their records' bytes, without the closing lines."""
    for batch in batches:
        out: list[bytes] = []
        for page, url, html, key, copy, of, of_url, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = (html or "").encode()
            digest = base64.b32encode(bytes.fromhex(key)).decode()
            uri, digest_header = _clean(url), f"sha1:{digest}"
            main = _identifier("response", page, digest, copy)
            common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest_header)]
            if revisit:
                headers += [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", _identifier("response", of, digest, 1)),
                    ("WARC-Refers-To-Target-URI", _clean(of_url)),
                ]
            out.append(_record([*headers, ("Content-Type", "application/http;msgtype=response")], head if revisit else head + payload))
            request = f"GET {uri} HTTP/1.1\r\nUser-Agent: stridewise\r\n\r\n".encode()
            out.append(
                _record(
                    [("WARC-Type", "request"), ("WARC-Record-ID", _identifier("request", page, digest, copy)), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")],
                    request,
                )
            )
            fields = f"page-id: {'' if page is None else page}\r\npayload-bytes: {len(payload)}\r\n".encode()
            out.append(
                _record(
                    [("WARC-Type", "metadata"), ("WARC-Record-ID", _identifier("metadata", page, digest, copy)), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")],
                    fields,
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a request, a response or revisit, and a metadata record for each page, as gzipped archives under ``path``.

    Of pages with equal payloads (LEAST_REVISIT_BYTES or more) that with the
    largest page_id is the response, the others revisit it. Rows that repeat
    page_id and payload are numbered; those of the response's page stay
    responses. Null html and url are empty; a null page_id counts as smaller
    than any other and is never revisited unless all are null.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.withColumns({"name": F.coalesce(F.col("page_id").cast("string"), F.lit("")), "key": F.sha1(payload)})
    # verdicts are small rows without payloads; equal payloads fold to one row in each task before the shuffle
    slim = rows.select("name", "page_id", "key", F.coalesce("url", F.lit("")).alias("url"), F.octet_length(payload).alias("bytes"))
    last = slim.where(F.col("bytes") >= LEAST_REVISIT_BYTES).groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("last"))
    # written, so that Spark can split a payload of very many pages: both sides of the join come straight from a shuffle
    last = materialize(last, "warc-last")
    verdicts = slim.join(last, "key").where("not (page_id <=> last.page_id)").select("name", "key", F.col("last.page_id").alias("of"), F.col("last.url").alias("of_url")).distinct()
    joined = rows.join(verdicts.withColumn("revisit", F.lit(True)), ["name", "key"], "left")
    order = Window.partitionBy("name", "key").orderBy(F.desc_nulls_last("url"))
    made = joined.withColumn("copy", F.row_number().over(order)).select("page_id", "url", "html", "key", "copy", "of", "of_url", F.coalesce("revisit", F.lit(False)))
    records = made.mapInArrow(_records, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", CLOSE).option("compression", "gzip").text(path)
    release(last)


def _pieces(batches):
    """Whole records, put together where a payload holds the mark that the reader cuts at."""
    mark = VERSION.encode()
    held: bytes | None = None
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            held = piece if held is None else held + mark + piece
            if not held:
                held = None
                continue
            head, blank, rest = held.partition(b"\r\n\r\n")
            length = next((int(line[15:]) for line in head.split(b"\r\n") if line[:15].lower() == b"content-length:"), 0)
            if blank and len(rest) >= length:
                yield head, rest[:length], True
                held = None
    if held:
        head, _, rest = held.partition(b"\r\n\r\n")
        yield head, rest, False


def _parsed(with_payload: bool):
    names = [part.split()[0] for part in _RECORD.split(", ")] + ["payload"] * with_payload

    def row(head: bytes, block: bytes, intact: bool) -> tuple:
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n"):
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        kind = fields.get("warc-type")
        digest, size, page, payload = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = len(payload)
            if kind == "revisit":  # its payload lies elsewhere: what its headers say
                size = next((int(line[15:]) for line in http.split(b"\r\n") if line[:15].lower() == b"content-length:"), None)
            else:
                found = payload_digest(payload)
                intact = intact and digest in (None, found)
                digest = found
        elif kind == "metadata":
            for line in block.split(b"\r\n"):
                if line.startswith(b"page-id: ") and line[9:].strip():
                    page = int(line[9:])
        values = (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-refers-to-target-uri"))
        return (*values, digest, size, page, fields.get("content-type"), len(block), intact) + ((payload,) if with_payload else ())

    def run(batches):
        kinds = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()] + [pa.binary()] * with_payload
        rows: list[tuple] = []
        for head, block, intact in _pieces(batches):
            rows.append(row(head, block, intact))
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the gzipped archives under ``path``; a file is read by one task, in order.

    intact is False for a cut record and for a payload that does not have its
    digest. payload (on demand) is that of responses.
    """
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary"))
    return pieces.mapInArrow(_parsed(with_payload), _RECORD + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata.

    A capture is a response or revisit; its request and metadata are the
    records concurrent to it, of several the one with the smallest identifier,
    null if there is none. Records that name no capture are left out.
    """
    whole = F.struct(*records.columns)
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    for kind in ("request", "metadata"):
        others = records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(whole, "record_id").alias(kind))
        main = main.join(others, "capture_id", "left")
    return main


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives of the pages to the shared folder, read them back, and return a row per capture.

    page_id, payload_bytes, payload_digest, record_type, refers_to: as the
    archives have them. An empty table gives no row.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, page_id, url, html)
    records = materialize(read_archives(spark, path), "warc-records")
    captures = materialize(assemble(records), "warc-captures")
    delete_tree(spark, path)
    release(records)
    rows = captures.select("capture_id", F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("of"))
    responses, revisits = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    # only revisits look for their response; one of very many revisits is split like any hot key
    pages_of = materialize(responses.select(F.col("capture_id").alias("of"), F.col("page_id").alias("refers_to")), "warc-responses")
    named = revisits.join(pages_of, "of", "left").drop("of", "capture_id")
    whole = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(named)


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, octet_length(b) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER), 1), '' ORDER BY k) FROM range(32) AS r(k)) AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""
