"""WARC derivatives (operator 1): metadata and plain-text conversion records of response records.

A response record is a row with its header fields and its HTTP block; ``read_responses`` gets them from WARC
files, ``responses`` makes them of a table of pages. For each of them two records are derived, linked by
WARC-Refers-To to the response and to each other by WARC-Concurrent-To:

* ``metadata`` (application/warc-fields): source headers of the response, lengths, title and links;
* ``conversion`` (text/plain): the text of the page without scripts, styles, comments and tags.

Record ids are derived from the response's id, so a repeated run writes the same records. Both carry the
response's target, date and payload digest and their own block digest (SHA-1 in base 32, as the format's
examples have it). Work is row-local; ``write_records`` lets Spark write WARC files, a part a task; with
compression a file is one gzip member.

Defined results: a null or empty page has an empty payload and an empty text; a null url has no target
header; rows with a null id get an id from url and payload; repeated rows give the same records again;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.llm.markup import CODE, OPEN, TEXT, Scan
from taxlake.llm.shared import only

#: Namespace of the derived record ids.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
SERVER_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

#: Elements that start and end a line; cells of a table are parted by a blank.
BREAKS = frozenset(
    "p div br hr li ul ol dl dt dd tr table h1 h2 h3 h4 h5 h6 article section main nav header footer aside form blockquote pre".split()
)
CELLS = frozenset(("td", "th"))
_HREF = re.compile(r"""(?i)(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _one_line(value: str) -> str:
    return " ".join(value.split())


def page_parts(page: str) -> tuple[str, str | None, list[str]]:
    """(visible text, a line a block without empty lines; first title; links) of a page, in one scan."""
    parts, links, title = [], [], None
    for kind, name, rest in Scan(page):
        if kind == TEXT:
            parts.append(rest)
        elif kind == CODE and name in ("title", "textarea"):
            parts.append(f"\n{rest}\n")
            if name == "title" and title is None:
                title = _one_line(entities.unescape(rest))
        elif name in BREAKS:
            parts.append("\n")
        elif name in CELLS:
            parts.append(" ")
        elif kind == OPEN and name == "a":
            found = _HREF.search(rest)
            if found:
                links.append(_one_line(entities.unescape(next(g for g in found.groups() if g is not None))))
    lines = (_one_line(line) for line in entities.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line), title, links


RESPONSES = (
    "page_id long, record_id string, target_uri string, date string, payload_digest string, block_digest string, "
    "http_headers string, payload binary"
)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    shape = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    columns = zip(*rows) if rows else [[] for _ in shape]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of the rows of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload = (page or "").encode()
                head = SERVER_HEADERS.format(len(payload))
                name = digest(payload) if page_id is None else f"{page_id}"
                record_id = uuid.uuid5(SPACE, f"response {name} {url}")
                out.append(
                    (page_id, f"<urn:uuid:{record_id}>", url, DATE, digest(payload), digest(head.encode() + payload), head, payload)
                )
            yield _batch(out, RESPONSES)

    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, RESPONSES)


def parsed_response(record: bytes) -> tuple | None:
    """The row of a response record; None for other kinds and for what is no record.

    A header line that starts with a blank continues the one before it. The block ends where Content-Length
    says, or with the record.
    """
    head, _, block = record.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += f" {line.strip()}"
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
    if fields.get("warc-type", "").lower() != "response":
        return None
    length = fields.get("content-length", "")
    block = block[: int(length)] if length.isdigit() else block
    http, mark, payload = block.partition(b"\r\n\r\n")
    return (
        None, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"),
        fields.get("warc-payload-digest") or digest(payload), fields.get("warc-block-digest") or digest(block),
        (http + mark).decode("utf-8", "replace"), payload,
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, plain or gzip. Spark cuts the files at the heads of records.

    A file is never in memory as a whole. page_id is null. A payload that itself holds two line ends and
    ``WARC/`` ends there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([r for r in map(parsed_response, batch.column(0).to_pylist()) if r], RESPONSES)

    records = spark.read.option("lineSep", "\r\n\r\nWARC/").text(path).select(F.col("value").cast("binary").alias("value"))
    return records.mapInArrow(run, RESPONSES)


DERIVED = (
    "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, "
    "date string, payload_digest string, block_digest string, content_type string, content_length long, block string"
)


def _derivatives(page_id, record_id, target, date, payload_digest, _, headers, payload) -> Iterator[tuple]:
    payload = payload or b""
    text, title, links = page_parts(payload.decode("utf-8", "replace"))
    source = [line for line in re.split(r"\r\n(?![ \t])", headers or "") if line.strip()]
    fields = [f"http-status: {_one_line(source[0])}"] if source else []
    fields += [f"http-header: {_one_line(line)}" for line in source[1:]]
    fields += [f"payload-length: {len(payload)}", f"text-length: {len(text.encode())}"]
    fields += [f"title: {title}"] if title is not None else []
    fields += [f"outlink: {link}" for link in links]
    ids = {kind: f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {record_id}')}>" for kind in ("metadata", "conversion")}
    for kind, other, mime, block in (
        ("metadata", "conversion", "application/warc-fields", "\r\n".join(fields) + "\r\n"),
        ("conversion", "metadata", "text/plain; charset=utf-8", text),
    ):
        raw = block.encode()
        yield page_id, kind, ids[kind], record_id, ids[other], target, date, payload_digest, digest(raw), mime, len(raw), block


def derived(records: DataFrame) -> DataFrame:
    """Two records for every response record: ``metadata`` and ``conversion``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = zip(*(c.to_pylist() for c in batch.slice(start, 512).columns))
                yield _batch([d for r in rows for d in _derivatives(*r)], DERIVED)

    return only(records, *(c.split()[0] for c in RESPONSES.split(", "))).mapInArrow(run, DERIVED)


def serialised(records: DataFrame) -> DataFrame:
    """(page_id, record_type, value): the whole record without the two line ends that close it."""
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Concurrent-To: "), "concurrent_to"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Refers-To-Payload-Digest: "), "payload_digest"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return records.select("page_id", "record_type", F.concat(header, F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derived records as WARC files under ``path``."""
    serialised(records).select("value").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
