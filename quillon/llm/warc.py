"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives one ``metadata`` record (application/warc-fields: title,
language, charset, outlinks, the source's digests, HTTP headers and WARC headers)
and one ``conversion`` record (text/plain). Both carry the response's record id
in WARC-Refers-To, with its target URI and date, the source's digests and a
digest of their own block.

Payloads are bytes. The source's WARC-Payload-Digest and WARC-Block-Digest are
carried through as they are; only where the source states no payload digest is
one taken, of the payload's bytes. Text is decoded by the charset of the HTTP
headers, else of the markup, else as UTF-8, with a replacement character for
bytes that are none.

Reading skips what is no record (no version line, no or a wrong Content-Length, a
block cut short, a broken gzip member) and goes on with the next version line or
member; ``read_records`` returns these places with the reason in ``error``.

Defined results: a response without a body gives an empty conversion; a null
URI leaves WARC-Target-URI out; repeated rows give repeated records with equal
ids; an empty table gives an empty result. Only the columns named by the
arguments are read. Markup is read up to ``<`` or ``>``, in time linear in its
length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Elements that end a line of text.
BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I)
TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
CHARSET = re.compile(r"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
FIELDS = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "source_block_digest", "source_headers", "block")
SCHEMA = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_block_digest string, source_headers string, block string"


#: Columns of a response record besides its id.
RECORD = ("record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest", "block_digest", "warc_headers")


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id whenever a record is made again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(markup: str) -> str:
    """Text of a page: no comments, scripts or styles; a line for each block element."""
    text = DROPPED.sub(" ", markup)
    text = TAG.sub("", BLOCK.sub("\n", text.replace("\n", " ")))
    if "&" in text:
        text = html.unescape(text)
    return LINES.sub("\n", BLANKS.sub(" ", text)).strip()


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def metadata_block(markup: str, uri: str | None, headers: str, payload_digest: str, block_digest: str | None = None, warc_headers: dict[str, str] | None = None) -> str:
    """application/warc-fields of a page: one field a line, outlinks in order and once each."""
    fields = []
    for name, pattern in (("title", TITLE), ("languages", LANGUAGE), ("charset", CHARSET)):
        if m := pattern.search(markup):
            fields.append((name, one_line(m[1])))
    fields.append(("source-payload-digest", payload_digest))
    if block_digest:
        fields.append(("source-block-digest", block_digest))
    fields += [("source-header", h) for h in headers.split("\r\n") if h]
    fields += [("source-warc-header", f"{k}: {v}") for k, v in (warc_headers or {}).items()]
    live = DROPPED.sub(" ", markup)
    links = dict.fromkeys(html.unescape(a or b or c).strip() for a, b, c in LINK.findall(live))
    for link in links:
        try:
            fields.append(("outlink", "".join(urljoin(uri or "", link).split()) + " L a/@href"))
        except ValueError:  # not a URI
            fields.append(("outlink", one_line(link) + " L a/@href"))
    return "".join(f"{k}: {v}\r\n" for k, v in fields)


def decoded(payload: bytes, http_headers: str) -> str:
    """Text of a payload: unpacked if Content-Encoding says so, by the charset of the headers, else of the markup, else UTF-8."""
    if re.search(r"(?im)^content-encoding:\s*(?:x-)?gzip", http_headers) or payload[:2] == b"\x1f\x8b":
        try:
            payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:  # not packed after all
            pass
    m = re.search(r"(?im)^content-type:[^\r\n]*charset=[\"']?([\w-]+)", http_headers) or CHARSET.search(payload[:4096].decode("latin-1"))
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except (LookupError, ValueError):  # an unknown charset
        return payload.decode("utf-8", "replace")


def _derived(source_id: str, uri: str | None, date: str, headers: str, payload: bytes, payload_digest: str | None, block_digest: str | None, warc_headers: dict[str, str]) -> list[tuple]:
    payload_digest = payload_digest or digest(payload)
    markup = decoded(payload, headers)
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", metadata_block(markup, uri, headers, payload_digest, block_digest, warc_headers)), ("conversion", "text/plain; charset=utf-8", plain_text(markup))):
        data = block.encode("utf-8", "replace")
        own = digest(data)
        out.append((kind, record_id(kind, source_id, own), source_id, uri, date, content_type, len(data), own, payload_digest, block_digest, headers, data.decode("utf-8")))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages: id, and RECORD. Record ids and headers follow from the row, so that reruns agree."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    name = F.sha2(F.concat_ws("\0", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(uri_col), F.lit("")), F.sha2(body, 256)), 256)
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(name, 1, 32), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-8$3-a$4-$5"), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    own = {"record_id": urn, "target_uri": F.col(uri_col).cast("string"), "warc_date": F.lit(date), "http_headers": headers, "payload": body, "payload_digest": F.lit(None).cast("string"), "block_digest": F.lit(None).cast("string"), "warc_headers": F.lit(None).cast("map<string,string>")}
    return pages.select(F.col(id_col).alias("id"), *(own[c].alias(c) for c in RECORD))


def derivatives(records: DataFrame, id_col: str = "id") -> DataFrame:
    """Two rows for each response record (id and RECORD): id and FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                rows = [(i, *r) for i, s, u, d, h, b, pd, bd, w in zip(*(c.to_pylist() for c in part.columns)) for r in _derived(s or "", u, d or DATE, h or "", b or b"", pd, bd, dict(w or ()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [part.schema.field(0).type, *[pa.string()] * 6, pa.int64(), *[pa.string()] * 5])], names=["id", *FIELDS])

    rows = records.select(F.col(id_col).alias("id"), *(F.col(c).cast("binary") if c == "payload" else c for c in RECORD))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")


def serialized(record: dict) -> bytes:
    """One WARC/1.1 record of a row of FIELDS."""
    data = record["block"].encode("utf-8")
    head = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["warc_date"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record["refers_to"]), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Source-Payload-Digest", record["source_payload_digest"]), ("WARC-Source-Block-Digest", record["source_block_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(len(data)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v).encode("utf-8") + b"\r\n" + data + b"\r\n\r\n"


def members(data: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """Place, contents and error of each gzip member; after a broken one, of the next that can be opened. Other data are one member."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data, None
        return
    at = 0
    while 0 <= at < len(data):
        unpack = zlib.decompressobj(31)
        try:
            out = unpack.decompress(memoryview(data)[at:])
            error = None if unpack.eof else "a gzip member is cut short"
            after = len(data) - len(unpack.unused_data) if unpack.eof else len(data)
        except zlib.error:
            out, error, after = b"", "a broken gzip member", at + 2
        yield at, out, error
        at = data.find(b"\x1f\x8b\x08", after)


def parsed(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Place (of its gzip member, else of itself), headers by name, block and error of each record of a WARC file; with an error, what follows is read from the next version line on."""
    for place, body, broken in members(data):
        if broken:
            yield place, {}, b"", broken
        packed, at = data[:2] == b"\x1f\x8b", 0
        while at < len(body):
            if body[at : at + 1] in b"\r\n":
                at += 1
                continue
            here, error, head = place if packed else at, None, {}
            end = re.compile(rb"\r?\n\r?\n").search(body, at)
            if body[at : at + 5] != b"WARC/":
                error = "no version line"
            elif not end:
                error = "no end of headers"
            else:
                last = ""
                for line in body[at : end.start()].splitlines()[1:]:
                    if line[:1] in b" \t" and last:
                        head[last] += " " + line.decode("utf-8", "replace").strip()
                    else:
                        name, _, value = line.decode("utf-8", "replace").partition(":")
                        last = name.strip()
                        head[last] = value.strip()
                length = next((v for k, v in head.items() if k.lower() == "content-length"), "")
                if not (length.isascii() and length.isdigit()):
                    error = "no or a wrong Content-Length"
                elif end.end() + int(length) > len(body):
                    error = "a block is cut short"
            if error is None:
                stop = end.end() + int(length)
                yield here, head, body[end.end() : stop], None
                at = stop
            else:
                yield here, head, b"", error
                following = re.compile(rb"(?:^|\n)(?=WARC/\d)").search(body, at + 1)
                at = following.end() if following else len(body)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files (file, place, id, RECORD, error): error is null, or says why the place holds no record.

    One file is one row and is read by one task: at most 2 GB, as WARC files of
    the usual 1 GB are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.string()] * 4, pa.binary(), *[pa.string()] * 2, pa.map_(pa.string(), pa.string()), pa.string()]
        names = ["file", "place", "id", *RECORD, "error"]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for place, head, block, error in parsed(content.as_py()):
                    h = {k.lower(): v for k, v in head.items()}
                    if error is None and h.get("warc-type") != "response":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    own = h.get("warc-record-id")
                    row = [file, place, (own or "").strip("<>"), own, h.get("warc-target-uri"), h.get("warc-date"), http.decode("latin-1"), body, h.get("warc-payload-digest"), h.get("warc-block-digest"), list(head.items()), error]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

    schema = "file string, place long, id string, record_id string, target_uri string, warc_date string, http_headers string, payload binary, payload_digest string, block_digest string, warc_headers map<string,string>, error string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records that could be read, for derivatives(); count the others with read_records."""
    return read_records(spark, path).filter("error is null").drop("file", "place", "error")


#: A member without contents; it ends with a zero byte.
EMPTY = gzip.compress(b"", mtime=0)


def _member(record: dict) -> bytes:
    """A record as a gzip member without its last byte, which is zero: the highest of the record's size, or of an empty member's after a record of 16 MB and more."""
    data = gzip.compress(serialized(record), mtime=0)
    return data[:-1] if data[-1] == 0 else data + EMPTY[:-1]


def write_warc(derived: DataFrame, path: str) -> None:
    """Derived records as gzipped WARC files, one for each partition and a gzip member for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                yield pa.RecordBatch.from_arrays([pa.array([_member(r) for r in batch.slice(lo, 128).to_pylist()], pa.binary())], names=["value"])

    # the writer of text passes bytes as they are and puts the last byte of each member
    packed = derived.select(*FIELDS).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").text(path)
