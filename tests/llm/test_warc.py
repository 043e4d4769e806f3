import base64
import gzip
import hashlib
import html.parser
import re

from quillon.llm import warc as W

PAGE = "<!DOCTYPE html><html lang=\"en\"><head><meta charset='utf-8'><title>A &amp; B</title><style>p{}</style><script>var t='</p><a href=x>';</script></head><body><!-- no --><h1>Head</h1><p>One <b>two</b>&nbsp;three<br>4 &lt; 5 < 6<p>z<a href='/rel?x=1&amp;y=2'>l</a><a href=\"/rel?x=1&amp;y=2\">again</a></body></html>"


def test_plain_text():
    assert W.plain_text(PAGE) == "A & B\nHead\nOne two three\n4 < 5 < 6\nzlagain"
    assert W.plain_text("") == "" and W.plain_text("<<<a<a") != None  # noqa: E711
    assert len(W.plain_text("<a" * 200_000)) < 500_000
    assert W.plain_text("<!-- open") == "" and W.plain_text("<script>open") == ""


def test_derivatives(spark):
    rows = [(1, "http://h.example/d/p", PAGE), (2, None, None), (2, None, None), (None, "::bad[", "<a href='http://[x'>"), (4, "http://h.example/", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as id", "'d' as record_id")
    out = W.derivatives(W.responses(pages)).collect()
    assert len(out) == 2 * len(rows)
    sources = {r.record_id: r for r in W.responses(pages).collect()}
    for r in out:
        data = r.block.encode()
        source = sources[r.refers_to]
        assert r.content_length == len(data) and r.block_digest == W.digest(data)
        assert r.source_payload_digest == W.digest(bytes(source.payload)) and r.source_headers == source.http_headers
        assert r.target_uri == source.target_uri and r.record_id != r.refers_to
    meta = next(r for r in out if r.id == 1 and r.warc_type == "metadata")
    assert meta.block.startswith("title: A & B\r\nlanguages: en\r\ncharset: utf-8\r\n") and meta.block.count("outlink: http://h.example/rel?x=1&y=2 L a/@href\r\n") == 1
    assert "source-header: HTTP/1.1 200 OK" in meta.block
    assert len({r.record_id for r in out}) == 8 and W.derivatives(W.responses(pages.limit(0))).count() == 0


def test_round_trip(spark, tmp_path):
    body = PAGE.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://h.example/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record))
    read = W.read_responses(spark, str(tmp_path / "*.warc*"))
    derived = W.derivatives(read)
    rows = derived.collect()
    assert len(rows) == 4 and {r.refers_to for r in rows} == {"<urn:uuid:1>"} and {r.warc_date for r in rows} == {"2020-01-01T00:00:00Z"}
    assert {r.source_payload_digest for r in rows} == {"sha1:" + __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()}
    W.write_warc(derived, str(tmp_path / "out"))
    back = [(h, b) for f in (tmp_path / "out").glob("part-*") for _, h, b, _ in W.parsed(f.read_bytes())]
    assert sorted((h["WARC-Type"], h["WARC-Refers-To"], b.decode()) for h, b in back) == sorted((r.warc_type, r.refers_to, r.block) for r in rows)


class Plain(html.parser.HTMLParser):
    """Text of well-formed pages by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "template", "svg")
        self.out.append("\n" if W.BLOCK.fullmatch(f"<{tag}>") else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template", "svg")
        self.out.append("\n" if W.BLOCK.fullmatch(f"</{tag}>") else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("\n", " "))


def by_parser(markup):
    p = Plain()
    p.feed(markup)
    p.close()
    lines = (" ".join(x.replace("\xa0", " ").split(" ")) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in (re.sub(r"[ \t\r\f\v]+", " ", y).strip(" ") for y in lines) if x)


def test_whole_table_against_parser(spark):
    """Every page of the table, both records, against a second version by the standard library's parser."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {(r.id, r.warc_type): r for r in W.derivatives(W.responses(pages)).collect()}
    rows = pages.collect()
    assert len(out) == 2 * len(rows) and len(rows) > 100
    for r in rows:
        text, meta = out[r.page_id, "conversion"], out[r.page_id, "metadata"]
        assert text.block == by_parser(r.html or ""), r.page_id
        data = (r.html or "").encode()
        sha = "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert text.source_payload_digest == meta.source_payload_digest == sha and text.refers_to == meta.refers_to
        assert text.target_uri == meta.target_uri == r.url and f"source-payload-digest: {sha}\r\n" in meta.block
        assert f"source-header: Content-Length: {len(data)}\r\n" in meta.block


def record(body, head, kind="response", length=None):
    length = len(body) if length is None else length
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {length}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_bytes_digests_and_bad_records(spark, tmp_path):
    """A latin-1 page with the source's digests, and files with broken places: the rest is read, the places are told."""
    page = "<html><title>caf\xe9</title><p>\xfcber</p></html>".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + page
    good = record(http, "WARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:SOURCEPAYLOAD\r\nWARC-Block-Digest: sha1:SOURCEBLOCK\r\nWARC-IP-Address: 10.0.0.1\r\n")
    plain = record(b"HTTP/1.1 200 OK\r\n\r\n" + page, "WARC-Record-ID: <urn:uuid:2>\r\n")
    junk = b"not a record\r\n"
    none = b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n"
    short = record(http, "WARC-Record-ID: <urn:uuid:9>\r\n", length=99_999)
    (tmp_path / "a.warc").write_bytes(junk + good + none + plain + short)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(none) + b"\x1f\x8b\x08broken" + gzip.compress(plain) + gzip.compress(good)[:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = W.read_records(spark, str(tmp_path / "*.warc*")).collect()
    errors = sorted((r.file[-9:].strip("/"), r.error) for r in rows if r.error)
    assert [e for f, e in errors if f.endswith("a.warc")] == ["a block is cut short", "no or a wrong Content-Length", "no version line"]
    assert {e for f, e in errors if f.endswith(".gz")} >= {"a broken gzip member", "a gzip member is cut short", "no or a wrong Content-Length"}
    whole = [r for r in rows if not r.error]
    assert sorted(r.record_id for r in whole) == ["<urn:uuid:1>"] * 2 + ["<urn:uuid:2>"] * 2 and all(bytes(r.payload) == page for r in whole)
    derived = W.derivatives(W.read_responses(spark, str(tmp_path / "*.warc*"))).collect()
    own = W.digest(page)
    assert {(r.refers_to, r.source_payload_digest, r.source_block_digest) for r in derived} == {("<urn:uuid:1>", "sha1:SOURCEPAYLOAD", "sha1:SOURCEBLOCK"), ("<urn:uuid:2>", own, None)}
    text = {r.refers_to: r.block for r in derived if r.warc_type == "conversion"}
    assert text["<urn:uuid:1>"] == "caf\xe9\n\xfcber" and "\ufffd" in text["<urn:uuid:2>"]
    meta = next(r.block for r in derived if r.warc_type == "metadata" and r.refers_to == "<urn:uuid:1>")
    assert "source-block-digest: sha1:SOURCEBLOCK\r\n" in meta and "source-warc-header: WARC-IP-Address: 10.0.0.1\r\n" in meta


def test_one_member_for_each_record(spark, tmp_path):
    big = "x " * 9_000_000
    pages = spark.createDataFrame([(1, "http://h/", PAGE), (2, None, None), (3, "http://h/3", big)], "page_id long, url string, html string").coalesce(1)
    derived = W.derivatives(W.responses(pages))
    W.write_warc(derived, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    data = file.read_bytes()
    found = [x for _, x, error in W.members(data) if not error and x]
    assert len(found) == 6 and all(len(list(W.parsed(x))) == 1 for x in found)
    assert gzip.decompress(data) == b"".join(found)
    want = {r.record_id: r.block for r in derived.collect()}
    assert {h["WARC-Record-ID"]: b.decode() for _, h, b, _ in W.parsed(data)} == want
