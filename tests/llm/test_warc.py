from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pytest

from glyphloom.llm import warc
from glyphloom.llm.htmltext import extract_text

HTML = "<html><body><article><p>Some text, with commas, and é, long enough for a paragraph.</p></article></body></html>"


def response(body=HTML.encode(), http="Content-Type: text/html; charset=utf-8", kind="response", uri="http://a.org/x", length=None):
    block = f"HTTP/1.1 200 OK\r\n{http}\r\n\r\n".encode() + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
    head += f"WARC-Target-URI: {uri}\r\n" if uri else ""
    return (head + f"Content-Length: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"


def fields(record):
    head, _, block = record.partition("\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.split("\r\n")[1:]), block


def test_two_linked_records():
    meta, text = warc.derive(response())
    m, c = fields(meta["record"]), fields(text["record"])
    assert text["block"] == extract_text(HTML) and "é" in text["block"]
    for own, block in (m, c):
        assert own["WARC-Refers-To"] == "<urn:uuid:1>" and own["WARC-Refers-To-Target-URI"] == own["WARC-Target-URI"] == "http://a.org/x"
        assert int(own["Content-Length"]) == len(block.encode())
        assert own["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block.encode()).digest()).decode()
    assert m[0]["WARC-Concurrent-To"] == c[0]["WARC-Record-ID"] and c[0]["WARC-Concurrent-To"] == m[0]["WARC-Record-ID"]
    facts = dict(x.split(": ", 1) for x in m[1].strip().split("\r\n"))
    assert facts["source-status"] == "HTTP/1.1 200 OK" and facts["source-http-content-type"] == "text/html; charset=utf-8"
    assert facts["conversion-id"] == c[0]["WARC-Record-ID"] and facts["conversion-digest"] == c[0]["WARC-Block-Digest"]
    assert facts["source-payload-digest"] == warc.sha1(HTML.encode())
    assert warc.derive(response()) == [meta, text]


def test_encodings():
    want = extract_text(HTML)
    body = HTML.encode()
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (body[:7], body[7:])) + b"0\r\n\r\n"
    for r in [
        response(gzip.compress(body), "Content-Encoding: gzip"), response(zlib.compress(body), "Content-Encoding: deflate"), response(chunked, "Transfer-Encoding: chunked"),
        response(HTML.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"), response(body, "content-type: text/html;\r\n charset=utf-8"), response(body, "Content-Type: text/html; charset=nonsense"),
    ]:
        assert warc.derive(r)[1]["block"] == want


def test_bodies_are_whole_or_say_why():
    want, body = extract_text(HTML), HTML.encode()
    raw = zlib.compressobj(wbits=-15)
    for r in [
        response(body, "Transfer-Encoding: chunked"), response(gzip.compress(gzip.compress(body)), "Content-Encoding: gzip, gzip"),
        response(raw.compress(body) + raw.flush(), "Content-Encoding: deflate"), response(zlib.compress(gzip.compress(body)), "Content-Encoding: gzip, deflate"),
        response(b"%x;x=y\r\n%s\r\n0\r\n\r\n" % (len(body), body), "Transfer-Encoding: chunked"), response(body, "Content-Encoding: identity"),
    ]:
        assert warc.derive(r)[1]["block"] == want
    cut = b"7\r\n%s\r\n40\r\n%s" % (body[:7], body[7:20])
    for r in [response(cut, "Transfer-Encoding: chunked"), response(b"7\r\n%s\r\n" % body[:7], "Transfer-Encoding: chunked"), response(body, "Content-Encoding: br"), response(body, "Content-Encoding: gzip, zstd")]:
        (row,) = warc.derive(r)
        assert row["record_type"] == "none" and row["problem"].startswith("body")


@pytest.mark.parametrize(
    "record", [None, b"", b"junk", response(kind="request"), response(length=10**6), response(length="x"), response(b"zz", "Content-Encoding: gzip"), b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"]
)
def test_what_is_no_response_says_why(record):
    (row,) = warc.derive(record)
    assert row["record_type"] == "none" and row["problem"]


def test_pages_and_files(spark, tmp_path):
    rows = [(1, "http://a.org/1", HTML, "x"), (2, None, None, None), (None, "http://a.org/é", "<p>é " * 20_000, "y"), (1, "http://a.org/1", HTML, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    made = warc.derivatives(warc.response_records(pages), keep=["page_id", "block", "url"])
    got = made.collect()
    assert len(got) == 8 and all(r["problem"] is None for r in got)
    assert made.columns[:2] == ["page_id", "url"] and "block" in made.columns
    texts = {r["url"]: r["block"] for r in got if r["record_type"] == "conversion"}
    assert texts == {u: extract_text(h) for _, u, h, _ in rows}
    assert len({r["record_id"] for r in got}) == 6
    warc.write_warc(made, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    found = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        own = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(own["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        found.append((own["WARC-Record-ID"], rest[:n].decode()))
        data = rest[n + 4 :]
    assert sorted(found) == sorted((r["record_id"], r["block"]) for r in got)
    assert warc.derivatives(warc.response_records(pages.limit(0))).collect() == []
