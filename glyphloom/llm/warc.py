"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record (WARC header, HTTP header, body) gives two records. The conversion holds the main
text of its page; the metadata record holds its status, its HTTP headers, its digests and the
conversion's id and size. Both refer to the response (WARC-Refers-To, with its target URI and date)
and to each other (WARC-Concurrent-To), and carry block digests of their own. Ids are made from the
response's id, so a second run gives the same records.

Defined results: a record that is null, no response, or cut off gives one row of type ``none`` with
the reason in ``problem``; an empty body gives an empty conversion; a missing target URI or date is
left out; bodies are read whole; repeated rows give repeated records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .htmltext import extract_text

END = "\r\n"
RECORDS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_length long, block_digest string, payload_digest string, problem string, block string, record string"


def response_records(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages`` with ``response``, a WARC response record (binary) around the page's html."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(END + END)).cast("binary")
    block = F.concat(http, body)
    digest = F.md5(F.concat_ws("\n", F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))))
    name = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(END))
    header = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: response{END}"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), name, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col(url)), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(body, 256))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return pages.withColumn("response", F.concat(header.cast("binary"), block, F.lit(END + END).cast("binary")))


def headers(lines: str) -> list[tuple[str, str]]:
    """Header fields in order; folded lines belong to the field before."""
    found: list[tuple[str, str]] = []
    for x in re.split(r"\r?\n", lines):
        if x[:1] in (" ", "\t") and found:
            found[-1] = found[-1][0], f"{found[-1][1]} {x.strip()}"
        elif ":" in x:
            key, _, value = x.partition(":")
            found.append((key.strip(), value.strip()))
    return found


def value_of(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]+)[ \t]*(?:;[^\r\n]*)?")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _unchunked(data: bytes) -> bytes:
    """The joined chunks; ``data`` itself where it does not begin with a chunk (stored without them)."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        m = CHUNK.fullmatch(data, at, end) if end >= 0 else None
        if not m:
            if not at:
                return data
            raise ValueError("body: broken chunks")
        n = int(m[1], 16)
        if not n:
            return b"".join(parts)
        at = end + 2 + n
        if data[at : at + 2] != b"\r\n":
            raise ValueError("body: broken chunks")
        parts.append(data[end + 2 : at])
        at += 2


def _body(fields: list[tuple[str, str]], data: bytes) -> bytes:
    """The body without transfer and content encoding. Raises ValueError for a coding it does not know."""
    if "chunked" in (value_of(fields, "Transfer-Encoding") or "").lower():
        data = _unchunked(data)
    codings = [x.strip() for x in (value_of(fields, "Content-Encoding") or "").lower().split(",")]
    for coding in reversed(codings):  # the last one was applied last
        if coding in ("gzip", "x-gzip"):
            data = gzip.decompress(data)
        elif coding == "deflate":
            try:
                data = zlib.decompress(data)
            except zlib.error:
                data = zlib.decompress(data, -zlib.MAX_WBITS)  # without the zlib header, as some servers send it
        elif coding not in ("", "identity"):
            raise ValueError(f"body: coding {coding}")
    return data


def parse_response(record: bytes | None) -> tuple[list[tuple[str, str]], str, list[tuple[str, str]], bytes]:
    """WARC fields, status line, HTTP fields and decoded body. Raises ValueError for anything else."""
    if not record:
        raise ValueError("no record")
    head, mark, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.decode("utf-8", "replace").partition("\r\n")
    fields = headers(lines)
    if not mark or not version.startswith("WARC/"):
        raise ValueError("no WARC header")
    if value_of(fields, "WARC-Type") != "response" or not value_of(fields, "WARC-Record-ID"):
        raise ValueError("no response")
    length = value_of(fields, "Content-Length") or ""
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError("cut off")
    http, mark, body = rest[: int(length)].partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no HTTP header")
    status, _, lines = http.decode("latin-1").partition("\r\n")
    own = headers(lines)
    try:
        return fields, status, own, _body(own, body)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"body: {e}") from None


def decode(fields: list[tuple[str, str]], body: bytes) -> str:
    """By the declared charset, else that of a meta tag, else UTF-8."""
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", value_of(fields, "Content-Type") or "", re.I)
    m = m or re.search(r"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)", body[:2048].decode("latin-1"), re.I)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _record(kind: str, own: str, content: str, block: bytes, source: list[tuple[str, str]], concurrent: str) -> dict:
    uri, date, refers = (value_of(source, x) for x in ("WARC-Target-URI", "WARC-Date", "WARC-Record-ID"))
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", refers), ("WARC-Concurrent-To", concurrent)]
    fields += [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    fields += [("WARC-Block-Digest", sha1(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    head = "WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in fields if v is not None)
    text = block.decode()
    return {"record_type": kind, "record_id": own, "refers_to": refers, "target_uri": uri, "date": date, "content_length": len(block), "block_digest": sha1(block), "payload_digest": value_of(source, "WARC-Payload-Digest"), "problem": None, "block": text, "record": head + END + text}


def derive(record: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    try:
        source, status, http, body = parse_response(record)
    except ValueError as e:
        return [{"record_type": "none", "problem": str(e)}]
    refers = value_of(source, "WARC-Record-ID")
    ids = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers}#{kind}')}>" for kind in ("metadata", "conversion")]
    text = extract_text(decode(http, body)).encode("utf-8", "replace")
    digest = value_of(source, "WARC-Payload-Digest") or sha1(body)
    facts = [("source-status", status), *((f"source-http-{k.lower()}", v) for k, v in http), ("source-payload-digest", digest)]
    facts += [("source-payload-length", str(len(body))), ("conversion-id", ids[1]), ("conversion-digest", sha1(text)), ("conversion-length", str(len(text)))]
    block = "".join(f"{k}: {v}{END}" for k, v in facts).encode("utf-8", "replace")
    return [
        _record("metadata", ids[0], "application/warc-fields", block, source, ids[1]),
        _record("conversion", ids[1], "text/plain; charset=utf-8", text, source, ids[0]),
    ]


def derivatives(responses: DataFrame, record: str = "response", keep: list[str] | None = None) -> DataFrame:
    """Two rows for each response, with the columns named in ``keep`` carried along. See RECORDS."""
    new = T.StructType.fromDDL(RECORDS)
    kept = [c for c in keep or [] if c.lower() not in {x.lower() for x in new.names}]
    source = responses.select(F.col(record).alias("in"), *(F.col(c).alias(f"out_{i}") for i, c in enumerate(kept)))
    schema = T.StructType([*source.schema.fields[1:], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # a response's text leaves twice: small batches
                batch = whole.slice(at, 256)
                made = [(i, r) for i, x in enumerate(batch.column(0)) for r in derive(x.as_py())]
                rows = pa.array([i for i, _ in made], pa.int64())
                arrays = [c.take(rows) for c in batch.columns[1:]]
                kinds = {"content_length": pa.int64()}
                arrays += [pa.array([r.get(n) for _, r in made], kinds.get(n, pa.string())) for n in new.names]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    made = source.mapInArrow(run, schema)
    return made.select(*(F.col(f"out_{i}").alias(c) for i, c in enumerate(kept)), *new.names)


def write_warc(records: DataFrame, path: str, record: Column | str = "record", compression: str = "none") -> None:
    """Write records as WARC files; rows without a record are left out."""
    column = F.col(record) if isinstance(record, str) else record
    lines = records.select(column.alias("value")).where("value IS NOT NULL")
    lines.write.option("lineSep", END + END).option("compression", compression).text(path)
