"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response is a record id, target URI, date and an HTTP message.  Each gives a `metadata` record (title, language,
outlinks, the source's HTTP headers) and a `conversion` record (the page as plain text).  Both carry the source's id in
WARC-Refers-To, its URI and date, and their block digests; the source's block and payload digests are kept beside
them.  Ids are name-based, so a task that is run again writes the same records.

Cases: a null block is an empty message; a message without a header's end is all body; a null URI leaves its fields
out; unknown encodings and broken bytes are replaced, never fatal; chunked, gzip and deflate bodies are undone where
they can be; repeated rows give equal records; an empty table gives no rows; further columns are ignored.
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

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import as_arrow

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs, of RFC 4122
DATE = "1970-01-01T00:00:00Z"
VERSION = "WARC/1.1"
ROWS = 256

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template|svg|head)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" *\n[ \n]*")
#: Elements that begin a new line.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(names))}>"


def plain_text(page: str) -> str:
    """Visible text; block elements break lines, white space is collapsed, no line is empty."""
    page = _HIDDEN.sub("\n", page)
    page = _TAG.sub(lambda m: "\n" if (m[1] or "").lstrip("/").lower() in BLOCKS else "", page)
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(page))).strip(" \n")


def http_parts(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields (the status line first, under an empty name) and the body with its encodings undone."""
    if not block.startswith(b"HTTP/"):
        return [], block
    head, end, body = block.partition(b"\r\n\r\n")
    if not end:
        head, end, body = block.partition(b"\n\n")
    if not end:
        return [], block
    fields: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if line[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        else:
            fields.append((name.strip(), value.strip()) if colon and fields else ("", line.strip()))
    known = {k.lower(): v for k, v in fields}
    if "chunked" in known.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    try:
        coding = known.get("content-encoding", "").lower()
        if coding == "gzip":
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return fields, body


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out) or body


def decoded(fields: list[tuple[str, str]], body: bytes) -> str:
    known = {k.lower(): v for k, v in fields}
    found = _CHARSET.search(known.get("content-type", "")) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def serialised(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record in the file format."""
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an uncompressed file."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start)
        fields = dict(line.split(": ", 1) for line in data[start:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def derived(source_id: str, uri: str | None, date: str, block: bytes) -> list[tuple[str, str, list[tuple[str, str]], bytes]]:
    """(record id, type, header fields, block) of the metadata and the conversion record of one response."""
    fields, body = http_parts(block)
    page = decoded(fields, body)
    source = [("source-http-" + (k.lower() or "status"), v) for k, v in fields]
    source += [("source-block-digest", digest(block)), ("source-payload-digest", digest(body))]
    title, lang = _TITLE.search(page), _LANG.search(page)
    facts = [("title", " ".join(html.unescape(title[1]).split()))] if title else []
    facts += [("lang", lang[1])] if lang else []
    facts += [("outlink", " ".join(html.unescape(m[1] or m[2] or m[3] or "").split())) for m in _LINK.finditer(page)]
    blocks = (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts + source).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")),
    )
    out = []
    for kind, content, b in blocks:
        own = record_id(kind, source_id)
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Refers-To", source_id)]
        head += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)] if uri else []
        head += [("WARC-Refers-To-Date", date), ("Content-Type", content), ("WARC-Block-Digest", digest(b)), ("Content-Length", str(len(b)))]
        out.append((own, kind, head, b))
    return out


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (page_id, source_id, uri, date, block) of a table of raw pages; a map in SQL."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    h = F.sha1(F.concat_ws("\0", F.lit("response"), F.col("page_id").cast("string"), F.col("url"), F.sha1(body)).cast("binary"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    source_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))
    return pages.select("page_id", source_id.alias("source_id"), F.col("url").alias("uri"), F.lit(date).alias("date"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows for each response (source_id, uri, date, block): its records with their fields and links."""
    kept = responses.select(*keep, "source_id", "uri", "date", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                got = [derived(s, u, d or DATE, b or b"") for s, u, d, b in zip(*(c.to_pylist() for c in batch.columns[len(keep) :]), strict=True)]
                flat = [(i, *r) for i, rs in enumerate(got) for r in rs]
                rows = pa.array([f[0] for f in flat], pa.int64())
                fields = [dict(f[3]) for f in flat]
                columns = {k: batch.column(i).take(rows) for i, k in enumerate(keep)}
                columns |= {"record_id": pa.array([f[1] for f in flat], pa.string()), "warc_type": pa.array([f[2] for f in flat], pa.string())}
                for name, key in (("refers_to", "WARC-Refers-To"), ("target_uri", "WARC-Target-URI"), ("date", "WARC-Date"), ("block_digest", "WARC-Block-Digest")):
                    columns[name] = pa.array([f.get(key) for f in fields], pa.string())
                columns["content_length"] = pa.array([len(f[4]) for f in flat], pa.int64())
                columns["record"] = pa.array([serialised(f[3], f[4]) for f in flat], pa.binary())
                if flat:
                    yield as_arrow(**columns)

    types = dict(kept.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keep) + ", record_id string, warc_type string, refers_to string, target_uri string, date string, block_digest string, content_length long, record binary"
    return kept.mapInArrow(run, schema)
