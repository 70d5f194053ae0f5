"""WARC derivative builder: linked metadata and plain-text conversion records from response records.

Source records come from WARC files (`read_warc`, `from_records`) or from stored pages (`responses`), which have no headers
of their own but a type and a length. Each response gives one `metadata` record (JSON: the source's WARC and HTTP headers, digests, title, language, links) and
one `conversion` record (plain text). Both point back with WARC-Refers-To, carry the source's target URI and date, and
have a block digest of their own; the metadata record also names the conversion. Digests that the source states are kept
as they are, and others computed. Record ids are derived from the source's id and payload, so that a task that runs
twice writes the same records, and two pages under one id have records of their own.

Defined cases: a null body is an empty page with empty text and no links; a null URL gives an empty target URI, and links
stay as they are written. Very long pages are handled whole, in time in proportion to their length. Repeated pages give repeated records. Malformed markup is
read as far as it goes: a `<` that opens no tag is text. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import BATCH_BYTES, small_batches

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# No pattern looks beyond the next `<` for the end of a tag, so that unclosed ones cost no more than others.
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^<>]*+>.*?(?:</\1\s*>|\Z)", re.S | re.I)
HEAD, HEAD_END = re.compile(r"<head\b[^<>]*+>", re.I), re.compile(r"</head\s*>", re.I)
TITLE, TITLE_END = re.compile(r"<title\b[^<>]*+>", re.I), re.compile(r"</title\s*>", re.I)
TAG = re.compile(r"""<[/!?a-zA-Z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>""")
LINE_TAG = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title|body|html)\b", re.I)
LINK_TAG = re.compile(r"""<(a|area|link|img|script|iframe|source)\b((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++))""")
LANG = re.compile(r"""<html\b[^<>]*?\blang\s*+=\s*+["']?([A-Za-z-]++)""", re.I)

RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, headers array<struct<name:string,value:string>>, block binary"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(map(str, parts)))}>"


def element(markup: str, start: re.Pattern, end: re.Pattern) -> tuple[int, int, int, int] | None:
    """(start, end of the first tag, start, end of the first closing one behind it) of an element, if it is closed."""
    first = start.search(markup)
    last = end.search(markup, first.end()) if first else None
    return (*first.span(), *last.span()) if last else None


def visible(markup: str) -> str:
    """Markup without comments, scripts, styles and templates."""
    return HIDDEN.sub("", markup)


def plain_text(markup: str) -> str:
    """Text of visible markup, one line for each block element."""
    head = element(markup, HEAD, HEAD_END)
    if head:
        markup = markup[: head[0]] + markup[head[3] :]
    body = TAG.sub(lambda m: "\n" if LINE_TAG.match(m[0]) else "", " ".join(markup.split()))
    lines = (" ".join(html.unescape(x).split()) for x in body.split("\n"))
    return "\n".join(x for x in lines if x)


def links_of(markup: str, base: str) -> list[dict]:
    """Links of visible markup in the order of the page, resolved against its URL."""
    out = []
    for name, inside in LINK_TAG.findall(markup):
        found = next((x for x in ATTRIBUTE.findall(inside) if x[0].lower() in ("href", "src")), None)
        target = html.unescape(next((v for v in found[1:] if v), "")).strip() if found else ""
        if not target:
            continue
        try:
            target = urljoin(base, target) if base else target
        except ValueError:
            pass
        out.append({"path": f"{name.upper()}@/{found[0].lower()}", "url": target})
    return out


SOURCE = "record_id string, target_uri string, date string, status int, http_headers array<struct<name:string,value:string>>, payload_digest string, block_digest string, body binary"


def responses(pages: DataFrame, url: str = "url", body: str = "html", key: str = "page_id", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of stored pages, which were delivered with status 200: page_id (of the key's type) and SOURCE."""
    names = ["page_id", *[x.split()[0] for x in SOURCE.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for k, uri, b in zip(pdf["page_id"], pdf["target_uri"], pdf["body"], strict=True):
                http = [{"name": "Content-Type", "value": "text/html; charset=utf-8"}, {"name": "Content-Length", "value": str(len(b or b""))}]
                out.append((k, record_id("response", k, uri, sha1(b or b"")), uri, date, 200, http, None, None, b))
            yield pd.DataFrame(out, columns=names).astype({"page_id": pdf["page_id"].dtype})

    rows = small_batches(pages).select(F.col(key).alias("page_id"), F.col(url).alias("target_uri"), F.col(body).cast("binary").alias("body"))
    return rows.mapInPandas(run, f"page_id {pages.schema[key].dataType.simpleString()}, {SOURCE}")


def from_records(records: DataFrame) -> DataFrame:
    """The responses among the records of `read_warc`: page_id is the record's own id, then SOURCE.

    A block that does not begin with an HTTP status line has no status and no headers, and is all body.
    """
    names = ["page_id", *[x.split()[0] for x in SOURCE.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for key, headers, block in zip(pdf["record_id"], pdf["headers"], pdf["block"], strict=True):
                by = {h["name"].lower(): h["value"] for h in headers}
                status, http, body = http_parts(block)
                out.append((key, key, by.get("warc-target-uri"), by.get("warc-date"), status, http, by.get("warc-payload-digest"), by.get("warc-block-digest"), body))
            yield pd.DataFrame(out, columns=names).astype({"status": "Int32"})

    return small_batches(records).where("record_type = 'response'").select("record_id", "headers", "block").mapInPandas(run, f"page_id string, {SOURCE}")


def http_parts(block: bytes) -> tuple[int | None, list[dict], bytes]:
    """(status, headers, body) of an HTTP response message."""
    found = re.match(rb"HTTP/[0-9.]+ +([0-9]{3})", block)
    if not found:
        return None, [], block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = [x.decode("utf-8", "replace") for x in head.split(b"\r\n")[1:]]
    return int(found[1]), [{"name": n.strip(), "value": v.strip()} for n, _, v in (x.partition(":") for x in lines)], body


def derive_one(page, source: str, uri: str | None, date: str | None, status: int | None, http, payload: str | None, source_block: str | None, body: bytes | None) -> list[tuple]:
    uri, body, date = uri or "", body or b"", date or ""
    markup = body.decode("utf-8", "replace")
    http = [(h["name"], h["value"]) for h in (http if http is not None else [])]
    payload = payload or sha1(body)
    if not source_block:
        line = f"HTTP/1.1 {status} OK\r\n".encode() if status is not None else b""
        source_block = sha1(line + b"".join(f"{n}: {v}\r\n".encode() for n, v in http) + b"\r\n" * bool(line) + body)
    seen = visible(markup)
    text = plain_text(seen).encode()
    ids = {kind: record_id(kind, source, payload) for kind in ("metadata", "conversion")}
    title = element(seen, TITLE, TITLE_END)
    lang = LANG.search(markup)
    envelope = {
        "warc": {"WARC-Type": "response", "WARC-Record-ID": source, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": payload, "WARC-Block-Digest": source_block},
        "http": {"status": status, "headers": [{"name": n, "value": v} for n, v in http], "entity_length": len(body)},
        "html": {"title": " ".join(html.unescape(seen[title[1] : title[2]]).split()) if title else None, "lang": lang[1] if lang else None, "links": links_of(seen, uri)},
        "conversion": {"WARC-Record-ID": ids["conversion"], "WARC-Block-Digest": sha1(text), "length": len(text)},
    }
    blocks = {"metadata": ("application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()), "conversion": ("text/plain; charset=utf-8", text)}
    out = []
    for kind, (content, block) in blocks.items():
        digest = sha1(block)
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", content),
            ("WARC-Block-Digest", digest), ("WARC-Source-Payload-Digest", payload), ("Content-Length", str(len(block))),
        ]
        out.append((page, kind, ids[kind], source, uri, date, content, len(block), digest, payload, [{"name": n, "value": v} for n, v in headers], block))
    return out


def derive(source: DataFrame) -> DataFrame:
    """The two derived records of each response, without a shuffle."""
    names = ["page_id", *[x.split()[0] for x in RECORD.split(", ")]]
    wanted = ["page_id", *[x.split()[0] for x in SOURCE.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            pdf = pdf.astype({"status": object}).where(pdf.notna(), None)
            rows = [r for row in zip(*(pdf[c] for c in wanted), strict=True) for r in derive_one(row[0], *row[1:4], int(row[4]) if row[4] is not None else None, *row[5:])]
            yield pd.DataFrame(rows, columns=names).astype({"page_id": pdf["page_id"].dtype})

    return source.select(*wanted).mapInPandas(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, {RECORD}")


def encode(headers, block: bytes) -> bytes:
    """One WARC 1.1 record. Line ends in values would forge headers and become blanks."""
    head = "WARC/1.1\r\n" + "".join(f"{h['name']}: {re.sub(r'[\r\n]+', ' ', h['value'])}\r\n" for h in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def decode(stream) -> Iterator[tuple[list[dict], bytes]]:
    """(headers, block) of the records of one open file, read record by record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = []
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.append({"name": name.strip(), "value": value.strip()})
        size = int(next(h["value"] for h in headers if h["name"].lower() == "content-length"))
        yield headers, stream.read(size)


def write_warc(records: DataFrame, folder: str) -> None:
    """One .warc.gz file for each partition in a folder (a path or a URI of a store) that all executors reach; a file
    appears whole or not at all."""

    def save(index: int, rows) -> Iterator[int]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        name = f"{path}/part-{index:05d}.warc.gz"
        temporary = f"{path}/.{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(temporary, compression=None) as out:
            for r in rows:
                out.write(gzip.compress(encode(r["headers"], bytes(r["block"])), mtime=0))
                n += 1
        store.move(temporary, name)
        yield n

    records.select("headers", "block").rdd.mapPartitionsWithIndex(save).count()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, headers, block) of all files of a path, one task for each file.

    Files are decompressed as they are read; a batch holds BATCH_BYTES of blocks or one record.
    """
    columns = ["record_type", "record_id", "refers_to", "headers", "block"]

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for content in pdf["content"]:
                raw = io.BytesIO(content)
                out, size = [], 0
                for headers, block in decode(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw):
                    by = {h["name"].lower(): h["value"] for h in headers}
                    out.append((by.get("warc-type"), by.get("warc-record-id"), by.get("warc-refers-to"), headers, block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
                yield pd.DataFrame(out, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return small_batches(files).mapInPandas(run, "record_type string, record_id string, refers_to string, headers array<struct<name:string,value:string>>, block binary")
