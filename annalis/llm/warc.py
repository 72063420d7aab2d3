"""Derivatives of WARC responses: metadata and plain-text conversion records.

A record is (warc_type, record_id, refers_to, target_uri, date, content_type, headers,
block): headers are the further named fields, block the UTF-8 text of the content. A
response's block is its HTTP head, an empty line and the payload. Each response gives a
metadata record and a conversion record that refer to it; both keep its target, date, HTTP
head and payload digest. Each record is made from one response alone, so that nothing is
shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, block string"
DATE = "2024-01-01T00:00:00Z"

_DROPPED = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", re.I | re.S)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[^\S\n]+")


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(*parts: str) -> str:
    """The same parts give the same identifier in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def plain_text(page: str) -> str:
    """The text of an HTML page, one line per block element."""
    bare = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub("", page)))
    lines = (_SPACE.sub(" ", x).strip() for x in html.unescape(bare).split("\n"))
    return "\n".join(x for x in lines if x)


def _columns(rows: list[dict]) -> pa.RecordBatch:
    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    schema = pa.schema([("page_id", pa.int64())] + [(c, text) for c in ("warc_type", "record_id", "refers_to", "target_uri", "date", "content_type")] + [("headers", pairs), ("block", text)])
    rows = [r | {"headers": list(r["headers"].items())} for r in rows]
    return pa.RecordBatch.from_pylist(rows, schema)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html). Null url and html count as empty."""

    def run(batches):
        for batch in batches:
            out = []
            for page_id, url, page in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                url, page = url or "", page or ""
                payload = page.encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n{page}"
                out.append({"page_id": page_id, "warc_type": "response", "record_id": record_uuid("response", str(page_id), url, date, sha1_base32(payload)), "refers_to": None, "target_uri": url, "date": date,
                            "content_type": "application/http; msgtype=response", "headers": {"WARC-Payload-Digest": sha1_base32(payload), "WARC-Block-Digest": sha1_base32(block.encode())}, "block": block})
            yield _columns(out)

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id long, {RECORD}")


def _derive(r: dict) -> list[dict]:
    head, _, payload = (r["block"] or "").partition("\r\n\r\n")
    given = dict(r["headers"] or [])
    digest = given.get("WARC-Payload-Digest") or sha1_base32(payload.encode())
    fields = [x.partition(":") for x in head.split("\r\n")[1:]]
    text = plain_text(payload)
    title = _TITLE.search(payload)
    facts = {"http_status": head.split("\r\n")[0], "http_headers": [[k.strip(), v.strip()] for k, _, v in fields], "payload_digest": digest, "payload_verified": digest == sha1_base32(payload.encode()),
             "payload_bytes": len(payload.encode()), "title": " ".join(html.unescape(title[1]).split()) if title else None, "links": [html.unescape(a or b or c) for a, b, c in _LINK.findall(payload)], "text_digest": sha1_base32(text.encode())}
    out = []
    for kind, content_type, block in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain; charset=utf-8", text)):
        own = {"WARC-Source-Payload-Digest": digest, "WARC-Block-Digest": sha1_base32(block.encode()), "WARC-Source-HTTP-Head": json.dumps(head, ensure_ascii=False)}
        if kind == "conversion":
            own["WARC-Payload-Digest"] = own["WARC-Block-Digest"]
        out.append({"page_id": r["page_id"], "warc_type": kind, "record_id": record_uuid(kind, r["record_id"] or ""), "refers_to": r["record_id"], "target_uri": r["target_uri"], "date": r["date"], "content_type": content_type, "headers": own, "block": block})
    metadata, conversion = out
    metadata["headers"]["WARC-Concurrent-To"], conversion["headers"]["WARC-Concurrent-To"] = conversion["record_id"], metadata["record_id"]
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the responses among ``records`` (page_id, ... as RECORD).

    Records of other types give none. Null blocks count as empty, null headers as none; a
    response with a null identifier is kept, and its records refer to null. Repeated
    responses give repeated records. Further columns are ignored.
    """

    def run(batches):
        for batch in batches:
            yield _columns([x for r in batch.to_pylist() for x in _derive(r)])

    cols = ["page_id", *(x.split()[0] for x in RECORD.split(", "))]
    return records.filter("warc_type = 'response'").select(*cols).mapInArrow(run, f"page_id long, {RECORD}")


def serialised(records: DataFrame) -> DataFrame:
    """Adds record: version line, named fields, empty line and block, without the two line ends that close it."""
    def field(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    more = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")
    head = F.concat(F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("warc_type")), field("WARC-Record-ID", F.col("record_id")), field("WARC-Refers-To", F.col("refers_to")), field("WARC-Target-URI", F.col("target_uri")),
                    field("WARC-Date", F.col("date")), field("Content-Type", F.col("content_type")), more, field("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    return records.withColumn("record", F.concat(head, F.col("block")))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one per task, written by Spark, so that ``path`` may be in any store."""
    serialised(records).select("record").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(named fields, block) of the records of one uncompressed WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        out.append((fields, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out
