"""WARC derivatives: metadata and plain-text conversion records for response records.

A response record is a row: record_id, target_uri, date, http_headers (array of name/value), payload, and, where the source states them,
payload_digest and block_digest. Each gives a metadata record (title, links, language, what was found in the source's headers) and,
if its media type is text, a conversion record (the page's text), both with WARC-Refers-To naming the response, the source's target URI,
date and digests, and their own ids and digests. Chunked and compressed payloads are undone and the text is decoded by the declared charset.
Ids are name-based UUIDs of the source's id and the kind, so a repeated run writes the same records.

Files are read as a stream of records (read): no file is held whole, large uncompressed files are split, and what is no whole record comes back
as a row with an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clausegrid.llm.common import map_columns, unused

VERSION = "WARC/1.1"
#: The date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
HEADER = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))

# no tag's pattern crosses the next one, so unclosed tags are looked at once
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|td|th|table|h[1-6]|article|section|header|footer|nav|main|aside|blockquote|pre|form|title|head|body|html)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>?")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_META = re.compile(rb"<meta\b[^<>]*?charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
#: Bytes at the start of a page that a declaration of its charset must be in (a fixed value of the web's standards).
_META_BYTES = 1024
#: Media types besides text/* that have a text.
_TEXT_TYPES = ("application/xhtml+xml", "application/xml", "application/json")
_SPACE = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" *\n[ \n]*")


def page_text(source: str) -> str:
    """The text of a page: no scripts, styles, comments or title, a line for each block, references resolved."""
    body = _BREAK.sub("\n", _TITLE.sub("\n", _DROPPED.sub(" ", source)))
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape(_TAG.sub("", body)))).strip()


def page_facts(source: str, base: str) -> tuple[str, str, list[str]]:
    """(title, declared language, absolute link targets in order of first appearance)."""
    plain = _DROPPED.sub(" ", source)
    title, lang = _TITLE.search(plain), _LANG.search(plain)
    links = []
    for m in _LINK.finditer(plain):
        try:
            links.append(urljoin(base, html.unescape(m[1] or m[2] or m[3] or "").strip()))
        except ValueError:
            continue
    return _SPACE.sub(" ", html.unescape(_TAG.sub("", title[1]))).strip() if title else "", lang[1] if lang else "", list(dict.fromkeys(links))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n\x00]+", " ", value).strip()


def http_block(status: str, headers: list[dict], payload: bytes) -> bytes:
    lines = [status, *(f"{clean(h['name'] or '')}: {clean(h['value'] or '')}" for h in headers if h)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record, its length counted from the block."""
    lines = [VERSION, *(f"{k}: {clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def head_of(record: bytes) -> tuple[dict[str, str], int]:
    """(headers of a record, where its block begins); the first line is the version's. Fails on what is no record."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("the headers do not end")
    headers = {}
    for line in record[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header without a name")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    return headers, end + 4


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers by name in lower case, block) of each record of an uncompressed or per-record gzipped file that is at hand whole."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    found, at = [], 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers, start = head_of(data[at:])
        end = at + start + int(headers["content-length"])
        found.append((headers, data[at + start : end]))
        at = end + 4
    return found


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16) if end >= 0 else 0
        if size <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def content(payload: bytes, headers: dict[str, str]) -> bytes:
    """The payload without its transfer and content encodings; as it is where they cannot be undone."""
    try:
        if "chunked" in headers.get("transfer-encoding", "").lower():
            payload = _dechunked(payload)
    except ValueError:  # stored without its chunks, as many crawlers do
        pass
    for coding in reversed(headers.get("content-encoding", "").lower().replace(" ", "").split(",")):
        try:
            if coding in ("gzip", "x-gzip", "deflate"):
                payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            if coding == "deflate":
                try:
                    payload = zlib.decompressobj(-15).decompress(payload)
                except zlib.error:
                    pass
    return payload


def decoded(data: bytes, content_type: str) -> str:
    """The text by the declared charset: the header's, the page's, or UTF-8; bytes that do not fit are replaced."""
    found = _CHARSET.search(content_type) or _META.search(data[:_META_BYTES])
    name = found[1] if found else "utf-8"
    try:
        return data.decode(name if isinstance(name, str) else name.decode("ascii"), "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", date: str = NO_DATE) -> DataFrame:
    """Response rows for a table of pages: page_id, record_id, target_uri, date, http_headers, payload.

    The id is made from page_id, url and the payload's digest. A null url or page counts as empty. Rows that repeat all three
    give equal records. Other columns are not returned. An empty table gives an empty table.
    """
    uri, body = F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(source), F.lit("")).cast("binary")

    def make():
        def f(ids, urls, payloads):
            return [[record_id("response", str(i), u, digest(x)) for i, u, x in zip(ids.to_pylist(), urls.to_pylist(), payloads.to_pylist())]]

        return f

    headers = F.array(
        F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")),
        F.struct(F.lit("Content-Length").alias("name"), F.length(body).cast("string").alias("value")),
    ).cast(HEADER)
    rows = pages.select(F.col(page_id).alias("page_id"), uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), body.alias("payload"))
    return map_columns(rows, ["page_id", "target_uri", "payload"], rows.columns, [T.StructField("record_id", T.StringType())], make)


RECORD = T.StructType([
    T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()), T.StructField("source_payload_digest", T.StringType()), T.StructField("source_block_digest", T.StringType()),
    T.StructField("source_headers", HEADER), T.StructField("content_type", T.StringType()), T.StructField("block_digest", T.StringType()),
    T.StructField("content_length", T.LongType()), T.StructField("block", T.BinaryType())])


def derive(row: dict) -> list[dict]:
    """The metadata record of one response and, if it has a text, the conversion record."""
    source_id, uri, date = row["record_id"] or record_id("response", "", row["target_uri"] or ""), row["target_uri"] or "", row["date"] or NO_DATE
    payload, headers = row["payload"] or b"", [h for h in row["http_headers"] or [] if h]
    by_name = {(h["name"] or "").strip().lower(): h["value"] or "" for h in headers}
    content_type = by_name.get("content-type", "")
    media = content_type.split(";")[0].strip().lower()
    has_text = not media or media.startswith("text/") or media in _TEXT_TYPES or media.endswith("+xml")
    text = decoded(content(payload, by_name), content_type) if has_text else ""
    title, lang, links = page_facts(text, uri)
    source_digest, source_block = row.get("payload_digest") or digest(payload), row.get("block_digest")
    fields = [("title", title), ("languages", lang), ("source-payload-digest", source_digest), ("source-payload-length", str(len(payload)))]
    fields += [("source-block-digest", source_block)] * bool(source_block)
    fields += [(f"source-header-{(h['name'] or '').lower()}", h["value"] or "") for h in headers] + [("outlink", x) for x in links]
    blocks = [("metadata", "application/warc-fields", "".join(f"{clean(k)}: {clean(v)}\r\n" for k, v in fields).encode())]
    blocks += [("conversion", "text/plain; charset=utf-8", page_text(text).encode())] * has_text
    return [{"warc_type": kind, "record_id": record_id(kind, source_id), "refers_to": source_id, "target_uri": uri, "date": date, "source_payload_digest": source_digest,
             "source_block_digest": source_block, "source_headers": headers, "content_type": own, "block_digest": digest(block), "content_length": len(block), "block": block} for kind, own, block in blocks]


def build_derivatives(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The metadata record and, for text media types, the conversion record of each response row.

    keep: columns of rows that stay beside the record's (by default those that are neither the response's nor named like a record's).
    Null headers, payloads and dates count as empty, empty and NO_DATE; a response without an id gets one from its URI. Digests that the source
    states are kept (payload_digest, block_digest), others are computed. Rows without a payload's type count as text. Unclosed tags, comments and
    titles end with the page; very long pages take time in proportion. Repeated responses give repeated records. Rows with an error (of read)
    give none. An empty table gives an empty table.
    """
    stated = {c.lower(): c for c in rows.columns}
    if "error" in stated:
        rows = rows.where(F.col(stated["error"]).isNull())
    inputs = ["record_id", "target_uri", "date", "http_headers", "payload", *(c for c in ("payload_digest", "block_digest") if c in stated)]
    taken = {f.name.lower() for f in RECORD} | set(inputs) | {"error"}
    keep = [c for c in rows.columns if c.lower() not in taken] if keep is None else keep

    def make():
        def f(*columns):
            return [[derive(dict(zip(inputs, x))) for x in zip(*(c.to_pylist() for c in columns))]]

        return f

    (records,) = unused(rows, "records")
    made = map_columns(rows, inputs, keep, [T.StructField(records, T.ArrayType(RECORD))], make)
    return made.select(*keep, F.inline(records))


def record_headers(r: dict) -> list[tuple[str, str]]:
    return [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Refers-To-Target-URI", r["target_uri"]), ("WARC-Refers-To-Date", r["date"]),
            ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]),
            ("WARC-Block-Digest", r["block_digest"]), ("WARC-Source-Payload-Digest", r["source_payload_digest"]), ("Content-Type", r["content_type"])]


def to_bytes(records: DataFrame) -> DataFrame:
    """Adds `warc`, the gzipped member of each record row."""
    inputs = ["warc_type", "record_id", "refers_to", "target_uri", "date", "block_digest", "source_payload_digest", "content_type", "block"]

    def make():
        def f(*columns):
            return [[gzip.compress(serialise(record_headers(r), r["block"] or b""), 6, mtime=0) for r in (dict(zip(inputs, x)) for x in zip(*(c.to_pylist() for c in columns)))]]

        return f

    return map_columns(records, inputs, records.columns, [T.StructField("warc", T.BinaryType())], make)


SOURCE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("block_digest", T.StringType()), T.StructField("http_headers", HEADER),
    T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])
#: What stands between two records.
_BETWEEN = b"\r\n\r\nWARC/"


def response_of(file: str, record: bytes) -> dict | None:
    """The row of a record that begins with its version; None if it is no response."""
    out = dict.fromkeys(SOURCE.names) | {"file": file}
    try:
        headers, start = head_of(record)
        length = int(headers["content-length"])
        if len(record) - start < length:
            raise ValueError(f"{len(record) - start} of {length} bytes")
    except ValueError as e:
        return out | {"error": str(e)}
    if headers.get("warc-type") != "response":
        return None
    head, _, payload = record[start : start + length].partition(b"\r\n\r\n")
    lines = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    return out | {"record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
                  "payload_digest": headers.get("warc-payload-digest"), "block_digest": headers.get("warc-block-digest"),
                  "http_headers": [{"name": k.strip(), "value": v.strip()} for k, _, v in lines], "payload": payload}


def _missing(record: bytes) -> bool:
    """Whether a record says that it is longer."""
    try:
        headers, start = head_of(record)
    except ValueError:
        return False
    return len(record) - start < int(headers["content-length"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response rows of WARC files, gzipped by record or not: file, record_id, target_uri, date, payload_digest, block_digest, http_headers, payload, error.

    Records that are cut short or malformed are rows with an error and a null payload; records of other types are left out. A task holds a record
    at a time. A payload that holds what parts two records is put together again, unless a split of the file lies between. An empty folder's files
    give an empty table.
    """
    pieces = spark.read.option("lineSep", _BETWEEN.decode()).option("recursiveFileLookup", True).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = to_arrow_schema(SOURCE)

    def run(batches):
        file, held = None, None

        def row(record):
            # a file's first piece has the whole version, the others what follows "WARC/"
            record = record if record.startswith(b"WARC/") else b"WARC/" + record
            made = response_of(file, record) if record.strip() != b"WARC/" else None
            return [made] if made else []

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                name, value, out = name.as_py(), value.as_py(), []
                if held is not None and name == file and _missing(held):
                    held += _BETWEEN + value
                    continue
                if held is not None:
                    out = row(held)
                file, held = name, value
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None and (out := row(held)):
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return pieces.mapInArrow(run, SOURCE)
