"""WARC derivatives: response records are turned into linked metadata and plain-text conversion records.

Each response record gives one metadata and one conversion record.  Both have an id of their own (a version-5 UUID of
the source's id and their kind, so that a repeated run makes the same), name the source in WARC-Refers-To, and keep
its WARC-Target-URI, WARC-Date, WARC-Payload-Digest and Page-ID.  The metadata record's block holds the source's headers,
HTTP status and digests, and the counts of text and links; the conversion record's block is the page's text: markup,
scripts, styles and comments taken out, entities resolved, block elements on lines of their own, blanks collapsed.
Every record has a WARC-Block-Digest (SHA-1, base 32) that the reader tests.

`write` stores the derivatives as WARC files, a gzip member a record, and returns a manifest; `read` is the table of
any such files' records, read member by member.  Files of tasks that failed or ran twice are in no manifest.

Null HTML counts as an empty body, a null URL is an empty target, a null page_id gives no Page-ID.  A response's id is
that of its page_id, URL and payload together, so different pages have different ids and only equal rows make equal
records.  A source whose digest is wrong gives no records but an error row (`record_type` error, with the fault in
`text`), so a damaged record stops nothing else; nor does a damaged member when files are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import arrow_map, blocks, scratch, table, written

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6f0c3f6e-5b0e-4d0e-9f0b-6d1a3c0f7b52")
#: Elements whose content is no text, and those that stand on lines of their own.
HIDDEN = {"script", "style", "noscript", "template"}
BREAKS = {
    "p", "div", "br", "hr", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "title",
    "head", "body", "blockquote", "pre", "td", "th", "dd", "dt", "dl", "form", "option", "aside", "main",
}
#: A comment's begin, or a whole tag; its last group is empty where the tag has no end.
MARKUP = re.compile(r"<(?:(!--)|(?:[!?]|(/?)([a-zA-Z][a-zA-Z0-9]*)|/)[^>]*(>?))")
CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
HREF = re.compile(r"\bhref\s*=", re.I)
#: Bytes that a reader takes from a file, and records that it passes on, at a time.
READ_BYTES, READ_ROWS = 1 << 20, 256


class Record(NamedTuple):
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {source}')}>"


def record_bytes(record: Record) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in record.headers)
    return VERSION + b"\r\n" + head + b"\r\n" + record.block + b"\r\n\r\n"


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at this place, its digest tested, and where the next one begins."""
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].split(b"\r\n") if end >= 0 else []
    if not lines or not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no record at {at}")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in b" \t" and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.decode("utf-8", "replace").strip())
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        headers.append((name.strip(), value.strip()))
    size = Record(headers, b"").get("Content-Length")
    if size is None or not size.isdigit():
        raise ValueError("no content length")
    begin = end + 4
    block = data[begin : begin + int(size)]
    if len(block) < int(size) or data[begin + int(size) : begin + int(size) + 4] != b"\r\n\r\n":
        raise ValueError("the block is cut off")
    record = Record(headers, block)
    said = record.get("WARC-Block-Digest")
    if said is not None and said != digest(block):
        raise ValueError("the block digest is wrong")
    return record, begin + int(size) + 4


def response(page_id: int | None, url: str | None, body: str | None) -> bytes:
    """A response record of a page."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    own = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", f"{'' if page_id is None else page_id} {own} {url or ''}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", own),
        ("WARC-Block-Digest", digest(block)),
        *([] if page_id is None else [("Page-ID", str(page_id))]),
        ("Content-Length", str(len(block))),
    ]
    return record_bytes(Record(headers, block))


def text_and_links(source: str) -> tuple[str, int]:
    """The text of a page, and how many links it has, in one walk: no part is searched twice for an end that is missing."""
    out, links, at = [], 0, 0
    missing: set[str] = set()

    def behind(mark: str, start: int) -> int:
        """Where the first mark from start ends; 0 where there is none up to the end."""
        if mark in missing:
            return 0
        if mark in CLOSED:
            found = CLOSED[mark].search(source, start)
            end = found.end() if found else 0
        else:
            end = source.find(mark, start) + len(mark) if source.find(mark, start) >= 0 else 0
        if not end:
            missing.add(mark)
        return end

    while found := MARKUP.search(source, at):
        comment, slash, name, closed = found.groups()
        begin, close = found.span()
        out.append(source[at:begin])
        if comment:
            if end := behind("-->", close):
                out.append(" ")
                at = end
                continue
            close = closed = behind(">", close)
        if not closed:
            at = begin
            break
        at = close
        if not name:
            continue
        name = name.lower()
        if name in BREAKS:
            out.append("\n")
        elif slash:
            continue
        elif name == "a":
            links += bool(HREF.search(source, found.end(3), close))
        elif name in HIDDEN and (end := behind(name, close)):
            out.append(" ")
            at = end
    out.append(source[at:])
    text = "".join(out)
    lines = (" ".join(x.split()) for x in (html.unescape(text) if "&" in text else text).split("\n"))
    return "\n".join(filter(None, lines)), links


def derived(kind: str, source: Record, content_type: str, block: bytes) -> Record:
    own = source.get("WARC-Record-ID") or ""
    kept = [(name, source.get(name)) for name in ("WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "Page-ID")]
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, own)), ("WARC-Refers-To", own)]
    headers += [(k, v) for k, v in kept if v is not None]
    headers += [("Content-Type", content_type), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return Record(headers, block)


def derivatives(data: bytes) -> tuple[Record, Record, str]:
    """The metadata and conversion records of a response record, and the text."""
    source, _ = parse(data)
    if source.get("WARC-Type") != "response":
        raise ValueError("no response record")
    head, _, payload = source.block.partition(b"\r\n\r\n")
    said = source.get("WARC-Payload-Digest")
    if said is not None and said != digest(payload):
        raise ValueError("the payload digest is wrong")
    status, *fields = head.decode("utf-8", "replace").split("\r\n")
    body = payload.decode("utf-8", "replace")
    text, links = text_and_links(body)
    lines = [f"source-{k}: {v}" for k, v in source.headers] + [f"http-status: {status}"] + [f"http-{f}" for f in fields]
    lines += [f"text-characters: {len(text)}", f"links: {links}"]
    metadata = derived("metadata", source, "application/warc-fields", "".join(x + "\r\n" for x in lines).encode())
    return metadata, derived("conversion", source, "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass")), text


def responses(pages: DataFrame, id_: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, record (binary response record)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, urls, bodies in blocks(batches, 2):
            yield {"page_id": ids, "record": [response(*x) for x in zip(ids, urls, bodies, strict=True)]}

    return arrow_map(pages.select(F.col(id_).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html")), work, "page_id bigint, record binary")


DERIVED = "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length bigint, record_sha256 string, text string"
HEADERS = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Payload-Digest", "WARC-Block-Digest"]


def member(record: bytes) -> bytes:
    """A gzip member of the record, the same at any time."""
    return gzip.compress(record, 1, mtime=0)


def derived_rows(page_id: int | None, data: bytes | None) -> Iterator[tuple[int | None, bytes | None, str | None]]:
    """(page_id, record, fault): the two derived records of a response record, or its fault."""
    try:
        metadata, conversion, _ = derivatives(data or b"")
    except ValueError as e:
        yield page_id, None, str(e)
        return
    yield page_id, record_bytes(metadata), None
    yield page_id, record_bytes(conversion), None


def derive(records: DataFrame) -> DataFrame:
    """page_id, record (binary), fault: two derived records for each row (page_id, record), or one row with the fault."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                found = [r for p, d in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in derived_rows(p, d)]
                yield dict(zip(("page_id", "record", "fault"), map(list, zip(*found, strict=True)), strict=True))

    return arrow_map(records.select("page_id", "record"), work, "page_id bigint, record binary, fault string")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Derives from response records (page_id, record) and writes a file a task under folder (a URI); returns the manifest.

    The manifest (path, records, page_id, fault) has a row for each file, and one for each fault.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name, out, n = f"{folder}/derived-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            bad = []
            for page_id, source in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
                for _, data, fault in derived_rows(page_id, source):
                    if data is None:
                        bad.append((page_id, fault))
                        continue
                    if out is None:
                        system, at = fs.FileSystem.from_uri(name)
                        system.create_dir(at.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(at, compression=None)
                    out.write(member(data))
                    n += 1
            if bad:
                yield {"path": [None] * len(bad), "records": [0] * len(bad), "page_id": [p for p, _ in bad], "fault": [f for _, f in bad]}
        if out is not None:
            out.close()
            yield {"path": [name], "records": [n], "page_id": [None], "fault": [None]}

    return written(arrow_map(records.select("page_id", "record"), work, "path string, records bigint, page_id bigint, fault string"), "manifest")


def members(path: str) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one after the other; the file is never held whole."""
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at, compression=None) as f:
        unpack, out = zlib.decompressobj(31), []
        while data := f.read(READ_BYTES):
            while data:
                out.append(unpack.decompress(data))
                data = unpack.unused_data
                if unpack.eof:
                    yield b"".join(out)
                    unpack, out = zlib.decompressobj(31), []
        if out:
            raise ValueError("the last member is cut off")


def read(paths: DataFrame) -> DataFrame:
    """A row (DERIVED) for each record of the files (path): what its headers say, the digest of its bytes, and its text.

    Only conversion records have a text.  A file that is damaged ends with an error row.
    """
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def row(data: bytes) -> tuple:
        record, end = parse(data)
        if end != len(data):
            raise ValueError("a member holds more than its record")
        page = record.get("Page-ID")
        text = record.block.decode("utf-8", "replace") if record.get("WARC-Type") == "conversion" else None
        return None if page is None else int(page), *map(record.get, HEADERS), len(record.block), hashlib.sha256(data).hexdigest(), text

    def rows(path: str) -> Iterator[tuple]:
        try:
            for data in members(path):
                yield row(data)
        except (ValueError, zlib.error) as e:
            yield None, "error", *[None] * 9, str(e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = rows(path)
                while some := list(itertools.islice(found, READ_ROWS)):
                    yield dict(zip(names, map(list, zip(*some, strict=True)), strict=True))

    return arrow_map(paths.select("path"), work, DERIVED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the derivatives of all pages as WARC files, and reads them back."""
    manifest = write(responses(table(spark, sf_dir, "pages")), scratch(spark, "warc"))
    files = manifest.where("path is not null").select("path")
    faults = manifest.where("fault is not null")
    named = [f.name for f in read(files.limit(0)).schema]
    errors = faults.select("page_id", F.lit("error").alias("record_type"), *(F.lit(None).alias(n) for n in named[2:-1]), F.col("fault").alias("text"))
    spread = min(max(1, files.count()), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read(files.repartition(spread, "path")).unionByName(errors)
