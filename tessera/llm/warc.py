"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response becomes a `metadata` record (JSON: HTTP status and headers, title, meta tags, links made absolute) and a
`conversion` record (plain text of the page). Both carry the response's id as WARC-Refers-To, its target and date, and
their own block digest; the response's payload digest goes along as WARC-Source-Payload-Digest. Record ids are derived
from the response's id and the type, so a repeated task writes the same records.

Defined results: a null or empty payload gives records with empty title, links and text. Headers of the source are kept
as they are, in order. Malformed markup is read as far as it goes: an open comment, script, style, noscript or template
runs to the end. A `<` opens a tag before a letter or `/` and a letter, a comment before `!`, `?` or another `/`; any other
is text, wherever the next `>` is. A tag ends at the first `>` outside its quoted values, however many attributes it has; a
quote counts after `=` only, and one that never closes is none. A head ends at the first thing that can't stand in one (its
end tag may be missing), an svg also at an HTML block or text element. What follows the last `>` is text; pages are read in
linear time. Repeated rows give repeated records; a null URL gives an
empty target, and relative links then stay as they are; a null date gives an empty one, a null record id an empty reference.
In files line breaks in a header's value become blanks. Columns to carry along may have any name and type. No rows give no
rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import BinaryIO
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_arrow, materialize, named, scratch_path

#: Elements whose content is no text, elements that end a line, and those that end an open svg (fixed values).
HIDDEN = "script|style|noscript|template"
BLOCKS = frozenset("address article aside blockquote br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())

BREAKOUT = "|".join(sorted(BLOCKS - {"title"} | set("b big body button center code em embed head html i img label listing menu meta nobr ruby s small span strong strike sub sup tt u var".split())))

NAME_END = r"(?=[\s/>])"
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
#: A value with its quotes, or up to white space; names may begin with any character, also `=`.
VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)"
ATTRIBUTES = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{VALUE})?+)*+"


def _whole(names: str) -> str:
    """Any of the elements up to its end tag or the page's end (no group: re loses groups within possessive repeats)."""
    return "|".join(rf"<{name}{NAME_END}{ATTRIBUTES}>.*?(?:</{name}\s*>|\Z)" for name in names.split("|"))


HEAD = rf"<head{NAME_END}{ATTRIBUTES}>(?:\s++|{COMMENT}|{_whole(HIDDEN + '|title')}|</?(?:meta|link|base|basefont|bgsound|noframes){NAME_END}{ATTRIBUTES}>)*+(?:</head\s*>)?"
SVG = rf"<svg{NAME_END}{ATTRIBUTES}>(?:(?<=/>)|(?:[^<]++|{COMMENT}|{_whole('script|style')}|<(?!/svg\s*>|/?(?:{BREAKOUT}){NAME_END}))*+(?:</svg\s*>)?)"
TOKEN = re.compile(rf"{COMMENT}|<({HIDDEN}){NAME_END}{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|{HEAD}|{SVG}|</?([A-Za-z][^\s/>]*+){ATTRIBUTES}>|<[/!?][^>]*+>", re.S | re.I)
TITLE, TITLE_END = re.compile(rf"<title{NAME_END}{ATTRIBUTES}>", re.I), re.compile(r"</title\s*>", re.I)
TAG = re.compile(rf"<(a|meta){NAME_END}({ATTRIBUTES})>", re.I)
ATTRIBUTE = re.compile(r"([A-Za-z:_-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
UNSEEN = re.compile(rf"{COMMENT}|<({HIDDEN}){NAME_END}{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Stands where the last part of a page was cut off.
MARK = "\ue000"
SPACES = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")

RECORDS = "record_type string, record_id string, refers_to string, target_uri string, date string, source_payload_digest string, block_digest string, content_type string, content_length long, block binary"
READ = "record_type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, block_digest string, content_type string, http_headers string, payload binary"
ARROW = pa.schema([(n, pa.int64() if k == "long" else pa.binary() if k == "binary" else pa.string()) for n, k in (x.split() for x in RECORDS.split(", "))])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(parts).encode()).digest()[:16], version=5)}>"


def page_text(page: str) -> str:
    """The page's text: a line for each block, white space collapsed."""

    def gap(m: re.Match) -> str:
        name = m[2] or m[1]
        return "\n" if name and name.lower() in BLOCKS else ""

    text = html.unescape("".join(_without(TOKEN, page.replace("\n", " ").replace("\r", " "), gap)))
    return LINES.sub("\n", SPACES.sub(" ", text)).strip()


def _without(pattern: re.Pattern, page: str, put: str | Callable[[re.Match], str]) -> tuple[str, str]:
    """The page up to its last `>` with matches replaced, and what follows if nothing hidden is open there.

    No tag ends after the last `>`, so nothing is sought there; a mark in its place tells whether a match runs to the end."""
    end = page.rfind(">") + 1
    head = pattern.sub(put, page[:end] + MARK)
    return (head[:-1], page[end:].partition("<!--")[0]) if head.endswith(MARK) else (head, "")


def page_facts(page: str, url: str) -> dict:
    """Title, meta tags and links (absolute where the page's URL is known)."""
    seen, tail = _without(UNSEEN, page, "")
    title = ""
    if begin := TITLE.search(seen):
        stop = TITLE_END.search(seen, begin.end())
        title = seen[begin.end() : stop.start()] if stop else seen[begin.end() :] + tail
    links, metas = [], []
    for m in TAG.finditer(seen):
        own = {k.lower(): html.unescape(next((x for x in v if x), "")) for k, *v in ATTRIBUTE.findall(m[2])}
        if m[1].lower() == "meta":
            metas.append(own)
        elif "href" in own:
            links.append(_absolute(url, own["href"]))
    return {"title": " ".join(html.unescape(title).split()), "metas": metas, "links": links}


def _absolute(url: str, href: str) -> str:
    try:
        return urljoin(url, href.strip()) if url else href
    except ValueError:  # brackets that are no address
        return href


def derive(response_id: str, url: str | None, date: str, http_headers: str, payload: bytes | None, payload_digest: str | None = None) -> list[dict]:
    """The metadata and the conversion record of a response."""
    response_id, payload, url, date = response_id or "", payload or b"", url or "", date or ""
    page = payload.decode("utf-8", "replace")
    source = payload_digest or digest(payload)
    status, *lines = http_headers.split("\r\n") if http_headers else [""]
    headers = [line.split(":", 1) for line in lines if ":" in line]
    facts = {"response": {"status": status, "headers": [[k.strip(), v.strip()] for k, v in headers]}, **page_facts(page, url), "payload_digest": source, "payload_length": len(payload)}
    blocks = (("metadata", "application/json", json.dumps(facts, ensure_ascii=False, separators=(",", ":")).encode()), ("conversion", "text/plain; charset=utf-8", page_text(page).encode("utf-8", "replace")))
    return [
        {"record_type": kind, "record_id": record_id(response_id, kind), "refers_to": response_id, "target_uri": url, "date": date, "source_payload_digest": source,
         "block_digest": digest(block), "content_type": content, "content_length": len(block), "block": block}
        for kind, content, block in blocks
    ]


def derivatives(responses: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response (record_id, target_uri, date, http_headers, payload); `keep` names columns to carry along."""
    columns = [*keep, "record_id", "target_uri", "date", "http_headers", "payload"]
    kept = T.StructType([*(responses.schema[c] for c in keep), *T.StructType.fromDDL(RECORDS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 64):
                batch = whole.slice(start, 64)
                rows = [r for own in zip(*(c.to_pylist() for c in batch.columns[len(keep) :])) for r in derive(own[0], own[1], own[2], own[3], own[4])]
                made = pa.RecordBatch.from_pylist(rows, ARROW)
                twice = pa.array([i for i in range(len(batch)) for _ in range(2)])
                yield pa.RecordBatch.from_arrays([*(c.take(twice) for c in batch.columns[: len(keep)]), *made.columns], names=[*keep, *ARROW.names])

    return map_arrow(responses.select(*map(named, columns)), run, kept)


def page_responses(pages: DataFrame, date: str) -> DataFrame:
    """Response rows of a pages table (page_id, url, html): ids come from page id and URL."""
    payload = F.encode("html", "utf-8")
    hashed = F.sha2(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).cast("binary"), 256)
    spelled = F.regexp_replace(F.substring(hashed, 1, 32), r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"))
    return pages.select("page_id", F.concat(F.lit("<urn:uuid:"), spelled, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), payload.alias("payload"))


#: A record's headers and the columns that they come from, in the order of files.
HEADERS = (
    ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
    ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
)


def warc_record(row: dict) -> bytes:
    """A record as it stands in a file; a value is one line."""
    value = lambda x: " ".join(str("" if x is None else x).splitlines())
    head = "".join(f"{name}: {value(row[column])}\r\n" for name, column in HEADERS)
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "replace") + row["block"] + b"\r\n\r\n"


def stream_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open file, gzipped record by record or plain, one record at a time."""
    buffered = io.BufferedReader(file, 1 << 16)
    plain = gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a record must begin with its version")
        headers: dict[str, str] = {}
        while line := plain.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name] = value.strip()
        yield headers, plain.read(int(headers["Content-Length"]))
        plain.read(4)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file's bytes."""
    yield from stream_records(io.BytesIO(data))


def read_warc(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """The records of WARC files (URIs that pyarrow.fs knows), a task for each file, one record in memory at a time.

    Columns: record_type, record_id, refers_to, target_uri, date, payload_digest, block_digest, content_type,
    http_headers (what stands before the first empty line of a response's block, else null), payload (the rest)."""
    if not files:
        return spark.createDataFrame([], READ)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as file:
                    for headers, block in stream_records(file):
                        get = {k.lower(): v for k, v in headers.items()}.get
                        http, payload = None, block
                        if get("warc-type") == "response" and block.startswith(b"HTTP/"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            http = head.decode("utf-8", "replace")
                        own = [get(x) for x in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date")]
                        own += [get("warc-payload-digest") or get("warc-source-payload-digest"), get("warc-block-digest"), get("content-type"), http]
                        yield pa.record_batch([*(pa.array([x], pa.string()) for x in own), pa.array([payload], pa.binary())], names=[x.split()[0] for x in READ.split(", ")])

    paths = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files), "file")
    return map_arrow(paths, run, READ)


def write_warc(records: DataFrame) -> DataFrame:
    """Write derivative rows as gzipped WARC files into the shared folder; the manifest (file, n_records) names those that count."""
    folder = scratch_path(records.sparkSession, "warc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, count, uri = None, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, path = pafs.FileSystem.from_uri(uri)
                    store.create_dir(os.path.dirname(path), recursive=True)
                    out = store.open_output_stream(path, compression=None)
                out.write(gzip.compress(warc_record(row), 6, mtime=0))
                count += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([uri]), pa.array([count], pa.int64())], names=["file", "n_records"])

    return materialize(map_arrow(records.select(*ARROW.names), run, "file string, n_records long"), "warc-manifest")
