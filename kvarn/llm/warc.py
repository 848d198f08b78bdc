"""WARC derivatives: conversion (plain text) and metadata (links) records for response records.

``responses`` turns a table of pages into response records; ``derive`` makes, for each response, a ``conversion`` record
with its plain text and a ``metadata`` record with its title, language and links, both refer to the response by its record
id and keep its target URI, date, source headers and digests. ``serialise`` and ``parse`` write and read the records'
bytes as WARC 1.1, so archives round-trip.

Null urls become ``urn:page:<id>``, null html is an empty payload; identical rows give identical records. Long pages and pages
with elements, comments or quotes left open are read in time proportional to their length; see ``scan``.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from dataclasses import dataclass, field
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import columns

CRLF = b"\r\n"
RECORD_DATE = "1970-01-01T00:00:00Z"  # pages carry no date
#: Elements that begin a line, those that may stand in a head, those whose content is not shown.
_BREAKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article nav header footer blockquote pre td th hr".split())
_OF_HEAD = set("head title meta link script style base noscript template".split())
_UNSEEN = {"noscript", "template"}
_LINKS = {"a": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "title")}
_ATTRIBUTE = re.compile(r"(?<![\w:-])([a-zA-Z][\w:-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_BLANKS = re.compile(r"[ \t\r\f\v]+")
PART_BYTES = 8_000_000


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """The same record always has the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


@dataclass
class Page:
    """What a page shows and points to."""

    text: str = ""
    title: str = ""
    language: str = ""
    links: list[tuple[str, str, str]] = field(default_factory=list)  # element, attribute, value


def _attributes(tag: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), a or b or c)
    return found


def scan(page: str) -> Page:
    """Read a page from front to back, once: time grows with its length, whatever is left open.

    A comment, script, style or title without an end goes on to the end of the page, as in browsers; a head ends at the
    first element that cannot stand in one. A tag ends at the next ``>``; a ``<`` that no letter, slash, ``!`` or ``?`` follows is text.
    """
    out, shown, at, end = Page(), [], 0, len(page)
    hidden: list[str] = []  # open noscript and template elements
    in_head = False
    titled = False
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not hidden and not in_head:
            shown.append(page[at:lt])
        if lt == end:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            shown.append(" ")
            continue
        stop = page.find(">", lt)
        follows = page[lt + 1 : lt + 2]
        if not (follows.isascii() and follows.isalpha() or follows in ("/", "!", "?")) or stop < 0:
            # text; without any further ">" no tag can come, and the rest is text as well
            to = lt + 1 if stop >= 0 else end
            if not hidden and not in_head:
                shown.append(page[lt:to])
            at = to
            continue
        at, m = stop + 1, _NAME.match(page, lt, stop)
        if m is None:
            continue
        name, closing, tag = m[1].lower(), follows == "/", page[lt:stop]
        if in_head and (name == "head" and closing or name not in _OF_HEAD):
            in_head = False
        if name in _UNSEEN:
            if not closing:
                hidden.append(name)
            elif name in hidden:
                while hidden.pop() != name:
                    pass
            shown.append(" ")
        elif name == "head" and not closing:
            in_head = True
            shown.append(" ")
        if closing:
            if name in _BREAKS:
                shown.append("\n")
            continue
        if name in _LINKS and (value := _attributes(tag).get(_LINKS[name])) is not None:
            out.links.append((name, _LINKS[name], value))
        if name == "html" and not out.language:
            out.language = _attributes(tag).get("lang", "").lower()
        if name in _RAW_END:
            found = _RAW_END[name].search(page, at)
            stop = end if found is None else found.start()
            if name == "title" and not titled and "template" not in hidden:
                out.title, titled = entities.unescape(page[at:stop]).strip(), True
            at = stop
            shown.append(" ")
        elif name in _BREAKS:
            shown.append("\n")
    plain = _BLANKS.sub(" ", entities.unescape("".join(shown)))
    out.text = "\n".join(x for line in plain.split("\n") if (x := line.strip()))
    return out


def text_of(page: str) -> str:
    """The visible text: a line for each block element, entities decoded, blanks collapsed."""
    return scan(page).text


def links_of(page: str | Page, base: str) -> list[dict[str, str]]:
    """Links in their order: the element and attribute, and the absolute address."""
    found = []
    for tag, attr, value in (scan(page) if isinstance(page, str) else page).links:
        at = entities.unescape(value).strip()
        try:
            full = urljoin(base, at)
        except ValueError:
            full = at
        found.append({"path": f"{tag.upper()}@/{attr}", "url": full})
    return found


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; a gzip member for each record is read as well. A torn last record is left out."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            d = zlib.decompressobj(31)
            plain.append(d.decompress(data) + d.flush())
            data = d.unused_data
        data = b"".join(plain)
    found, at = [], 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        start, n = end + 4, int(headers.get("Content-Length", 0))
        if start + n > len(data):
            break
        found.append((headers, data[start : start + n]))
        at = start + n + 4
    return found


def response(page_id: int | None, url: str | None, page: str | None) -> tuple[list[tuple[str, str]], bytes]:
    payload = (page or "").encode()
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(page_id), target, digest(payload))),
        ("WARC-Target-URI", target),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return headers, block


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """The conversion and the metadata record of a response."""
    http, _, payload = block.partition(b"\r\n\r\n")
    page, target, source = payload.decode("utf-8", "replace"), headers["WARC-Target-URI"], headers["WARC-Record-ID"]
    status, *fields = http.decode("utf-8", "replace").split("\r\n")
    kept = {k: v for k, _, v in (x.partition(": ") for x in fields)}
    read = scan(page)
    links = links_of(read, target)
    about = {
        "Envelope": {
            "WARC-Header-Metadata": headers,
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": kept,
                    "HTML-Metadata": {
                        "Title": read.title,
                        "Language": read.language,
                        "Links": links,
                    },
                }
            },
        }
    }

    def record(kind: str, media: str, body: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
        return (
            kind,
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", record_id(kind, source)),
                ("WARC-Refers-To", source),
                ("WARC-Refers-To-Target-URI", target),
                ("WARC-Refers-To-Date", headers.get("WARC-Date", RECORD_DATE)),
                ("WARC-Target-URI", target),
                ("WARC-Date", headers.get("WARC-Date", RECORD_DATE)),
                ("WARC-Source-Payload-Digest", headers.get("WARC-Payload-Digest", digest(payload))),
                ("WARC-Block-Digest", digest(body)),
                ("Content-Type", media),
            ],
            body,
        )

    return [
        record("conversion", "text/plain; charset=utf-8", read.text.encode()),
        record("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()),
    ]


SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, block_digest string, payload_digest string, n_links int, block string, record binary"


def derive(pages: DataFrame) -> DataFrame:
    """Three records for each page (response, conversion, metadata) with their bytes, made in one pass without a shuffle."""

    def build(batches):
        for batch in batches:
            size = np.cumsum(np.array([x or 0 for x in pc.binary_length(batch.column(2)).to_pylist()], dtype=np.int64))
            at = 0
            while at < batch.num_rows:  # a few MB of records at a time
                to = min(batch.num_rows, at + 256, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, side="right"))))
                part, out = batch.slice(at, to - at), []
                at = to
                for page_id, url, page in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    headers, block = response(page_id, url, page)
                    source = dict(headers)
                    out.append((page_id, "response", source["WARC-Record-ID"], None, source["WARC-Target-URI"], source["WARC-Block-Digest"], source["WARC-Payload-Digest"], None, None, serialise(headers, block)))
                    for kind, own, body in derivatives(source, block):
                        named = dict(own)
                        n = len(json.loads(body)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]) if kind == "metadata" else None
                        out.append((page_id, kind, named["WARC-Record-ID"], named["WARC-Refers-To"], named["WARC-Target-URI"], named["WARC-Block-Digest"], named["WARC-Source-Payload-Digest"], n, body.decode(), serialise(own, body)))
                kinds = [pa.int64(), *[pa.string()] * 6, pa.int32(), pa.string(), pa.binary()]
                cols = list(zip(*out, strict=True)) or [[]] * 10
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return columns(pages, "page_id", "url", "html").mapInArrow(build, SCHEMA)


def read(spark, path: str) -> DataFrame:
    """Records of WARC files (plain, or gzipped by record): one row a record, its headers as a map, and its block."""

    def split(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = parse(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in found], pa.binary())],
                    names=["path", "headers", "block"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, "path string, headers map<string,string>, block binary")
