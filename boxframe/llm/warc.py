"""WARC derivatives: metadata and plain-text records for captured pages.

`responses` makes response records of a page table; `derivatives` makes of each a
`metadata` record (JSON: the source record's headers and digests, the page's title,
metas and links) and a `conversion` record (the plain text). Both carry the
response's id as WARC-Refers-To, its target URI and date, their own block digest,
and an id that depends on the response's id and the type only, so a rerun gives the
same records. `to_bytes` and `parse` write and read the records' WARC form; `packed`
gives each record as a gzip member.

Records are made row by row of one page, without a shuffle.

Defined results: null html counts as an empty body, null url gives no WARC-Target-URI
and relative links stay as they are; a null page id takes part in the record id as
an empty name; repeated pages give repeated records with equal ids; markup that is
not closed ends with the page; an empty table gives no records; other columns are
ignored.
"""

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slices, table

# Pages carry no capture time: responses made of them take this unless told.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("7c1f3a52-6e1e-5b8e-9a55-0d6f5a3f9c11")

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-z][^>]*+(?:>|\Z)"
    r"|[^<]++|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-z][a-z0-9:_-]*+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.I)
# Elements that end a line of text, and attributes that hold links.
_LINES = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th "
    "thead title tr ul".split()
)
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src"}
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def _attributes(rest):
    out = {}
    for name, value in _ATTRIBUTE.findall(rest):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def read_page(markup: str, url: str | None):
    """Title, metas, links and plain text of a page."""
    text, title, metas, links, in_title = [], [], [], [], False
    for m in _MARKUP.finditer(markup):
        name = m["name"]
        if name is None:
            raw = m["raw"]
            if raw:
                if raw.lower() == "script":
                    rest = m[0][7 : m[0].find(">")]
                    source = _attributes(rest).get("src") if "src" in rest.lower() else None
                    if source:
                        links.append({"path": "script@src", "url": _resolve(url, source)})
            elif m[0][0] != "<" or m[0] == "<":
                part = html.unescape(m[0]) if "&" in m[0] else m[0]
                (title if in_title else text).append(part)
            continue
        name = name.lower()
        if name in _LINES:
            text.append("\n")
        if name == "title":
            in_title = not m["close"]
            continue
        if m["close"]:
            continue
        if name in _LINKS or name == "meta":
            at = _attributes(m["rest"])
            if name == "meta":
                if at:
                    metas.append(at)
            elif at.get(_LINKS[name]):
                links.append({"path": f"{name}@{_LINKS[name]}", "url": _resolve(url, at[_LINKS[name]])})
    lines = (_BLANKS.sub(" ", line).strip() for line in "".join(text).split("\n"))
    return {
        "title": " ".join("".join(title).split()),
        "metas": metas,
        "links": links,
        "text": "\n".join(line for line in lines if line),
    }


def _resolve(url, link):
    try:
        return urljoin(url, link.strip()) if url else link
    except ValueError:
        return link


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(names))}>"


RECORD = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, "
    "date string, content_type string, payload_digest string, block_digest string, "
    "content_length long, headers string, content binary"
)
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_TYPES = [
    pa.binary() if n == "content" else pa.int64() if n in ("page_id", "content_length") else pa.string()
    for n in _NAMES
]


def _record(page_id, kind, id_, refers_to, uri, date, content_type, content, payload_digest=None):
    """A record as a row; `headers` holds the WARC header lines in order."""
    block_digest = digest(content)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", id_),
        ("WARC-Refers-To", refers_to),
        ("WARC-Target-URI", uri),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", payload_digest),
        ("WARC-Block-Digest", block_digest),
        ("Content-Type", content_type),
        ("Content-Length", str(len(content))),
    ]
    # A line end within a value would begin another header.
    headers = "\r\n".join(f"{k}: {' '.join(v.splitlines())}" for k, v in fields if v is not None)
    return (
        page_id, kind, id_, refers_to, uri, date, content_type, payload_digest, block_digest,
        len(content), headers, content,
    )


def _response(page_id, url, markup, date):
    body = (markup or "").encode()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(body)}\r\n\r\n"
    ).encode()
    id_ = record_id("response", "" if page_id is None else str(page_id), url or "", digest(body))
    return _record(
        page_id, "response", id_, None, url, date, "application/http; msgtype=response",
        http + body, digest(body),
    )


def http_parts(content: bytes):
    """Status line, header pairs and body of an HTTP response block."""
    head, _, body = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [tuple(p.strip() for p in x.split(":", 1)) for x in lines[1:] if ":" in x], body


def _derived(response):
    """The metadata and the conversion record of a response row."""
    page_id, _, id_, _, uri, date, kind, payload, block, length, headers, content = response
    status, pairs, body = http_parts(content)
    page = read_page(body.decode("utf-8", "replace"), uri)
    envelope = {
        "WARC-Header-Metadata": dict(h.split(": ", 1) for h in headers.split("\r\n")),
        "Block-Digest": block,
        "Content-Length": length,
        "Payload-Metadata": {
            "Actual-Content-Type": kind,
            "Actual-Payload-Digest": digest(body),
            "Digest-Matches": payload is None or payload == digest(body),
            "Status-Line": status,
            "HTTP-Headers": [list(p) for p in pairs],
            "HTML-Metadata": {"Title": page["title"], "Metas": page["metas"], "Links": page["links"]},
        },
    }
    meta = json.dumps({"Envelope": envelope}, ensure_ascii=False, sort_keys=True).encode()
    text = page["text"].encode()
    yield _record(
        page_id, "metadata", record_id("metadata", id_), id_, uri, date, "application/json", meta, payload
    )
    yield _record(
        page_id, "conversion", record_id("conversion", id_), id_, uri, date, "text/plain; charset=utf-8", text, payload
    )


def _batch(rows):
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES
    )


def responses(pages: DataFrame, date=DATE) -> DataFrame:
    """A response record for every page (page_id, url, html)."""

    def make(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "html")]
                yield _batch([_response(*row, date) for row in zip(*columns, strict=True)])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        make, RECORD
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response among the records."""

    def make(batches):
        for batch in batches:
            for part in slices(batch, "content"):
                rows = zip(*[part.column(c).to_pylist() for c in _NAMES], strict=True)
                yield _batch([made for row in rows for made in _derived(row)])

    return records.where("record_type = 'response'").select(*_NAMES).mapInArrow(make, RECORD)


def to_bytes(headers: str, content: bytes) -> bytes:
    return b"WARC/1.0\r\n" + headers.encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def parse(stream: bytes):
    """(header pairs, content) of the records in uncompressed WARC bytes."""
    at = 0
    while at < len(stream):
        end = stream.index(b"\r\n\r\n", at)
        lines = stream[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield fields, stream[start:stop]
        at = stop + 4


def packed(records: DataFrame) -> DataFrame:
    """Each record as a gzip member, `member`; members behind one another are a file."""

    def make(batches):
        for batch in batches:
            for part in slices(batch, "content"):
                rows = zip(part.column("headers").to_pylist(), part.column("content").to_pylist(), strict=True)
                members = [gzip.compress(to_bytes(h, c), mtime=0) for h, c in rows]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    return records.select("headers", "content").mapInArrow(make, "member binary")


def op5_warc_derivatives(spark, sf_dir):
    """Metadata and conversion records of all pages."""
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.withColumn("content", F.decode("content", "utf-8"))


QUERIES = {"op5_warc_derivatives": op5_warc_derivatives}
