"""Derivatives of web-archive responses: linked metadata and plain-text conversions.

Each response record gives a ``metadata`` record (JSON: source headers, HTTP headers,
title, links) and a ``conversion`` record (plain text). Both point at the response by
``WARC-Refers-To`` and carry their own digests; what the response declared of itself
is kept.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts

VERSION = "WARC/1.1"
#: Elements whose content is no text of the page: it ends at their closing tag only.
RAW_END = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9-]*)")
#: A whole tag without a quote or another opening, as most are: no text is read twice.
PLAIN_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9-]*+)([^<>"']*+)>""")
TAG_MARK = re.compile(r"""[>"']""")
#: A name is tried at its beginning only, and never shortened: linear in the tag.
ATTRIBUTE = re.compile(r"""(?<![\w:.-])([A-Za-z_:][\w:.-]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements that begin a new line of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main nav ol option p pre section table tbody td tfoot th thead title tr "
    "ul".split()
)
#: (element, attribute) that hold a link, by the path it is listed under.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "script": "src", "form": "action"}
#: Elements whose content is no text, but holds links.
UNSHOWN = ("template", "noscript")
#: What a page says of its own encoding, within its first bytes.
META_CHARSET = re.compile(rb"""(?i)<meta\b[^>]*?charset\s*=\s*["']?\s*([\w.:-]+)""")
#: Blanks that one blank stands for; a single blank is one.
BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
COLUMNS = (
    "record_id string, record_type string, refers_to string, target_uri string, warc_date string, "
    "content_type string, block_digest string, payload_digest string, content_length bigint, record binary"
)


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Two characters for each ten bits.
PAIRS = [a + b for a in BASE32 for b in BASE32]


def digest(block: bytes) -> str:
    """SHA-1 in base 32: its 160 bits are sixteen pairs of characters."""
    bits = int.from_bytes(hashlib.sha1(block).digest())
    return "sha1:" + "".join([PAIRS[bits >> at & 1023] for at in range(150, -1, -10)])


def record_id(*parts: str) -> str:
    """The same parts give the same identifier, on every rerun."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class Headers(list):
    """(name, value) pairs in their order, repeated names included.

    Looked up by name in any case, the first of a name is found.
    """

    @classmethod
    def parse(cls, lines: list[str]) -> Headers:
        found: list[tuple[str, list[str]]] = []
        for line in lines:
            name, colon, value = line.partition(":")
            if line[:1] in (" ", "\t") and found:
                # A folded line goes on with the value before it.
                found[-1][1].append(line.strip())
            elif colon:
                found.append((name.strip(), [value.strip()]))
        return cls((name, " ".join(filter(None, values))) for name, values in found)

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), default)

    def __getitem__(self, name):  # noqa: ANN001, ANN204
        if not isinstance(name, str):
            return super().__getitem__(name)
        if (value := self.get(name)) is None:
            raise KeyError(name)
        return value

    def __contains__(self, name: object) -> bool:
        return self.get(name) is not None if isinstance(name, str) else super().__contains__(name)


def parse_record(raw: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record; the declared length bounds the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = Headers.parse(head.decode("utf-8", "replace").split("\r\n")[1:])
    length = headers.get("Content-Length", "")
    return headers, rest[: int(length)] if re.fullmatch("[0-9]+", length) else rest


def one_line(value: str) -> str:
    """A header's value: without line ends, which would begin another header."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def response(uri: str, html: str, date: str) -> bytes:
    """A response record around a page."""
    payload = html.encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + payload
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id("response", uri, date, html),
        "WARC-Date": date,
        "WARC-Target-URI": one_line(uri),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest(payload),
        "WARC-Block-Digest": digest(block),
    }
    return record(headers, block)


class Tags:
    """The tags, declarations and hidden parts of a page, from left to right in linear time.

    Iterates over (first, end, name, closing, attributes): the text between them is the
    page's. A comment, script or style without an end goes to the page's end. In a tag,
    ``>`` within quotes does not end it; where a quote is never closed, quotes count as
    plain characters up to it. A ``<`` that begins no tag is text.
    """

    def __init__(self, html: str):
        self.html = html
        #: Where no quote is heeded before, and what is known not to come any more.
        self.plain_until, self.last_end = 0, html.rfind(">")

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        html, at = self.html, 0
        while (first := html.find("<", at)) >= 0:
            if plain := PLAIN_TAG.match(html, first):
                slash, name, inside = plain.groups()
                name, at = name.lower(), plain.end()
                if name in RAW_END and not slash:
                    over = RAW_END[name].search(html, at)
                    at = over.end() if over else len(html)
                yield first, at, name, bool(slash), inside
                continue
            at = first + 1
            if html.startswith("<!--", first):
                end = html.find("-->", first + 4)
                at = len(html) if end < 0 else end + 3
                yield first, at, "", False, ""
            elif html[at : at + 1] in ("!", "?") and at < self.last_end:
                at = html.find(">", at) + 1
                yield first, at, "", False, ""
            elif name := NAME.match(html, at):
                end = self.tag_end(name.end())
                if end < 0:
                    continue
                at, closing = end, html[first + 1] == "/"
                known, inside = name[1].lower(), html[name.end() : end - 1]
                if known in RAW_END and not closing:
                    over = RAW_END[known].search(html, end)
                    at = over.end() if over else len(html)
                    yield first, at, known, False, inside
                else:
                    yield first, at, known, closing, inside

    def tag_end(self, at: int) -> int:
        """The end of the tag whose name ends here, or -1."""
        if at > self.last_end:
            return -1
        mark = at
        while mark >= self.plain_until and (m := TAG_MARK.search(self.html, mark)):
            if m[0] == ">":
                return m.end()
            closing = self.html.find(m[0], m.end())
            if closing < 0:
                # No such quote comes any more; those before it are plain from now on.
                self.plain_until = m.end()
                break
            mark = closing + 1
        return self.html.find(">", at) + 1


def page(html: str, base: str) -> tuple[str, str, list[dict[str, str]]]:
    """Title, plain text and links of a page, in one pass over its tags."""
    out, links, title, last, in_title, unshown = [], [], [], 0, False, ""
    joined = is_absolute(base)
    for first, end, name, closing, attributes in Tags(html):
        piece = html[last:first]
        last = end
        if piece and not unshown:
            out.append(piece)
            if in_title:
                title.append(piece)
        if name in BLOCKS:
            # None of these is hidden, a link or a title but the last.
            if not unshown:
                out.append("\n")
                if name == "title":
                    in_title = not closing
            if name != "form" or closing:
                continue
        elif name in RAW_END and not closing or not name:
            out.append(" ")
        if name in UNSHOWN and not unshown and not closing:
            unshown = name
            out.append(" ")
        elif name == unshown and closing:
            unshown = ""
        if not closing and name in LINKS:
            wanted = LINKS[name]
            for a in ATTRIBUTE.finditer(attributes):
                if a[1].lower() == wanted:
                    links.append({"path": f"{name.upper()}@/{wanted}", "url": resolved(base, unescape(a[2] or a[3] or a[4] or ""), joined)})
                    break
    if not unshown:
        out.append(html[last:])
    lines = (x.strip() for x in BLANKS.sub(" ", unescape("".join(out))).split("\n"))
    return BLANKS.sub(" ", unescape("".join(title))).strip(), "\n".join(x for x in lines if x), links


def decoded(payload: bytes, content_type: str) -> str:
    """By the byte order mark, else the charset of the header, else of the page, else UTF-8."""
    marks = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
    told = re.search(r"""(?i);\s*charset\s*=\s*["']?\s*([\w.:-]+)""", content_type)
    inside = META_CHARSET.search(payload[:1024])
    name = next((n for mark, n in marks if payload.startswith(mark)), None)
    name = name or (told[1] if told else inside[1].decode("ascii", "replace") if inside else "utf-8")
    if name.lower() in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii"):
        # As browsers read these names.
        name = "cp1252"
    try:
        return payload.decode(name, "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def is_absolute(base: str) -> bool:
    """Whether a page's links can be joined to its address."""
    try:
        return bool(urlsplit(base).scheme)
    except ValueError:
        return False


def resolved(base: str, url: str, joined: bool) -> str:
    try:
        return urljoin(base, url.strip()) if joined else url.strip()
    except ValueError:
        return url.strip()


def http_parts(block: bytes) -> tuple[str, Headers, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *rest = head.decode("latin-1").split("\r\n")
    return status, Headers.parse(rest), payload


def derive(raw: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and conversion records of one response record."""
    return derived(*parse_record(raw))


def derived(source: Headers, block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The same, of a record's headers and block."""
    status, http, payload = http_parts(block)
    uri, date, origin = (source.get(k, "") for k in ("WARC-Target-URI", "WARC-Date", "WARC-Record-ID"))
    title, text, links = page(decoded(payload, http.get("Content-Type", "")), uri)
    conversion, own = text.encode("utf-8", "replace"), digest(block)
    told = {
        "Envelope": {
            "WARC-Header-Metadata": source,
            "Actual-Content-Length": len(block),
            "Block-Digest": own,
            "Block-Digest-Matches": source.get("WARC-Block-Digest") == own,
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": http,
                    "Entity-Length": len(payload),
                    "Entity-Digest": digest(payload),
                    "HTML-Metadata": {"Title": title, "Links": links},
                }
            },
        },
        "Conversion-ID": record_id("conversion", origin),
    }
    metadata = json.dumps(told, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    out = []
    for kind, content, body in (("metadata", "application/json", metadata), ("conversion", "text/plain", conversion)):
        headers = {
            "WARC-Type": kind,
            "WARC-Record-ID": record_id(kind, origin),
            "WARC-Refers-To": origin,
            "WARC-Date": date,
            "WARC-Target-URI": uri,
            "Content-Type": content,
            "WARC-Block-Digest": digest(body),
        }
        out.append((headers, body))
    return out


def responses(pages: DataFrame, url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages`` with ``response``, a response record of each; null is empty text.

    For tables that hold pages rather than archived records. The page is replaced by
    its record; a column ``response`` is replaced.
    """
    pages = pages.drop("response")
    rest = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(u, h, date) for u, h in zip(texts(batch.column(url)), texts(batch.column(html)))]
            columns = {c: batch.column(c) for c in rest} | {"response": pa.array(made, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField("response", T.BinaryType())])
    return pages.mapInArrow(run, schema)


def derivatives(records: DataFrame, response: str = "response") -> DataFrame:
    """A row for each of the two derivatives of each response record.

    The input's other columns are kept, before the record's: its identifier, type,
    what it refers to, target, date, content type, block digest, the response's
    payload digest, content length and the bytes of the whole record. Columns of the
    same name are replaced. A null record is an empty one: its derivatives refer to
    nothing, and have no links and no text. Equal records have equal identifiers.
    """
    added = T._parse_datatype_string(COLUMNS)
    rest = [c for c in records.columns if c != response and c not in added.names]
    kept = records.select(*rest, response)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, ROWS):
                piece = batch.slice(part, ROWS)
                yield _derived(piece, rest, response)

    return kept.mapInArrow(run, T.StructType([*(kept.schema[c] for c in rest), *added.fields]))


#: Records whose derivatives are in memory at once.
ROWS = 200


def _derived(batch: pa.RecordBatch, rest: list[str], response: str) -> pa.RecordBatch:
    made, of = [], []
    for i, raw in enumerate(batch.column(response).to_pylist()):
        source, block = parse_record(raw or b"")
        for headers, body in derived(source, block):
            of.append(i)
            made.append(
                (
                    headers["WARC-Record-ID"],
                    headers["WARC-Type"],
                    headers["WARC-Refers-To"],
                    headers["WARC-Target-URI"],
                    headers["WARC-Date"],
                    headers["Content-Type"],
                    headers["WARC-Block-Digest"],
                    source.get("WARC-Payload-Digest", ""),
                    len(body),
                    record(headers, body),
                )
            )
    columns = {c: batch.column(c).take(pa.array(of, pa.int32())) for c in rest}
    names = ["record_id", "record_type", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "content_length", "record"]
    kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]
    for name, kind, values in zip(names, kinds, zip(*made) if made else [[]] * 10):
        columns[name] = pa.array(list(values), kind)
    return pa.RecordBatch.from_pydict(columns)


def summary(records: DataFrame, key: str = "page_id") -> DataFrame:
    """The records' fields, with a hash and the characters of their bytes in their place."""
    text = F.decode("record", "UTF-8")
    return records.select(
        key,
        "record_id",
        "record_type",
        "refers_to",
        "target_uri",
        "block_digest",
        "payload_digest",
        "content_length",
        F.sha2("record", 256).alias("record_sha256"),
        F.length(text).cast("long").alias("record_chars"),
    )
