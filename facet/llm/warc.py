"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Each response gives two records that refer to it (WARC-Refers-To) and carry its target URI and date:
a ``metadata`` record, whose JSON block holds the source's WARC and HTTP headers, its digests, and the
page's title, meta fields and links; and a ``conversion`` record with the page's visible text.
Record ids are name-based UUIDs, so a rerun gives the same records; digests are SHA-1 in base 32, as the
format's tools write them.  ``to_bytes`` and ``parse`` are exact inverses for the files themselves.

Every record is built from its own response alone: no shuffle, and memory for one batch.

Repeated headers keep their order and number, and names compare without case.  Chunked, gzip and deflate bodies are decoded
for the text; digests are of the payload as it came.

Defined results: ids of any type, null included, pass through untouched and count by their text; texts are read whole, whatever their length; a null html is an empty payload; a null or empty url has no target URI; pages that
are not well-formed give what their tags still tell (an unclosed script hides the rest); repeated rows give
repeated records with the same ids; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urljoin, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

Pairs = list[tuple[str, str]]
EPOCH = "1970-01-01T00:00:00Z"
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*"|'[^']*'|["'])*+)>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_ORIGIN = re.compile(r"https?://[^/?#]+")
_SPACE = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def to_bytes(headers: Pairs, block: bytes) -> bytes:
    """One WARC/1.1 record; Content-Length is added."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _lines(f: io.BufferedIOBase) -> Iterator[str]:
    """The lines of a header block, folded ones joined."""
    held: str | None = None
    while (line := f.readline().rstrip(b"\r\n")) != b"":
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and held is not None:
            held += " " + text.strip()
        else:
            if held is not None:
                yield held
            held = text
    if held is not None:
        yield held


class Headers(dict[str, str]):
    """A header block: by name its first value, and in ``pairs`` all names and values in order."""

    def __init__(self, pairs: Pairs):
        super().__init__(reversed(pairs))
        self.pairs = pairs


def pairs_of(headers: Pairs | dict[str, str]) -> Pairs:
    return getattr(headers, "pairs", None) or (list(headers.items()) if isinstance(headers, dict) else [tuple(x) for x in headers])


def header(headers: Pairs, name: str, default: str | None = None) -> str | None:
    """The first value of a header, whatever the case of its name."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def parse(data: bytes | io.BufferedIOBase) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record of a file, plain or gzipped, one at a time; headers keep order, case and repeats."""
    f = io.BytesIO(data) if isinstance(data, bytes) else io.BufferedReader(data) if not hasattr(data, "peek") else data
    start = f.peek(2)[:2] if hasattr(f, "peek") else f.getvalue()[:2]
    if start == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        pairs = [(k, v.strip()) for k, _, v in (x.partition(":") for x in _lines(f))]
        yield Headers(pairs), f.read(int(header(pairs, "Content-Length", "0")))


def split_http(block: bytes) -> tuple[str, Pairs, bytes]:
    """(status line, headers, payload) of an HTTP response; a block without headers is all payload."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("latin-1")).split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def _unchunked(body: bytes) -> bytes:
    """The body of a chunked message; what is not well-formed stays as it is from there on."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        found = re.match(rb"[0-9a-fA-F]+(?=[\s;]|\Z)", body[at:end].strip()) if end >= 0 else None
        if found is None:
            return b"".join(out) + (body[at:] if end < 0 or body[at:end].strip() else b"")
        n = int(found[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        if body[at : at + 2] == b"\r\n":
            at += 2
        elif body[at : at + 1] == b"\n":
            at += 1


def _inflated(body: bytes, coding: str) -> bytes:
    """A gzip or deflate body; of a damaged one as much as can be read, of one that is neither the body itself."""
    for wbits in (47,) if coding == "gzip" else (47, -15):
        z, out, rest = zlib.decompressobj(wbits), b"", body
        try:
            while rest:
                out += z.decompress(rest) + z.flush()
                rest = z.unused_data
                z = zlib.decompressobj(wbits)
        except zlib.error:
            z = zlib.decompressobj(wbits)
            for i in range(0, len(body) if not out else 0, 512):
                try:
                    out += z.decompress(body[i : i + 512])
                except zlib.error:
                    break
        if out:
            return out
    return body


def body_of(payload: bytes, headers: Pairs) -> bytes:
    """The payload without its transfer and content codings (chunked, gzip, deflate); of an unknown coding as it is."""
    for name in ("Transfer-Encoding", "Content-Encoding"):
        codings = [c.strip().lower() for k, v in headers if k.lower() == name.lower() for c in v.split(",")]
        for c in reversed(codings):
            payload = _unchunked(payload) if c == "chunked" else _inflated(payload, c.removeprefix("x-")) if c in ("gzip", "x-gzip", "deflate") else payload
    return payload


def decoded(payload: bytes, headers: Pairs) -> str:
    found = re.search(r"charset=[\"']?([\w.:-]+)", header(headers, "Content-Type", ""), re.I) or re.search(rb"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", payload[:4096], re.I)
    name = found[1] if found else "utf-8"
    try:
        return payload.decode(name if isinstance(name, str) else name.decode("ascii"), "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def read_html(page: str, base: str | None = None) -> dict:
    """title, text, links [{url, text}] and meta [{name, content}] of a page."""
    out: list[str] = []
    links, meta, title = [], [], ""
    at, in_title, anchor = 0, None, None
    origin = _ORIGIN.match(base or "")
    for m in _TOKEN.finditer(page):
        out.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            out.append(" ")
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            out.append("\n")
        if tag == "title":
            if m[2] or in_title is not None:
                title = title or " ".join(entities.unescape("".join(out[in_title or 0 :])).split())
                in_title = None
            else:
                in_title = len(out)
        elif tag == "a":
            if anchor is not None:
                links[anchor[0]]["text"] = " ".join(entities.unescape("".join(out[anchor[1] :])).split())
                anchor = None
            if not m[2]:
                href = next((next(g for g in a.groups()[1:] if g is not None) for a in _ATTR.finditer(m[4]) if a[1].lower() == "href"), None)
                if href is not None:
                    url = entities.unescape(href).strip()
                    if origin and url[:1] == "/" and url[:2] != "//" and "/." not in url:
                        url = origin[0] + url
                    elif base:
                        try:
                            url = urljoin(base, url)
                        except ValueError:
                            pass
                    links.append({"url": url, "text": ""})
                    anchor = (len(links) - 1, len(out))
        elif tag == "meta" and not m[2]:
            own = {a[1].lower(): entities.unescape(next(g for g in a.groups()[1:] if g is not None)) for a in _ATTR.finditer(m[4])}
            if own:
                meta.append(own)
    out.append(page[at:])
    text = _LINES.sub("\n", _SPACE.sub(" ", entities.unescape("".join(out)).replace("\r", "\n"))).strip()
    return {"title": title, "text": text, "links": links, "meta": meta}


def response(key: object, url: str | None, page: str | None, date: str = EPOCH) -> tuple[Pairs, bytes]:
    """(headers, block) of the response record of a page."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    own = digest(payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", urn("response", key, url, own)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url else []
    return headers + [("WARC-Payload-Digest", own), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block


def derive(headers: Pairs | dict[str, str], block: bytes) -> list[tuple[Pairs, bytes]]:
    """The metadata and the conversion record of a response.

    The metadata holds the source's headers twice: as an object (of a repeated name the values as a list) and in order as pairs."""
    headers = pairs_of(headers)
    status, http, payload = split_http(block)
    source, uri, date = header(headers, "WARC-Record-ID", ""), header(headers, "WARC-Target-URI"), header(headers, "WARC-Date", EPOCH)
    page = read_html(decoded(body_of(payload, http), http), uri)
    computed = digest(payload)  # a source may have been cut or altered after its header was written
    found = header(headers, "WARC-Payload-Digest") or computed
    envelope = {
        "WARC-Header": _object(headers), "WARC-Header-Pairs": headers,
        "Digests": {"Block": header(headers, "WARC-Block-Digest") or digest(block), "Payload": found, "Payload-Computed": computed},
        "HTTP": {"Status": status, "Headers": _object(http), "Header-Pairs": http, "Payload-Length": len(payload)},
        "HTML": {"Title": page["title"], "Meta": page["meta"], "Links": page["links"]},
    }
    made = []
    for kind, body, form in (("metadata", json.dumps({"Envelope": envelope}, ensure_ascii=False, sort_keys=True), "application/json"), ("conversion", page["text"], "text/plain; charset=utf-8")):
        b = body.encode("utf-8", "replace")
        own = [("WARC-Type", kind), ("WARC-Record-ID", urn(kind, source)), ("WARC-Refers-To", source), ("WARC-Date", date)]
        own += [("WARC-Target-URI", uri)] if uri else []
        made.append((own + [("WARC-Block-Digest", digest(b)), ("Content-Type", form)], b))
    return made


def _object(headers: Pairs) -> dict[str, str | list[str]]:
    out: dict[str, list[str]] = {}
    case: dict[str, str] = {}
    for k, v in headers:
        out.setdefault(case.setdefault(k.lower(), k), []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


_SCHEMA = "kind string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_digest string, content_length bigint, block string"


def _rows(headers: Pairs, block: bytes) -> Iterator[tuple]:
    for own, b in derive(headers, block):
        h = dict(own)
        yield (h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h["WARC-Date"], h["Content-Type"], h["WARC-Block-Digest"], header(headers, "WARC-Payload-Digest"), len(b), b.decode())


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Two rows a page, ``metadata`` and ``conversion``, with their headers and block.  Ids pass through untouched."""

    def work(keys: list, urls: list, htmls: list) -> tuple[list[int], list]:
        rows = [(i, *r) for i, page in enumerate(zip(keys, urls, htmls)) for r in _rows(*response(*page))]
        at, *columns = zip(*rows)
        return list(at), columns

    # the id as text names the records; the id itself is only passed on
    inputs = [F.col(c).cast("string") for c in (id_col, url_col, html_col)]
    return map_texts(pages, [F.col(id_col).alias("k")], inputs, _SCHEMA, lambda: work, many=True).withColumnRenamed("k", id_col)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path``, plain or gzipped: file, place, kind, headers (JSON pairs), block.

    Only the files' names are listed by Spark; each task opens its files by itself and reads one record at a time, through
    Arrow's file systems, so that a file of any size takes the memory of its largest record."""
    files = spark.read.format("binaryFile").load(path).select("path").repartition("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with _opened(name) as f:
                    for i, (h, block) in enumerate(parse(f)):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (i, pa.int32()), (header(h.pairs, "WARC-Type"), pa.string()), (json.dumps(h.pairs), pa.string()), (block, pa.binary()))], names=["file", "place", "kind", "headers", "block"])

    return files.mapInArrow(run, "file string, place int, kind string, headers string, block binary")


def _opened(name: str) -> io.BufferedReader:
    """A file, by its path or URI, as a stream."""
    if name.startswith("file:"):
        return open(unquote(urlparse(name).path), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(name)
    return io.BufferedReader(system.open_input_stream(at, compression=None))


def derive_files(records: DataFrame) -> DataFrame:
    """Derivatives of the response records of ``read``: file, place, and the columns of ``derivatives``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, p, *r) for f, p, h, block in zip(b["file"], b["place"], b["headers"], b["block"]) for r in _rows([tuple(x) for x in json.loads(h)], bytes(block))]
            yield pd.DataFrame(rows, columns=["file", "place", *_NAMES])

    return records.where("kind = 'response'").mapInPandas(run, f"file string, place int, {_SCHEMA}")


def gzip_member(record: bytes) -> bytes:
    """A record as a gzip member of its own, as WARC files are compressed; the same bytes on each run."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_bytes(records: Iterable[tuple[Pairs, bytes]], compress: bool = True) -> bytes:
    return b"".join(gzip_member(to_bytes(h, b)) if compress else to_bytes(h, b) for h, b in records)
