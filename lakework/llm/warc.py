"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both new records name the response they come from (``WARC-Refers-To``), keep its target and date,
carry the digest of their own block, and repeat the response's payload digest. The metadata block
is JSON with the response's own headers, its HTTP headers, title, meta tags and links; the
conversion block is the text of the page. Ids are derived from the response's id and the kind, so
that a second run gives the same records.

Defined cases: a null payload is an empty one (no text, no links). A null target leaves its header
out; a null date is replaced by a fixed one (``DATE``), as the format demands a date. Control
characters in header values become spaces; headers whose name repeats are all listed. Work grows
in proportion to the page, also for tags, comments and titles that are never closed. Rows that repeat give records that repeat, with equal ids. An empty table gives
an empty result. Further columns of the responses are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.llm.common import table

# A quote opens a value right after "=" only, as in HTML; elsewhere it is a part of a name or of a value.
_S = r"[ \t\n\r\f]"
_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f>\"'][^ \t\n\r\f>]*+"
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_ATTRIBUTES = rf"(?:[ \t\n\r\f/]++|{_NAME}(?:{_S}*+={_S}*+(?:{_VALUE})?+)?+)*+"
_TAG = re.compile(rf"<(?:(/?)([a-zA-Z][^\s>/]*+)({_ATTRIBUTES})|[!?][a-zA-Z!?\[-]?+[^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_S}*+={_S}*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*+))?+)?+")
# A comment may close at once; an end tag may hold spaces and more. What is not closed reaches to the end.
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
_END = r"(?=[\s/>])[^>]*+(?:>|\Z)"
# Comments, and elements without text, with the start tags of scripts and styles in a group.
_SKIP = re.compile(rf"{_COMMENT}|<(script|style|noscript|template|svg)(?=[\s/>]){_ATTRIBUTES}(?:>|\Z).*?(?:</\1{_END}|\Z)", re.S | re.I)
_BODY = re.compile(rf"{_COMMENT}|(<(script|style)(?=[\s/>]){_ATTRIBUTES}(?:>|\Z)).*?(?:</\2{_END}|\Z)", re.S | re.I)
_TITLE = re.compile(rf"<title(?=[\s/>]){_ATTRIBUTES}(?:>|\Z)(.*?)(?:</title{_END}|\Z)", re.S | re.I)
_BLOCK = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "source": "src"}
_ORIGIN = re.compile(r"https?://[A-Za-z0-9.:@_-]+(?=[/?#]|\Z)")
_PLAIN_PATH = re.compile(r"/(?:[A-Za-z0-9_,~%-][A-Za-z0-9_,~%.-]*/?)*")
_BREAKS = re.compile(r"[\x00-\x1f\x7f]+")
DATE = "2024-01-01T00:00:00Z"


def sha1_digest(data: bytes) -> str:
    """``sha1:`` and the digest in base 32, as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def without_scripts(page: str) -> str:
    """The page without comments, scripts, styles and the like."""
    return _SKIP.sub(" ", page)


def without_bodies(page: str) -> str:
    """The page without comments and what scripts and styles hold; their start tags stay."""
    return _BODY.sub(lambda m: m[1] or " ", page)


def plain_text(page: str) -> str:
    """Text of a page that holds no scripts: block elements break lines; entities resolved."""
    parts = _TAG.split(page)  # a text, then slash, name and attributes of a tag and the text behind it
    pieces = [parts[0]]
    for name, text in zip(parts[2::4], parts[4::4]):
        if name and name.lower() in _BLOCK:
            pieces.append("\n")
        pieces.append(text)
    lines = (" ".join(line.split()) for line in html.unescape("".join(pieces)).split("\n"))
    return "\n".join(line for line in lines if line)


def _resolver(target: str | None):
    """A function that resolves links against a target; plain paths take a short way to the same result."""
    origin = _ORIGIN.match(target or "")

    def resolve(link: str) -> str:
        if origin and _PLAIN_PATH.fullmatch(link):
            return origin[0] + link
        try:
            return urljoin(target or "", link)
        except ValueError:
            return link

    return resolve


def page_metadata(page: str, target: str | None, tags: str | None = None) -> dict:
    """Title, meta tags and links of a page that holds no scripts; relative links are resolved against the target where that is possible.

    ``tags`` is the page that meta tags and links are taken from, if another: one that has the start tags of its scripts.
    """
    title = _TITLE.search(page)
    found: dict = {"Title": " ".join(html.unescape(title[1]).split()) if title else None, "Metas": [], "Links": []}
    parts, resolve = _TAG.split(page if tags is None else tags), _resolver(target)
    for slash, name, attributes in zip(parts[1::4], parts[2::4], parts[3::4]):
        if slash or not name:
            continue
        name = name.lower()
        if name not in _LINKS and name != "meta":
            continue
        given = ((a[1].lower(), next((v for v in a.groups()[1:] if v is not None), None)) for a in _ATTRIBUTE.finditer(attributes))
        pairs: dict[str, str] = {}
        for k, v in given:
            if v is not None:
                pairs.setdefault(k, html.unescape(v))  # of repeated attributes the first counts
        if name == "meta":
            found["Metas"].append(pairs)
        elif (link := pairs.get(_LINKS[name])) is not None:
            found["Links"].append({"path": f"{name.upper()}@/{_LINKS[name]}", "url": resolve(link)})
    return found


def _header_value(value: str) -> str:
    """A value as it may stand in a header: no line breaks or other control characters."""
    return _BREAKS.sub(" ", value)


def _listed(headers) -> dict[str, str | list[str]]:
    """Headers by name; those of a name that repeats as a list, in their order."""
    found: dict[str, list[str]] = {}
    for pair in headers or []:
        name, value = (pair["name"], pair["value"]) if isinstance(pair, dict) else pair
        found.setdefault(name, []).append(value)
    return {k: v if len(v) > 1 else v[0] for k, v in found.items()}


def _record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


def derive(source: dict, date: str = DATE) -> list[dict]:
    """The metadata and the conversion record of one response; ``date`` stands where it has none."""
    payload = source["payload"] or ""
    data = payload.encode("utf-8", "surrogatepass")
    digest = sha1_digest(data)
    page = without_scripts(payload)
    kept = {"WARC-Target-URI": source["target_uri"], "WARC-Date": date if source["date"] is None else source["date"]}
    kept = {k: _header_value(v) for k, v in kept.items() if v is not None}
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": source["record_id"], **kept, "WARC-Payload-Digest": digest},
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Headers": _listed(source["http_headers"]), "HTML-Metadata": page_metadata(page, source["target_uri"], page if page == payload else without_bodies(payload)),
                    "Entity-Length": len(data), "Entity-Digest": digest,
                }
            },
        }
    }
    blocks = (
        ("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True)),
        ("conversion", "text/plain", plain_text(page)),
    )
    out = []
    for kind, content_type, block in blocks:
        body = block.encode("utf-8", "surrogatepass")
        headers = {
            "WARC-Type": kind, "WARC-Record-ID": _record_id(source["record_id"] or "", kind), **kept,
            "WARC-Refers-To": None if source["record_id"] is None else _header_value(source["record_id"]), "WARC-Refers-To-Payload-Digest": digest,
            "WARC-Block-Digest": sha1_digest(body), "Content-Type": content_type, "Content-Length": str(len(body)),
        }
        headers = {k: v for k, v in headers.items() if v is not None}
        out.append(
            {
                "warc_type": kind, "record_id": headers["WARC-Record-ID"], "refers_to": source["record_id"], "target_uri": source["target_uri"],
                "payload_digest": digest, "block_digest": headers["WARC-Block-Digest"], "content_length": len(body),
                "headers": list(headers.items()), "block": body.decode("utf-8", "replace"),
            }
        )
    return out


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as it stands in a WARC file; line breaks in a value become spaces."""
    head = "".join(f"{k}: {_header_value(v)}\r\n" for k, v in headers)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


_OUT = (
    ("warc_type", "string", pa.string()), ("record_id", "string", pa.string()), ("refers_to", "string", pa.string()),
    ("target_uri", "string", pa.string()), ("payload_digest", "string", pa.string()), ("block_digest", "string", pa.string()),
    ("content_length", "long", pa.int64()), ("headers", "map<string,string>", pa.map_(pa.string(), pa.string())), ("block", "string", pa.string()),
)


def derive_records(responses: DataFrame, key: str, date: str = DATE) -> DataFrame:
    """Two records per response, with ``key`` beside them.

    ``responses`` has record_id, target_uri, date (text), payload (text) and http_headers, a map or,
    where names repeat, an array of (name, value). Every record has a date: ``date`` stands where a
    response has none.
    """
    schema = responses.select(F.col(f"`{key}`"), *(F.lit(None).cast(kind).alias(name) for name, kind, _ in _OUT)).schema
    needed = ["record_id", "target_uri", "date", "http_headers", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                columns = [part.column(part.schema.get_field_index(n)).to_pylist() for n in needed]
                rows = [r for values in zip(*columns) for r in derive(dict(zip(needed, values)), date)]
                keys = part.column(part.schema.get_field_index(key)).take(pa.array([i for i in range(part.num_rows) for _ in range(2)], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[n] for r in rows], kind) for n, _, kind in _OUT)], [key, *(n for n, _, _ in _OUT)])

    return responses.select(F.col(f"`{key}`"), *needed).mapInArrow(run, schema)


def page_responses(pages: DataFrame, date: str | None = None) -> DataFrame:
    """Pages as response records; the id is derived from page id, url and content. Pages carry no date; without ``date`` the records get :data:`DATE`."""
    parts = F.sha2(
        F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).cast("binary"), 256
    )
    dashed = F.concat_ws("-", *(F.substring(parts, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(date).cast("string").alias("date"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=UTF-8")).alias("http_headers"), F.col("html").alias("payload"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive_records(page_responses(table(spark, sf_dir, "pages")), "page_id")
    return records.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", "headers", "block")
