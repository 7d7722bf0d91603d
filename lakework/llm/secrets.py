"""Secret scan: Aho-Corasick keywords first, anchored expressions near their hits, embedded checksums last.

One automaton walks the text and reports where a keyword of any rule ends; the rule's expression
is then tried at that place only. Tokens that carry a CRC-32 of their own body (letters and digits
of base 62) are reported when the checksum holds. Runs of hexadecimal digits have no keyword and
are found by one expression.

Kinds, in this order: ``assign``, ``access``, ``hex`` (the base) and ``checked`` (what the
checksums add). Spans are code points, the end exclusive. Per kind, matches are taken from the
left and do not overlap; one that fails its further test is dropped and nothing is tried again
inside it.

Defined cases: a null text is scanned as the empty text and has no spans. Repeated rows are
scanned row by row. An empty table gives an empty result. Further columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.llm.common import free_name, table

KINDS = ("assign", "access", "hex", "checked")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(
    "(?:" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Prefixes of tokens whose last six characters are the CRC-32 of the thirty before them.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` in six digits of base 62."""
    n, digits = zlib.crc32(body.encode()), []
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(_BASE62[d])
    return "".join(reversed(digits))


def automaton() -> ahocorasick.Automaton:
    """Lower-cased keywords to (rule, length)."""
    found = ahocorasick.Automaton()
    for word in KEYWORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word in CHECKED_PREFIXES:
        found.add_word(word, ("checked", len(word)))
    found.make_automaton()
    return found


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


_CHECKS = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 6),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 20),
    "checked": (CHECKED, lambda m: base62_crc(m[1]) == m[2]),
}


def find_secrets(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then by kind."""
    if not text:
        return []
    spans, free = [], {"assign": 0, "access": 0, "checked": 0}
    for last, (kind, length) in keywords.iter(_lowered(text)):
        start = last + 1 - length
        if start < free[kind]:
            continue
        expression, holds = _CHECKS[kind]
        match = expression.match(text, start)
        if match:
            free[kind] = match.end()
            if holds(match):
                spans.append((kind, start, match.end()))
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, column: str = "secrets") -> DataFrame:
    """All columns of ``docs`` and the spans found in ``text`` as an array of (kind, start, end)."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != column))
    schema = docs.select("*", F.lit(None).cast(SPANS).alias(column)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            found = []
            for text in batch.column(batch.schema.get_field_index("text")):
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(text.as_py(), keywords)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def keep_without_secrets(docs: DataFrame) -> DataFrame:
    """The documents in which the scan finds nothing, with their own columns."""
    column = free_name(docs, "_secrets")
    return scan_secrets(docs, column).where(F.size(column) == 0).drop(column)


def span_text(column: str, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans in their order, comma-joined."""
    spans = F.col(column)
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(column: str, kind: str):
    return F.size(F.filter(F.col(column), lambda s: s["kind"] == kind)).cast("long")


def digest_of_spans(spans: list[tuple[str, int, int]]) -> str:
    """What ``base_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), "found").drop("text")
    return found.select(
        "doc_id",
        count_of("found", "assign").alias("n_assign"),
        count_of("found", "access").alias("n_access"),
        count_of("found", "hex").alias("n_hex"),
        F.sha2(span_text("found", ("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        span_text("found").alias("spans"),
    )
