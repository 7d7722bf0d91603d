"""URL filter: all glob rules run at once as one bit-parallel Shift-And automaton.

Every rule takes a stretch of bits in a row of 64-bit words, one bit per pattern position. Reading
a byte of the canonical URL shifts all rules by one and masks them with the byte's row; stars are
bits that may keep themselves. A batch of URLs is a matrix of such rows, so that one numpy step
moves every rule of every URL by one byte.

Globs are read as bytes of UTF-8: ``*`` is any run without ``/``, ``**`` any run, ``?`` one byte
but ``/``, everything else itself. They match a whole canonical URL, which is ``.host`` (A-Z
lower-cased) and path: the host stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
end, the path reaches from there to ``?``, ``#`` or the end.

Host rules (``example.org/es/``) fit their host and its subdomains where the path starts with
theirs; the longest one decides, the earlier one where two are as long. Where none fits, the
general globs decide: a URL that fits one of them is blocked, any other allowed.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule fits and it
is allowed unless a general glob fits the lone dot. Repeated rows are judged row by row, an empty
table gives an empty result, further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.llm.common import table, text_bytes

HOST_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
GENERAL_GLOBS = (
    "*.casino*/**", "*casino-*/**", "*.free-*/**", "*.cheap-*/**", "*.ads.*/**", "*.track*.*/**",
    "**/ads/**", "**/banner*", "**/track/**", "**.exe", "**/login/**", "*-pills.*/**", "*-bets.*/**", "*-win.*/**",
)
_SLASH = ord("/")


class GlobAutomaton:
    """Shift-And masks of many globs; ``matches`` runs them over canonical URLs."""

    def __init__(self, globs: Sequence[str]) -> None:
        positions: list[tuple[int | None, bool]] = []  # the byte (None: any but a slash), a bit of its own
        starts, ends, stays = [], [], []  # per glob; stays: (bit after which a star keeps, crosses slashes)
        for glob in globs:
            data, i = glob.encode(), 0
            starts.append(len(positions))
            positions.append((None, True))  # the entry bit, set before the first byte only
            while i < len(data):
                if data[i : i + 2] == b"**":
                    stays.append((len(positions) - 1, True))
                    i += 2
                elif data[i : i + 1] == b"*":
                    stays.append((len(positions) - 1, False))
                    i += 1
                else:
                    positions.append((None if data[i : i + 1] == b"?" else data[i], False))
                    i += 1
            ends.append(len(positions) - 1)
        self.words = max(1, (len(positions) + 63) // 64)
        self.step = np.zeros((256, self.words), np.uint64)  # bits that a byte may set
        self.keep = np.zeros((256, self.words), np.uint64)  # bits that a byte leaves set
        self.entry = np.zeros(self.words, np.uint64)
        for bit, (byte, entry) in enumerate(positions):
            word, flag = bit // 64, np.uint64(1 << (bit % 64))
            if entry:
                self.entry[word] |= flag
            elif byte is None:
                self.step[:, word] |= flag
                self.step[_SLASH, word] &= ~flag
            else:
                self.step[byte, word] |= flag
        for bit, crosses in stays:
            word, flag = bit // 64, np.uint64(1 << (bit % 64))
            self.keep[:, word] |= flag
            if not crosses and not (bit, True) in stays:
                self.keep[_SLASH, word] &= ~flag
        self.ends = np.asarray(ends, np.int64)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row per text and a column per glob: whether the glob fits the whole text."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.entry, (n, 1))
        longest = int(lengths.max(initial=0))
        alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # texts longer than i
        one, top = np.uint64(1), np.uint64(63)
        for i in range(longest):
            rows = order[: alive[i]]
            now = state[rows]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            byte = data[offsets[rows] + i]
            state[rows] = (moved & self.step[byte]) | (now & self.keep[byte])
        flags = np.uint64(1) << (self.ends % 64).astype(np.uint64)
        return (state[:, self.ends // 64] & flags) != 0


def host_glob(rule: str) -> str:
    """The glob of a host rule over ``.host/path``: any subdomain, any rest of the path."""
    return f"*.{rule}**"


def _split(url):
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str]] = HOST_RULES,
    globs: Sequence[str] = GENERAL_GLOBS,
    url: str = "url",
) -> DataFrame:
    """All columns of ``pages``, then host, path, rule and verdict (replaced where they are there)."""
    made = ("host", "path", "rule", "verdict")
    host, path = _split(F.col(f"`{url}`"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    parted = pages.select(*kept, host.alias("host"), path.alias("path"))
    schema = parted.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).schema
    automaton = GlobAutomaton([*(host_glob(r) for _, r in host_rules), *globs])
    # The longest rule comes first; a sentinel column stands for none.
    ranked = sorted(range(len(host_rules)), key=lambda i: (-len(host_rules[i][1]), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = ["." + (h or "") + (p or "") for h, p in zip(named["host"].to_pylist(), named["path"].to_pylist())]
            fits = automaton.matches(*text_bytes(pa.array(keys, pa.large_string())))
            by_rule = fits[:, ranked]
            some = by_rule.any(axis=1)
            first = by_rule.argmax(axis=1) if ranked else np.zeros(len(keys), np.int64)
            listed = fits[:, len(host_rules) :].any(axis=1)
            rule = [host_rules[ranked[k]] if s else None for k, s in zip(first, some)]
            verdict = [r[0] if r else ("block" if b else "allow") for r, b in zip(rule, listed)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r and r[1] for r in rule], pa.string()), pa.array(verdict, pa.string())],
                [*batch.schema.names, "rule", "verdict"],
            )

    return parted.mapInArrow(run, schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _like(glob: str) -> str:
    """The glob as an anchored regular expression, for the oracle."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/-" else "[" + c + "]"
        i += 1
    return f"^{out}$"


def _oracle() -> str:
    ranked = sorted(HOST_RULES, key=lambda r: -len(r[1]))
    fit = {r: f"regexp_full_match(k, '{_like(host_glob(r))[1:-1]}', 's')" for _, r in ranked}
    rule = " ".join(f"WHEN {fit[r]} THEN '{r}'" for _, r in ranked)
    judged = " ".join(f"WHEN {fit[r]} THEN '{v}'" for v, r in ranked)
    listed = " OR ".join(f"regexp_full_match(k, '{_like(g)[1:-1]}', 's')" for g in GENERAL_GLOBS)
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parted AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{capital}', '{small}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), keyed AS (SELECT *, '.' || host || path AS k FROM parted)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {judged} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM keyed
"""


SQL = _oracle()
