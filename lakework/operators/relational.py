"""Relational helpers that the jobs share."""

from __future__ import annotations

import base64 as b64
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by position and keep duplicates."""
    return reduce(DataFrame.union, dfs)


def count_by(df: DataFrame, col: str, alias: str) -> DataFrame:
    """Rows per value of ``col``, with the key renamed."""
    return df.groupBy(F.col(col).alias(alias)).count()


def count_groups(df: DataFrame, expr: Column | str) -> DataFrame:
    """Number of distinct values, as one row."""
    key = F.expr(expr) if isinstance(expr, str) else expr
    return df.agg(F.count_distinct(key).alias("n_groups"))


def cast_kv(df: DataFrame) -> DataFrame:
    """Binary key and value columns as text."""
    return df.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})


def layer_stack(layers: Sequence[DataFrame], key: str = "spatial_key") -> DataFrame:
    """Fold layers of one grid into one frame, bands side by side."""
    return reduce(lambda left, right: left.join(right, on=key), layers)


def records_to_json(df: DataFrame, alias: str = "value") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias(alias))


_PART = re.compile(
    r"""'(?:\\.|[^'\\])*'?|"(?:\\.|[^"\\])*"?|`[^`]*`?|(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|.""", re.S
)
_CLOSED = frozenset("IF WHILE LOOP REPEAT FOR CASE".split())  # END may name what it closes


class _Blocks:
    """Counts the open blocks of a script, word by word."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.starts, self.ended, self.labelled = True, False, False  # at a statement's start, behind END, behind its first word

    def take(self, part: str, word: str) -> None:
        starts, ended, inside = self.starts, self.ended, self.open[-1] if self.open else ""
        self.starts = self.ended = False
        if word == "BEGIN" and (starts or self.open):
            self.open.append(word)
            self.starts = True
        elif part == ":" and self.labelled:
            self.starts = True
        elif not self.open:
            pass
        elif word == "END":
            self.open.pop()
            self.ended = True
        elif ended and word in _CLOSED:
            pass
        elif word == "CASE":
            self.open.append("CASE" if starts else "value")  # a statement, or the expression
        elif starts and word in _CLOSED:
            self.open.append(word)
            self.starts = word in ("LOOP", "REPEAT")
        elif word in ("THEN", "ELSE") and inside != "value" or word == "DO":
            self.starts = True
        self.labelled = starts and bool(word)


def split_statements(script: str) -> Iterator[str]:
    """Cut a SQL script at the semicolons outside quotes, comments and BEGIN ... END blocks."""
    start, blocks = 0, _Blocks()
    for m in _PART.finditer(script):
        if m["space"] is not None:
            continue
        if m[0] != ";":
            blocks.take(m[0], (m["word"] or "").upper())
        elif blocks.open:
            blocks.starts = True
        else:
            yield from _nonempty(script[start : m.start()])
            start, blocks = m.end(), _Blocks()
    yield from _nonempty(script[start:])


def _nonempty(statement: str) -> Iterator[str]:
    lines = [line for line in statement.splitlines() if line.strip() and not line.strip().startswith("--")]
    if lines:
        yield statement.strip()


def run_statements(
    spark: SparkSession,
    statements: Iterable[str] | None = None,
    path: str | None = None,
    base64: bool = False,
) -> DataFrame:
    """Run SQL statements in order and give the last result.

    The statements come as texts, each holding one or more statements, or as a
    script file on any file system that Spark reads. ``base64`` decodes texts first. A compound
    block, with its variables, loops, branches and handlers, is one statement to Spark.
    """
    if (statements is None) == (path is None):
        raise ValueError("give either statements or a path")
    if path is not None:
        # A script is one small file by nature; it is program text, not data.
        texts = [row.value for row in spark.read.text(path, wholetext=True).collect()]
    else:
        texts = list(statements)
    if base64:
        texts = [b64.b64decode(text).decode("utf-8") for text in texts]
    result = None
    for text in texts:
        for statement in split_statements(text):
            result = spark.sql(statement)
    if result is None:
        raise ValueError("no statement to run")
    return result
