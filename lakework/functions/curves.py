"""Space-filling keys of any number of dimensions, and the few key ranges that cover a box."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def interleave(values: Sequence[Column], bits: int) -> Column:
    """The lowest ``bits`` bits of the values in turn, the first value's lowest."""
    if len(values) * bits > 63:
        raise ValueError("the key does not fit a long")

    def spread(value: Column, shift: int) -> Column:
        value = value.cast("long")
        return reduce(add, [F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1)), len(values) * i + shift) for i in range(bits)])

    return reduce(add, [spread(v, k) for k, v in enumerate(values)])


def place(value: Column, low: float, high: float, bits: int) -> Column:
    """The cell of a value among 2^``bits`` between two bounds; what lies outside counts as the edge."""
    cells = 1 << bits
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((value - low) / (high - low) * cells))).cast("long")


def place_of(value: float, low: float, high: float, bits: int) -> int:
    """:func:`place` of one number, by the same arithmetic."""
    cells = 1 << bits
    return int(max(0, min(cells - 1, (value - low) / (high - low) * cells // 1)))


def curve_ranges(low: Sequence[int], high: Sequence[int], bits: int, max_ranges: int = 32) -> list[tuple[int, int]]:
    """Key ranges, both ends included, that cover the box from ``low`` to ``high``, both corners included.

    Cells of the curve that reach over the box are split, those with most outside it first, until
    there are ``max_ranges`` pieces; then the narrowest gaps are closed. The ranges cover every key
    of the box, and keys outside it only where the number of ranges asks for it.
    """
    dims = len(low)
    if any(a > b for a, b in zip(low, high)):
        return []
    if any(a < 0 or b >= 1 << bits for a, b in zip(low, high)):
        raise ValueError("the box leaves the curve")
    done: list[tuple[int, int]] = []
    # (minus the keys outside the box, prefix, corner, free bits) of cells that reach over the box
    split: list[tuple[int, int, tuple[int, ...], int]] = []

    def offer(prefix: int, corner: tuple[int, ...], free: int) -> None:
        inside = 1
        for a, b, c in zip(low, high, corner):
            inside *= max(0, min(b, c + (1 << free) - 1) - max(a, c) + 1)
        outside = (1 << (dims * free)) - inside
        if not inside:
            return
        if outside:
            heapq.heappush(split, (-outside, prefix, corner, free))
        else:
            done.append((prefix << (dims * free), ((prefix + 1) << (dims * free)) - 1))

    offer(0, (0,) * dims, bits)
    # Neighbouring pieces join, so more of them may be looked at than ranges are wanted.
    while split and len(split) + len(done) < 4 * max_ranges:
        _, prefix, corner, free = heapq.heappop(split)
        for child in range(1 << dims):
            offer((prefix << dims) + child, tuple(c + ((child >> k & 1) << (free - 1)) for k, c in enumerate(corner)), free - 1)
    pieces = done + [(p << (dims * free), ((p + 1) << (dims * free)) - 1) for _, p, _, free in split]
    merged: list[list[int]] = []
    for first, last in sorted(pieces):
        if merged and first == merged[-1][1] + 1:
            merged[-1][1] = last
        else:
            merged.append([first, last])
    gaps = sorted(range(1, len(merged)), key=lambda i: merged[i][0] - merged[i - 1][1])
    closed = set(gaps[: max(0, len(merged) - max_ranges)])
    ranges: list[tuple[int, int]] = []
    for i, (first, last) in enumerate(merged):
        if i in closed:
            ranges[-1] = (ranges[-1][0], last)
        else:
            ranges.append((first, last))
    return ranges


def in_ranges(key: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """The key lies in one of the ranges, as comparisons that reach the scan."""
    return reduce(or_, [key.between(a, b) for a, b in ranges], F.lit(False)) if ranges else F.lit(False)
