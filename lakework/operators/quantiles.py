"""Exact quantiles and histograms that never gather a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cut points of one round: for one range, and over all ranges together. Few rows are told one by one.
_CUTS = 1024
_ALL_CUTS = 65536
_FEW = 131072


def min_max(df: DataFrame, col: str) -> DataFrame:
    """Smallest and largest value, as one row."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def cell_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Exact equal-width histogram: ``bin, n`` for the bins that hold values."""
    bounds = min_max(df.where(F.col(col).isNotNull()), col).first()
    if bounds["min"] is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    low, width = float(bounds["min"]), (float(bounds["max"]) - float(bounds["min"])) / bins
    index = F.least(F.greatest(F.floor((F.col(col) - F.lit(low)) / width), F.lit(0)), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    return df.where(F.col(col).isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, col: str, probabilities: Sequence[float]) -> list[float]:
    """Interpolated quantiles of a numeric column; NULL and NaN do not count.

    Every round brackets the ranks by rank: an approximate quantile sketch of the rows that
    are still in question gives cut points, and one pass counts exactly how many rows lie at
    and between them. A round leaves about a thousandth of the rows, whatever their values,
    and the last few are counted one by one. The driver sees cut points and counts only, so
    neither the size nor the skew of the column matters.
    """
    if not probabilities:
        return []
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    total = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not total.n:
        raise ValueError(f"no data in column {col!r}")
    if math.isinf(total.lo) or math.isinf(total.hi):
        raise ValueError(f"infinite values in column {col!r}")
    positions = [p * (total.n - 1) for p in probabilities]
    ranks = sorted({r for p in positions for r in (math.floor(p), math.ceil(p))})
    found = {r: v for r, v in ((0, float(total.lo)), (total.n - 1, float(total.hi))) if r in ranks}
    # Open ranges between two values: (low, high, rows up to low, rows inside, ranks inside).
    left = [r for r in ranks if r not in found]
    open_ranges = [(-math.inf, math.inf, 0, total.n, left)] if left else []
    while open_ranges:
        if sum(r[3] for r in open_ranges) <= _FEW:
            _tell(values, open_ranges, found)
            break
        open_ranges = _narrow(values, open_ranges, _cut_points(values, open_ranges), found)
    out = []
    for p in positions:
        a, b = found[math.floor(p)], found[math.ceil(p)]
        share = p - math.floor(p)
        out.append(a + (b - a) * share if math.isfinite(b - a) else a * (1 - share) + b * share)
    return out


_Range = tuple[float, float, int, int, list[int]]


def _place(cuts: Sequence[float]) -> Column:
    """2i for a value between cut i - 1 and cut i, 2i + 1 for one at cut i, by binary search."""
    edges = np.asarray(cuts)

    def place(v: pa.Array) -> pa.Array:
        numbers = v.to_numpy(zero_copy_only=False)
        at = np.searchsorted(edges, numbers)
        same = edges[np.minimum(at, len(edges) - 1)] == numbers
        return pa.array(2 * at + same, pa.int32())

    place.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "int")(F.col("v"))


def _inside(values: DataFrame, ranges: list[_Range]) -> DataFrame:
    """The values in the open ranges, with the number of their range."""
    if ranges[0][:2] == (-math.inf, math.inf):
        return values.select("v", F.lit(0).alias("i"))
    edges = sorted({e for low, high, *_ in ranges for e in (low, high)})
    numbers = F.create_map(*[F.lit(x) for i, r in enumerate(ranges) for x in (2 * edges.index(r[1]), i)])
    return values.select("v", F.try_element_at(numbers, _place(edges)).alias("i")).where("i IS NOT NULL")


def _cut_points(values: DataFrame, ranges: list[_Range]) -> list[float]:
    """About a thousand values that part the rows of the ranges evenly; they need not be exact."""
    n = max(16, min(_CUTS, _ALL_CUTS // len(ranges)))
    grid = F.array(*[F.lit(k / n) for k in range(n + 1)])
    sketches = _inside(values, ranges).groupBy("i").agg(F.percentile_approx("v", grid, 4 * n).alias("cuts"))
    return sorted({float(c) for r in sketches.collect() for c in r.cuts})  # at most _ALL_CUTS numbers


def _tell(values: DataFrame, ranges: list[_Range], found: dict[int, float]) -> None:
    """Find the ranks of ranges that hold few rows together, by counting each value."""
    rows = sorted(tuple(r) for r in _inside(values, ranges).groupBy("i", "v").count().collect())  # at most _FEW rows
    for i, (_, _, below, _, inside) in enumerate(ranges):
        left = sorted(inside)
        for _, v, n in (r for r in rows if r[0] == i):
            below += n
            while left and left[0] < below:
                found[left.pop(0)] = v


def _narrow(values: DataFrame, ranges: list[_Range], cuts: list[float], found: dict[int, float]) -> list[_Range]:
    """Count the rows at and between the cuts; ranks at a cut are found, the others get narrower ranges."""
    counts = dict(values.select(_place(cuts).alias("b")).groupBy("b").count().collect())  # two rows per cut
    ranks = sorted(r for *_, inside in ranges for r in inside)
    out: list[_Range] = []
    below, k = 0, 0
    for b in range(2 * len(cuts) + 1):
        n, own = counts.get(b, 0), []
        while k < len(ranks) and ranks[k] < below + n:
            own.append(ranks[k])
            k += 1
        if own and b % 2:
            found.update(dict.fromkeys(own, cuts[b // 2]))
        elif own:
            out.append((cuts[b // 2 - 1] if b else -math.inf, cuts[b // 2] if b // 2 < len(cuts) else math.inf, below, n, own))
        below += n
    return out


def quantile_breaks(df: DataFrame, col: str, n: int) -> list[float]:
    """The n - 1 inner breaks that cut a column into n classes of equal size."""
    return exact_quantiles(df, col, [i / n for i in range(1, n)])


def classify(value: Column | str, breaks: Sequence[float]) -> Column:
    """Class index of a value: the number of breaks strictly below it."""
    v = F.col(value) if isinstance(value, str) else value
    over = [(v > F.lit(float(b))).cast("int") for b in breaks]
    if not over:
        return F.when(v.isNotNull(), F.lit(0))
    # Add in pairs: the depth of the expression grows with the logarithm of the breaks.
    while len(over) > 1:
        over = [over[i] + over[i + 1] if i + 1 < len(over) else over[i] for i in range(0, len(over), 2)]
    return over[0]


def quantile_classify(df: DataFrame, col: str, n: int, alias: str = "class") -> DataFrame:
    """Add the quantile class 0..n-1 of each value; NULL stays NULL."""
    return df.withColumn(alias, classify(col, quantile_breaks(df, col, n)))


# -- mergeable sketches ---------------------------------------------------------------


def quantile_sketches(df: DataFrame, col: str, keys: Sequence[str] = (), k: int = 800) -> DataFrame:
    """One KLL sketch of a column for every group, ``sketch``; NULL and NaN do not count.

    A sketch has a few kilobytes whatever it has seen, is built map-side, can be stored and merged
    with others, and gives quantiles within a rank error of about 2 / ``k``; where ranks have to be
    exact, :func:`exact_quantiles` reads the values again.
    """
    value = F.col(col).cast("double")
    counted = df.withColumn(col, F.when(~F.isnan(value), value))
    return counted.groupBy(*keys).agg(F.kll_sketch_agg_double(col, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = (), k: int = 800) -> DataFrame:
    """Sketches of smaller groups as those of larger ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(probabilities: Sequence[float], sketch: str = "sketch") -> Column:
    """The quantiles that a sketch gives, as an array; NULL for one that has seen nothing."""
    seen = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(seen, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in probabilities])))
