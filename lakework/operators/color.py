"""Colour ramps and maps as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakework.operators.quantiles import classify

Color = tuple[int, int, int]


def color_ramp(colors: Sequence[Color], stops: int) -> list[Color]:
    """Spread a few colours over ``stops`` steps by linear interpolation."""
    if stops < 1 or not colors:
        raise ValueError("a ramp needs colours and at least one stop")
    if stops == 1 or len(colors) == 1:
        return [tuple(colors[0])] * stops
    out = []
    for i in range(stops):
        place = i * (len(colors) - 1) / (stops - 1)
        left = min(int(place), len(colors) - 2)
        share = place - left
        out.append(tuple(int(a + (b - a) * share + 0.5) for a, b in zip(colors[left], colors[left + 1])))
    return out


def apply_color_map(df: DataFrame, col: str, breaks: Sequence[float], colors: Sequence[Color]) -> DataFrame:
    """Add ``red, green, blue`` of the class of each value; NoData has no colour.

    A value takes the colour at the number of breaks strictly below it. The ramp is a
    literal in the plan, so nothing is joined.
    """
    if len(colors) != len(breaks) + 1:
        raise ValueError("a colour map needs one colour more than breaks")
    index = classify(col, breaks) if breaks else F.when(F.col(col).isNotNull(), F.lit(0))
    out = df.withColumn("_class", index)
    channels = {
        name: F.get(F.array(*[F.lit(c[i]) for c in colors]), F.col("_class"))
        for i, name in enumerate(("red", "green", "blue"))
    }
    return out.withColumns(channels).drop("_class")
