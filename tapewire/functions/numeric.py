"""Numeric column helpers shared by scores, indicators and metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL (``greatest`` alone would drop it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(c) | (c == inf) | (c == -inf), None).otherwise(c)


def sanitize(df: DataFrame, fill: Mapping[str, float]) -> DataFrame:
    """Non-finite numbers become NULL, then each named column gets its own fill value."""
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(v)) for c, v in fill.items()})


def to_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what does not parse becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def ladder(c: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step whose floor is ``<= c``; steps run from high to low."""
    out = None
    for floor, value in steps:
        out = F.when(c >= floor, F.lit(value)) if out is None else out.when(c >= floor, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def interval(c: Column, edges: Sequence[float], labels: Sequence[str], open_end: bool = False) -> Column:
    """Right-closed bins; the lowest edge belongs to the first bin.

    With ``open_end`` the last bin has no upper edge.  Values outside are NULL.
    """
    out = F.when(c < edges[0], F.lit(None).cast("string"))
    for i, label in enumerate(labels):
        last = i == len(labels) - 1
        out = out.when(F.lit(True) if last and open_end else c <= edges[i + 1], F.lit(label))
    return F.when(c.isNotNull(), out)


def safe_round(c: Column, digits: int) -> Column:
    """Half-even rounding, as stored figures use."""
    return F.bround(c, digits)
