"""Null- and zero-safe column expressions.

Missing values are NULL, never NaN: Spark aggregates skip NULL only. ANSI mode
raises on division by zero, so every ratio goes through ``ratio``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A rolling deviation below this is rounding noise of a constant stretch.
SD_FLOOR = 1e-9


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct_change(x: Column, past: Column) -> Column:
    return ratio(x, past) - F.lit(1.0)


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd, NULL where the deviation is zero or missing."""
    return F.when(sd > SD_FLOOR, (x - mean) / sd)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def first_available(df: DataFrame, names: list[str], default: float) -> Column:
    """The first of ``names`` the table has, with ``default`` for NULL or no column."""
    for name in names:
        if name in df.columns:
            return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))
    return F.lit(float(default))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities of floating columns into NULL."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    inf = float("inf")
    return df.select(
        *[
            F.when(~F.isnan(c) & (F.abs(F.col(c)) < inf), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    kinds = {"double", "float", "integer", "long", "short", "byte"}
    return [f.name for f in df.schema.fields if f.dataType.typeName() in kinds and f.name not in exclude]


def mean_skipping_null(cols: list[Column]) -> Column:
    """Row-wise mean over the columns that are present."""
    zero = F.lit(0.0)
    total = reduce(add, [F.coalesce(c.cast("double"), zero) for c in cols])
    seen = reduce(add, [c.isNotNull().cast("int") for c in cols])
    return ratio(total, F.nullif(seen, F.lit(0)))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; a constant column gives 0."""
    return F.when(x.isNotNull(), F.coalesce(ratio(x - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0)))


def right_closed_bin(x: Column, edges: list[float]) -> Column:
    """Index of the bin (lo, hi] that holds ``x``; -1 outside every bin or for NULL."""
    out = F.lit(-1)
    for i in reversed(range(len(edges) - 1)):
        inside = (x > F.lit(float(edges[i]))) & (x <= F.lit(float(edges[i + 1])))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def settled(name: str) -> Column:
    """A number for a text, moved by so little that exact halves round up in any engine."""
    return F.col(name) + F.lit(1e-9)
