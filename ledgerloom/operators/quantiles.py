"""Exact quantiles of a whole column.

The built-in ``percentile`` gathers every distinct value in one task. For a
large column the position is narrowed first: approximate quantiles with a known
rank error bracket the answer, and the next pass looks only inside the bracket.
Three passes leave a few millionths of the rows, and the bounds are literals
that the scan can use to skip data. Only numbers reach the driver: a fixed
count of marks per pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lineage_cut

# Rank error of an approximate quantile is at most rows/ACCURACY, well under a step.
ACCURACY = 10_000
STEPS = 2_000
# Up to this many values the built-in exact percentile is used.
DIRECT_ROWS = 1_000_000


def exact_quantiles(
    df: DataFrame, column: str, wanted: dict[str, float], narrow: bool | None = None
) -> DataFrame:
    """One row with a linearly interpolated quantile per name in ``wanted``."""
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    # Several passes look at the values: what derives them runs once. They are counted,
    # as no size estimate of compressed files or joins says how many distinct ones one task would gather.
    values = lineage_cut(values, "values")
    if narrow is None:
        narrow = values.count() > DIRECT_ROWS
    if not narrow:
        return values.agg(*[F.percentile("v", F.lit(q)).alias(name) for name, q in wanted.items()])
    found = _narrowed(values, list(wanted.values()))
    return df.sparkSession.range(1).select(
        *[F.lit(x).cast("double").alias(name) for name, x in zip(wanted, found)]
    )


def _narrowed(values: DataFrame, qs: list[float]) -> list[float | None]:
    first = values.agg(F.count("v").alias("n"), _marks(F.col("v")).alias("m")).first()
    n = first["n"]
    if n == 0:
        return [None] * len(qs)
    places = [q * (n - 1) for q in qs]
    boxes = [_box(first["m"], n, 0, p) for p in places]
    inside = [F.when(F.col("v").between(lo, hi), F.col("v")) for lo, hi in boxes]
    second = values.agg(
        *[F.count_if(F.col("v") < lo).alias(f"below{i}") for i, (lo, _) in enumerate(boxes)],
        *[F.count(x).alias(f"n{i}") for i, x in enumerate(inside)],
        *[_marks(x).alias(f"m{i}") for i, x in enumerate(inside)],
    ).first()
    boxes = [_box(second[f"m{i}"], second[f"n{i}"], second[f"below{i}"], p) for i, p in enumerate(places)]
    return [_pick(values, box, p) for box, p in zip(boxes, places)]


def _marks(x):
    return F.percentile_approx(x, F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), F.lit(ACCURACY))


def _box(marks: list[float], size: int, skipped: int, place: float) -> tuple[float, float]:
    """Values that surround a zero-based place, a step wider than the rank error."""
    low, high = math.floor(place) - skipped, math.ceil(place) - skipped
    at_low = max(0, math.floor(low / size * STEPS) - 1)
    at_high = min(STEPS, math.ceil((high + 1) / size * STEPS) + 1)
    return marks[at_low], marks[at_high]


def _pick(values: DataFrame, box: tuple[float, float], place: float) -> float:
    lo, hi = box
    if lo == hi:
        return lo
    skipped, inside = values.agg(
        F.count(F.when(F.col("v") < lo, 1)), F.count(F.when(F.col("v").between(lo, hi), 1))
    ).first()
    if not skipped <= math.floor(place) <= math.ceil(place) < skipped + inside:
        raise ArithmeticError(f"place {place} is outside of its bracket")
    runs = values.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    low, high = math.floor(place) - skipped, math.ceil(place) - skipped
    row = (
        runs.withColumn("upto", upto)
        .agg(F.min(F.when(F.col("upto") > low, F.col("v"))), F.min(F.when(F.col("upto") > high, F.col("v"))))
        .first()
    )
    return row[0] + (row[1] - row[0]) * (place - math.floor(place))
