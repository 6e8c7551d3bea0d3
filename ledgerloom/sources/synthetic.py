"""A random-walk rate panel for instruments whose source is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import normal


def random_walk_panel(
    instruments: DataFrame, key: str, base: str, end: str, days: int = 400, step: float = 2.5, seed: int = 42
) -> DataFrame:
    """Walk each instrument from its base rate over business days, never below zero.

    The floor makes the walk recursive, so it is folded per instrument over an
    array of ``days`` steps, a fixed length.
    """
    shocks = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda i: normal(seed, F.col(key), i) * step)
    walk = F.aggregate(
        shocks,
        F.array(F.col(base).cast("double")),
        lambda path, x: F.concat(path, F.array(F.greatest(F.lit(0.0), F.element_at(path, -1) + x))),
    )
    span = (days * 7) // 5 + 7
    last = F.to_date(F.lit(end))
    calendar = F.filter(
        F.sequence(F.date_sub(last, span), last), lambda d: F.weekday(d) < 5
    )
    recent = F.slice(calendar, F.size(calendar) - days + 1, days)
    rows = F.arrays_zip(recent.alias("date"), F.slice(walk, 2, days).alias("rate_bps"))
    return instruments.select(key, F.explode(rows).alias("r")).select(
        key, F.col("r.date").alias("date"), F.round("r.rate_bps", 2).alias("rate_bps"), F.lit("O/N").alias("tenor")
    )
