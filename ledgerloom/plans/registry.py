"""Registered queries with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _digits(nums: str) -> dict[str, int]:
    out = {}
    for item in nums.split():
        name, _, digits = item.partition(":")
        out[name] = int(digits or 6)
    return out


def query(name: str, sql: str | None = None, views: str = "", nums: str = "", dates: str = ""):
    """Register a query.

    ``nums`` lists real-valued result columns (``name`` or ``name:digits``) that
    are rounded alike on both sides, after a small shift that settles exact
    halves one way in any engine; ``dates`` lists dates shown as text.
    """

    digits = _digits(nums)
    day_columns = dates.split()

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(
                *[
                    F.expr(f"round(cast(`{c}` as double) + 1e-9D, {digits[c]}) + 0.0D").alias(c)
                    if c in digits
                    else F.date_format(c, "yyyy-MM-dd").alias(c)
                    if c in day_columns
                    else F.col(c)
                    for c in df.columns
                ]
            )

        QUERIES[name] = run
        if sql is not None:
            shown = [
                f"round(CAST({c} AS DOUBLE) + 1e-9, {d}) + 0.0 AS {c}" for c, d in digits.items()
            ] + [f"strftime(CAST({c} AS DATE), '%Y-%m-%d') AS {c}" for c in day_columns]
            replace = f" REPLACE ({', '.join(shown)})" if shown else ""
            prefix = with_views(*views.split()) if views else ""
            ORACLES[name] = f"{prefix} SELECT *{replace} FROM ({sql}) AS result".strip()
        return fn

    return register
