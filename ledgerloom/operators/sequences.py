"""Sliding sequences of rows for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import Series, over_history
from .sizes import broadcast_if_small


def sliding_sequences(df: DataFrame, series: Series, column: str, length: int, name: str = "sequence") -> DataFrame:
    """The last ``length`` values at each row as an array; NULL in the first length-1 rows."""

    def compute(d, w):
        f = w.rowsBetween(-(length - 1), 0)
        values = F.collect_list(F.coalesce(column, F.lit(0.0))).over(f)
        return d.withColumn(name, F.when(F.size(values) == length, values))

    return over_history(df, series, compute, depth=length - 1)


def pad_first_score(df: DataFrame, series: Series, score: str) -> DataFrame:
    """Give the rows before the first scored one that first score."""
    keys = list(series.keys)
    rank = F.when(F.col(score).isNotNull(), F.struct(*series.order))
    first = df.groupBy(*keys).agg(F.min_by(score, rank).alias("__first"))
    return df.join(broadcast_if_small(first), keys, "left").withColumn(score, F.coalesce(score, "__first")).drop("__first")
