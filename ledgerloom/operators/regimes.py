"""Comparing two labelings of the same days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflicts(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """1 where two labelings of the same key disagree; labels must share their names."""
    other = second.select(key, F.col(label).alias("__other"))
    return first.join(other, key).select(
        key, (F.col(label) != F.col("__other")).cast("int").alias("ensemble_conflict")
    )
