"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Inputs below this are an ordinary amount of work for a single task. Estimates are of
# compressed files, where a row of a few distinct values takes a byte or less.
SMALL_INPUT_BYTES = 1024 * 1024
SMALL_INPUT_CONF = "spark.ledgerloom.smallInputBytes"
# A broadcast side is kept to this many rows.
BROADCAST_ROWS = 1_000_000
BROADCAST_ROWS_CONF = "spark.ledgerloom.broadcastRows"


def int_conf(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def planned_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate, or None where it may be too small.

    Joins and unknown sources are overestimated; the rows that a generator or
    a Python function makes of one are not known at all. Literal tables are
    folded to local rows before the estimate.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    plan = plan.queryExecution().optimizedPlan()
    text = plan.toString()
    if "Generate " in text and not _literal_rows(text):
        return None
    if re.search(r"MapIn(Pandas|Arrow)|FlatMapGroups|FlatMapCoGroups", text):
        return None
    return int(plan.stats().sizeInBytes())


def _literal_rows(plan: str) -> bool:
    """Whether a plan reads nothing but a range of one row, and generates from constants."""
    leaves = re.findall(r"(?:Relation|InMemoryRelation|LogicalRDD|LocalRelation|OneRowRelation|Range) ?\(?[^\n]*", plan)
    return bool(leaves) and all(re.match(r"Range \(0, 1, ", leaf) for leaf in leaves)


def is_small_input(df: DataFrame) -> bool:
    size = planned_bytes(df)
    return size is not None and size <= int_conf(df, SMALL_INPUT_CONF, SMALL_INPUT_BYTES)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only for a side whose estimate is small and can be trusted.

    Nothing is run for it. Any other side is returned without a hint: adaptive
    execution broadcasts it when its shuffled size turns out small, and splits
    skewed partitions when it does not.
    """
    limit = int_conf(df, BROADCAST_ROWS_CONF, BROADCAST_ROWS)
    size = planned_bytes(df)
    return F.broadcast(df) if size is not None and size <= 16 * limit else df


def fixed_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A short constant table as a plan of literals, which needs no Python task to read."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row without a shuffle."""
    return df.crossJoin(F.broadcast(one))
