"""Publish tables, alert logs and audit rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import numbered


def to_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """The contract's columns in order, booleans and times as text; raises on a missing one."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"publish table lacks columns {missing}")
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def as_published(c: str):
        if kinds[c] in ("timestamp", "timestamp_ntz"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
        if kinds[c] in ("boolean", "date"):
            return F.col(c).cast("string").alias(c)
        return F.col(c)

    return df.select(*[as_published(c) for c in columns])


def publish(df: DataFrame, columns: list[str], path: str, partition_by: list[str] | None = None) -> None:
    writer = to_contract(df, columns).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def batched(df: DataFrame, order_id: str, size: int = 500) -> DataFrame:
    """Consecutive batches of ``size`` rows in the order of a unique id, from 0."""
    return numbered(df, order_id, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def config_digest(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()


def audit_row(df: DataFrame, run_id: str, config: dict, cost: str = "optimization_cost") -> DataFrame:
    """One row about a run: sizes, cost, status and the digest of its configuration."""
    chosen = F.count_if("recommended")
    return df.agg(
        F.count(F.lit(1)).alias("n_items"),
        chosen.alias("n_recommended"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost"),
        F.when(chosen == 0, "infeasible").otherwise("optimal").alias("status"),
    ).select(F.lit(run_id).alias("run_id"), F.lit(config_digest(config)).alias("config_md5"), "*")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
