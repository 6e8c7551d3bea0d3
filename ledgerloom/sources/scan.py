"""Reading sources by type, with date filters that reach the scan."""

from __future__ import annotations

import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_log = logging.getLogger(__name__)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a stated schema; ordering is left to the windows that need it."""
    return spark.read.csv(path, schema=schema, header=True)


def sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def table_since(spark: SparkSession, name: str, date: str, cutoff: str) -> DataFrame:
    """Rows of a table from a cutoff on; the comparison is pushed to the source."""
    return spark.table(name).where(F.col(date) >= F.lit(cutoff).cast("timestamp_ntz"))


def json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Landed JSON payloads: a record per line, or records listed under data, rows or results.

    Payloads are read line by line, so a landing folder may hold any number of
    files of any size; ``record`` is the schema of one record.
    """
    fields = T.StructType.fromDDL(record)
    envelope = T.StructType(
        [T.StructField(name, T.ArrayType(fields)) for name in ("data", "rows", "results")] + list(fields.fields)
    )
    payload = spark.read.schema(envelope).json(path)
    listed = F.coalesce("data", "rows", "results")
    bare = F.array(F.struct(*[F.col(f.name) for f in fields.fields]))
    return payload.select(F.explode(F.coalesce(listed, bare)).alias("r")).select("r.*")


def load(spark: SparkSession, source: dict) -> DataFrame:
    """Read a source described by ``{"source_type": ..., ...}``."""
    kind = source["source_type"]
    if kind == "csv":
        return csv(spark, source["path"], source["schema"])
    if kind == "json":
        return json_records(spark, source["path"], source["schema"])
    if kind == "parquet":
        return spark.read.parquet(source["path"])
    if kind == "sql":
        return sql(spark, source["query"])
    if kind == "table":
        if "cutoff" in source:
            return table_since(spark, source["table"], source["date"], source["cutoff"])
        return spark.table(source["table"])
    raise ValueError(f"unknown source_type {kind!r}")


def lookback_from_latest(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows no older than ``days`` before the latest date."""
    # Fetched first, so that the scan gets a literal bound.
    latest = df.agg(F.max(date)).first()[0]
    bound = F.lit(latest).cast(df.schema[date].dataType) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(date) >= bound.cast(df.schema[date].dataType))


def lookback_as_of(df: DataFrame, date: str, days: int, as_of: str) -> DataFrame:
    """Rows no older than ``days`` before a given day; the bound is a literal the scan can use."""
    bound = F.lit(as_of).cast("date") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(date) >= bound.cast(df.schema[date].dataType))


def freshness(df: DataFrame, series: str, date: str, as_of: str, max_age_days: int = 2) -> DataFrame:
    """Last date of each cached series and whether it is recent enough to reuse."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date(F.col("last_date")))
    return (
        df.groupBy(series)
        .agg(F.max(date).alias("last_date"))
        .withColumn("age_days", age)
        .withColumn("fresh", F.col("age_days") <= max_age_days)
    )


def cached_series(spark: SparkSession, path: str, date: str, as_of: str, refresh, max_age_days: int = 2) -> DataFrame:
    """A cached series, refreshed when stale.

    ``refresh()`` returns the new rows and may read the cache. They are written to
    a folder of their own; only when that has been read back does the cache's list
    of versions get it, in one appended file. So a refresh that fails, at once or
    while it runs, leaves the cache as it was, and the stale rows are used; without
    any cached rows the failure is raised. Earlier versions stay until removed.
    """
    cached = _newest(spark, path)
    if cached is not None:
        last = cached.agg(F.max(date).cast("date").alias("d"))
        age = last.select(F.datediff(F.to_date(F.lit(as_of)), "d")).first()[0]
        if age is not None and age <= max_age_days:
            return cached
    try:
        name = f"version-{uuid.uuid4().hex}"
        refresh().write.parquet(f"{path}/{name}")
        fresh = spark.read.parquet(f"{path}/{name}")
        fresh.agg(F.max(date)).first()
    except Exception:
        if cached is None:
            raise
        _log.warning("the refresh of %s failed; its stale rows are used", path, exc_info=True)
        return cached
    versions = spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("at"))
    versions.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return fresh


def _newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a cached series, or None where there is no cache."""
    try:
        name = spark.read.parquet(f"{path}/versions").agg(F.max_by("name", "at")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.parquet(f"{path}/{name}")
