"""Structured Streaming jobs over an event stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.exposure import risk_level

SCALE = 500.0
# Event time after which a user without rows is forgotten.
KEEP_US = 365 * 86_400 * 1_000_000
# Fixed schema of the event stream.
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream; times are read as UTC so that they can carry a watermark."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def levelled(stream: DataFrame) -> DataFrame:
    return stream.withColumn("score", F.col("value") / SCALE).withColumn("risk_level", risk_level(F.col("score")))


def actionable(stream: DataFrame) -> DataFrame:
    """Scored rows that call for action: stateless, so any partitioning will do."""
    return levelled(stream).where(F.col("risk_level").isin("HIGH", "CRITICAL")).select(
        "event_id", "user_id", "score", "risk_level"
    )


def rule_alerts(stream: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for every rule that fires on an event: its name and the level it gives.

    A rule is a condition and a level. Rules look at one event each, so the job
    keeps no state and any partitioning will do.
    """
    fired = [F.when(fires, F.struct(F.lit(name).alias("rule"), level.alias("level"))) for name, (fires, level) in rules.items()]
    return stream.select("event_id", "user_id", F.explode(F.array_compact(F.array(*fired))).alias("r")).select("event_id", "user_id", "r.*")


def alert_counts(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per level in event-time windows; rows later than the watermark are dropped."""
    return (
        levelled(stream)
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window, slide or window), "risk_level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "risk_level", "n")
    )


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Process what is available and read the appended result."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def _changes(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One user's changes of level, in order of event time.

    The state is the last level that is settled and the rows the watermark has not
    passed yet. Rows before the watermark are settled in order; of later ones the
    earliest says when to look again.
    """
    last, settled_us, waiting = state.get if state.exists else (None, None, "[]")
    rows = [tuple(r) for r in json.loads(waiting)]
    for frame in frames:
        rows += zip(frame["us"].tolist(), frame["event_id"].tolist(), frame["risk_level"].tolist())
    rows.sort()
    mark = state.getCurrentWatermarkMs() * 1000
    due = [r for r in rows if r[0] <= mark]
    rows = rows[len(due) :]
    out = []
    for us, event, level in due:
        if last is not None and level != last:
            out.append((key[0], event, last, level))
        last, settled_us = level, us
    if rows or settled_us is None or settled_us + KEEP_US > mark:
        state.update((last, settled_us, json.dumps(rows)))
        next_us = rows[0][0] if rows else settled_us + KEEP_US
        state.setTimeoutTimestamp(max(next_us, mark) // 1000 + 1)
    else:
        state.remove()
    yield pd.DataFrame(out, columns=["user_id", "event_id", "from_level", "to_level"])


def level_changes(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events at which a user's level differs from the one before, in event order.

    A row counts once the watermark has passed it, so how rows fall into batches
    and in which order they come makes no difference; rows that come later than
    the watermark allows are left out. A user without rows for ``KEEP_US`` of
    event time is forgotten, and starts without a level before. A user's rows are
    settled one after another, of each no more than come within ``late`` are held.
    """
    rows = levelled(stream).withWatermark("ts", late)
    rows = rows.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "risk_level")
    return rows.groupBy("user_id").applyInPandasWithState(
        _changes,
        "user_id long, event_id long, from_level string, to_level string",
        "last string, settled_us long, waiting string",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
