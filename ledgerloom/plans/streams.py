"""Streaming queries, run over the events that are there."""

from pyspark.sql import functions as F

from ..operators.squeeze import squeeze_tier
from ..session import shared_dir
from ..streaming import alerts
from .registry import query

_LEVEL = "CASE WHEN value / 500 >= 0.85 THEN 'CRITICAL' WHEN value / 500 >= 0.60 THEN 'HIGH' WHEN value / 500 >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END"
_LEVELLED = f"SELECT *, value / 500 AS score, {_LEVEL} AS risk_level FROM events"


@query(
    "stream_alerts",
    f"SELECT event_id, user_id, score, risk_level FROM ({_LEVELLED}) WHERE risk_level IN ('HIGH', 'CRITICAL')",
    "",
    "score",
)
def stream_alerts(spark, sf):
    return alerts.run_to_table(alerts.actionable(alerts.events(spark, sf)), shared_dir(spark, "alerts"))


@query(
    "stream_rule_alerts",
    """SELECT event_id, user_id, 'squeeze' AS rule, CASE WHEN value / 500 >= 0.80 THEN 'CRITICAL' ELSE 'HIGH' END AS level FROM events WHERE value / 500 >= 0.60
       UNION ALL SELECT event_id, user_id, 'anomaly', CASE WHEN value / 500 > 0.9 THEN 'CRITICAL' ELSE 'WARNING' END FROM events WHERE value / 500 > 0.7
       UNION ALL SELECT event_id, user_id, 'budget', 'BUDGET_BREACH' FROM events WHERE value - 300 >= 5""",
)
def stream_rule_alerts(spark, sf):
    """Squeeze tier, anomaly level and budget breach of every event."""
    score = F.col("value") / alerts.SCALE
    tier = squeeze_tier(score)
    rules = {
        "squeeze": (tier.isin("HIGH", "CRITICAL"), tier),
        "anomaly": (score > 0.7, F.when(score > 0.9, "CRITICAL").otherwise("WARNING")),
        "budget": (F.col("value") - 300 >= 5, F.lit("BUDGET_BREACH")),
    }
    return alerts.run_to_table(alerts.rule_alerts(alerts.events(spark, sf), rules), shared_dir(spark, "rules"))


_CLOSED = "WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"


@query(
    "stream_alert_counts",
    f"""SELECT strftime(start, '%Y-%m-%d %H:%M') AS window_start, risk_level, count(*) AS n
        FROM (SELECT date_trunc('hour', ts) AS start, risk_level FROM ({_LEVELLED})) {_CLOSED} GROUP BY 1, 2""",
)
def stream_alert_counts(spark, sf):
    counts = alerts.run_to_table(alerts.alert_counts(alerts.events(spark, sf)), shared_dir(spark, "counts"))
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    "stream_alert_sliding",
    f"""SELECT strftime(start, '%Y-%m-%d %H:%M') AS window_start, risk_level, count(*) AS n
        FROM (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS start, risk_level
              FROM ({_LEVELLED}), (VALUES (0), (1)) x(k)) {_CLOSED} GROUP BY 1, 2""",
)
def stream_alert_sliding(spark, sf):
    sliding = alerts.alert_counts(alerts.events(spark, sf), "1 hour", "30 minutes")
    counts = alerts.run_to_table(sliding, shared_dir(spark, "sliding"))
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    "stream_level_change",
    f"""SELECT user_id, event_id, p AS from_level, risk_level AS to_level FROM
        (SELECT *, lag(risk_level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ({_LEVELLED})) WHERE p <> risk_level
        AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
)
def stream_level_change(spark, sf):
    return alerts.run_to_table(alerts.level_changes(alerts.events(spark, sf)), shared_dir(spark, "levels"))
