"""Borrow-rate anomaly queries."""

from pyspark.sql import functions as F

from ..operators import anomaly
from ..operators.quantiles import exact_quantiles
from ..sources import views
from ..sources.views import RATE_SERIES
from .registry import query
from .sqltext import Windowed

THRESHOLD = 0.4
W = Windowed("ticker", "date, event_id")

_roll_cols = {
    f"rate_{k}_{n}": {
        "rolling_mean": W.roll("avg", "rate", n, max(1, n // 2)),
        "rolling_std": W.roll("stddev_samp", "rate", n, max(1, n // 2)),
        "zscore": W.z0("rate", n, max(1, n // 2)),
    }[k]
    for n in anomaly.WINDOWS
    for k in ("rolling_mean", "rolling_std", "zscore")
}
_ROLLING = "SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in _roll_cols.items()) + " FROM {src}"
_SPREAD = f"""SELECT *, {W.roll('avg', 's', 10, 5)} AS spread_rolling_mean_10,
  {W.roll('stddev_samp', 's', 10, 5)} AS spread_rolling_std_10, {W.z0('s', 10, 5)} AS spread_zscore,
  {W.diff('s')} AS spread_change_1d, s AS spread_vs_benchmark
  FROM (SELECT *, rate - benchmark AS s FROM {{src}})"""
_MOMENTUM = f"""SELECT *, {W.diff('rate_change_1d')} AS rate_acceleration,
  {W.z0('rate_change_1d', 10, 5)} AS rate_mom_zscore
  FROM (SELECT *, {W.diff('rate')} AS rate_change_1d, {W.diff('rate', 5)} AS rate_change_5d,
        {W.pct('rate')} AS rate_pct_change_1d FROM {{src}})"""
_LIQUIDITY = f"""SELECT *, {W.z0('rate_high_low_range', 20, 10)} AS rate_range_zscore
  FROM (SELECT *, rate_rolling_max_10 - rate_rolling_min_10 AS rate_high_low_range FROM (
    SELECT *, {W.roll('max', 'rate', 10, 5)} AS rate_rolling_max_10,
      {W.roll('min', 'rate', 10, 5)} AS rate_rolling_min_10,
      coalesce(CASE WHEN {W.roll('stddev_samp', 'rate', 10, 5)} IS NOT NULL THEN
        least({W.roll('stddev_samp', 'rate', 10, 5)} / nullif({W.roll('avg', 'rate', 10, 5)}, 0), 5) END, 0)
        AS rate_volatility_ratio FROM {{src}}))"""

_KEY = ["event_id", "ticker"]
_roll_names = list(_roll_cols)
_spread_names = ["spread_vs_benchmark", "spread_rolling_mean_10", "spread_rolling_std_10", "spread_zscore", "spread_change_1d"]
_mom_names = ["rate_change_1d", "rate_change_5d", "rate_pct_change_1d", "rate_acceleration", "rate_mom_zscore"]
_liq_names = ["rate_rolling_max_10", "rate_rolling_min_10", "rate_high_low_range", "rate_volatility_ratio", "rate_range_zscore"]


def _pick(names, src):
    return f"SELECT event_id, ticker, {', '.join(names)} FROM ({src})"


@query("rolling_zscore", _pick(_roll_names, _ROLLING.format(src="v_rate")), "v_rate", " ".join(_roll_names))
def rolling_zscore(spark, sf):
    return anomaly.rolling_zscore(views.rates(spark, sf), RATE_SERIES).select(*_KEY, *_roll_names)


@query("spread_features", _pick(_spread_names, _SPREAD.format(src="v_rate")), "v_rate", " ".join(_spread_names))
def spread_features(spark, sf):
    return anomaly.spread_features(views.rates(spark, sf), RATE_SERIES).select(*_KEY, *_spread_names)


@query("rate_momentum", _pick(_mom_names, _MOMENTUM.format(src="v_rate")), "v_rate", " ".join(_mom_names))
def rate_momentum(spark, sf):
    return anomaly.rate_momentum(views.rates(spark, sf), RATE_SERIES).select(*_KEY, *_mom_names)


@query("liquidity_proxy", _pick(_liq_names, _LIQUIDITY.format(src="v_rate")), "v_rate", " ".join(_liq_names))
def liquidity_proxy(spark, sf):
    return anomaly.liquidity_proxy(views.rates(spark, sf), RATE_SERIES).select(*_KEY, *_liq_names)


_ALL = _LIQUIDITY.format(src="(" + _MOMENTUM.format(src="(" + _SPREAD.format(src="(" + _ROLLING.format(src="v_rate") + ")") + ")") + ")")


@query(
    "drop_warmup",
    f"SELECT event_id, ticker, {', '.join(anomaly.FEATURES)} FROM ({_ALL}) WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in anomaly.FEATURES),
    "v_rate",
    " ".join(anomaly.FEATURES),
)
def drop_warmup(spark, sf):
    return anomaly.build_features(views.rates(spark, sf), RATE_SERIES).select(*_KEY, *anomaly.FEATURES)


_RAW = f"""SELECT *, -abs({W.z0('rate', 20, 10)}) AS level_raw, -abs(rate_mom_zscore) AS change_raw
  FROM ({_MOMENTUM.format(src='v_rate')})"""


def _norm(raw):
    return (
        f"CASE WHEN max({raw}) OVER () > min({raw}) OVER () THEN least(greatest("
        f"(max({raw}) OVER () - {raw}) / (max({raw}) OVER () - min({raw}) OVER ()), 0), 1) ELSE 0 END"
    )


_SCORED = f"""SELECT *, 0.5 * if_score + 0.5 * lstm_score AS combined_score,
  0.5 * if_score + 0.5 * lstm_score >= {THRESHOLD} AS is_anomaly
  FROM (SELECT *, {_norm('level_raw')} AS if_score, {_norm('change_raw')} AS lstm_score FROM ({_RAW}))"""
_ALERTS = f"""SELECT *, CASE WHEN combined_score >= {THRESHOLD + 0.20} THEN 'CRITICAL'
  WHEN combined_score >= {THRESHOLD + 0.10} THEN 'WARNING' ELSE 'INFO' END AS alert_level
  FROM ({_SCORED}) WHERE is_anomaly"""


def _scored(spark, sf):
    return anomaly.score_anomalies(views.rates(spark, sf), RATE_SERIES, THRESHOLD)


@query("score_normalise", f"SELECT event_id, if_score, lstm_score FROM ({_SCORED})", "v_rate", "if_score lstm_score")
def score_normalise(spark, sf):
    return _scored(spark, sf).select("event_id", "if_score", "lstm_score")


@query("combined_score", f"SELECT event_id, combined_score, is_anomaly FROM ({_SCORED})", "v_rate", "combined_score")
def combined_score(spark, sf):
    return _scored(spark, sf).select("event_id", "combined_score", "is_anomaly")


@query(
    "anomaly_alerts",
    f"SELECT event_id, ticker, rate, combined_score, alert_level FROM ({_ALERTS})",
    "v_rate",
    "rate combined_score",
)
def anomaly_alerts(spark, sf):
    alerts = anomaly.anomaly_alerts(_scored(spark, sf), THRESHOLD)
    return alerts.select("event_id", "ticker", "rate", "combined_score", "alert_level")


@query(
    "alert_messages",
    f"""SELECT event_id, printf('%s: the borrow rate of %d stands out at %.4f (score %.4f)',
        alert_level, ticker, rate, combined_score) AS message FROM ({_ALERTS})""",
    "v_rate",
)
def alert_messages(spark, sf):
    alerts = anomaly.anomaly_alerts(_scored(spark, sf), THRESHOLD)
    return alerts.select("event_id", anomaly.alert_message().alias("message"))


@query(
    "score_percentile",
    f"""SELECT quantile_cont(combined_score, 0.90) AS p90, quantile_cont(combined_score, 0.95) AS p95
        FROM ({_SCORED})""",
    "v_rate",
    "p90 p95",
)
def score_percentile(spark, sf):
    return exact_quantiles(_scored(spark, sf), "combined_score", {"p90": 0.90, "p95": 0.95})


@query(
    "utc_timestamp",
    """SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'not a time'
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP), TIMESTAMP '2024-02-01 00:00:00') AS at_utc
       FROM events""",
)
def utc_timestamp(spark, sf):
    from ..sources.contracts import utc_timestamp as as_utc

    raw = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    events = views.table(spark, sf, "events")
    return events.select("event_id", as_utc(raw, "2024-02-01 00:00:00").cast("timestamp_ntz").alias("at_utc"))
