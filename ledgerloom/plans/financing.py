"""Repo and financing-cost queries."""

from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import financing
from ..operators.series import latest_row
from ..sources import views
from ..sources.synthetic import random_walk_panel
from ..sources.views import REPO_SERIES
from .registry import query
from .sqltext import Windowed

W = Windowed("instrument_type", "date, event_id")
RATE = "rate_bps"
_lags = {f"{RATE}_lag_{k}": W.lag(RATE, k) for k in (1, 3, 5, 10, 20)}
_roll = {
    f"{RATE}_roll{n}_{stat}": W.roll(agg, RATE, n, max(1, n // 2), skip=1)
    for n in (5, 10, 20)
    for stat, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
}


def _cols(exprs, src="v_repo"):
    return "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {src}"


@query("lag_features", _cols(_lags), "v_repo", " ".join(_lags))
def lag_features(spark, sf):
    return financing.lag_features(views.repo(spark, sf), REPO_SERIES, RATE).select("event_id", *_lags)


@query("shifted_rolling", _cols(_roll), "v_repo", " ".join(_roll))
def shifted_rolling(spark, sf):
    return financing.shifted_rolling(views.repo(spark, sf), REPO_SERIES, RATE).select("event_id", *_roll)


@query(
    "rate_change_accel",
    f"""SELECT event_id, rate_change_1d, rate_change_3d, {W.diff('rate_change_1d')} AS rate_accel_1d
        FROM (SELECT *, {W.diff(RATE)} AS rate_change_1d, {W.diff(RATE, 3)} AS rate_change_3d FROM v_repo)""",
    "v_repo",
    "rate_change_1d rate_change_3d rate_accel_1d",
)
def rate_change_accel(spark, sf):
    out = financing.rate_change_accel(views.repo(spark, sf), REPO_SERIES)
    return out.select("event_id", "rate_change_1d", "rate_change_3d", "rate_accel_1d")


_targets = {f"target_{h}d": W.lead(RATE, h) for h in (1, 3, 5)}


@query("horizon_target", _cols(_targets), "v_repo", " ".join(_targets))
def horizon_target(spark, sf):
    return financing.horizon_targets(views.repo(spark, sf), REPO_SERIES, RATE).select("event_id", *_targets)


@query(
    "calendar_basic",
    """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
       CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter FROM orders""",
)
def calendar_basic(spark, sf):
    out = financing.calendar_features(views.table(spark, sf, "orders"), "o_orderdate")
    return out.select("o_orderkey", "day_of_week", "month", "quarter")


_LB = "last_day({d}) - CAST(greatest(isodow(last_day({d})) - 5, 0) AS INTEGER)"
_D = "CAST(o_orderdate AS DATE)"
_NEXT = "CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE)"
_BME = f"""CASE WHEN {_D} <= {_LB.format(d=_D)} THEN {_LB.format(d=_D)} ELSE {_LB.format(d=_NEXT)} END"""


@query(
    "calendar_flags",
    f"""SELECT o_orderkey, CAST(last_day({_D}) - {_D} AS INTEGER) AS days_to_month_end, is_month_end,
        CASE WHEN month(o_orderdate) IN (3, 6, 9, 12) AND is_month_end = 1 THEN 1 ELSE 0 END AS is_quarter_end
        FROM (SELECT *, CASE WHEN ({_BME}) - {_D} <= 3 THEN 1 ELSE 0 END AS is_month_end FROM orders)""",
)
def calendar_flags(spark, sf):
    out = financing.calendar_features(views.table(spark, sf, "orders"), "o_orderdate")
    return out.select("o_orderkey", "days_to_month_end", "is_month_end", "is_quarter_end")


_QEND = f"last_day(CAST(date_trunc('quarter', {_D}) + INTERVAL 2 MONTH AS DATE))"


@query(
    "period_end_flags",
    f"""SELECT o_orderkey, CASE WHEN last_day({_D}) - {_D} <= 4.2 THEN 1 ELSE 0 END AS month_end_flag,
        CASE WHEN {_QEND} - {_D} <= 7.0 THEN 1 ELSE 0 END AS quarter_end_flag,
        CASE WHEN make_date(CAST(year(o_orderdate) AS INTEGER), 12, 31) - {_D} <= 14.0 THEN 1 ELSE 0 END AS year_end_flag
        FROM orders""",
)
def period_end_flags(spark, sf):
    d = F.col("o_orderdate")
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        calendar.near_period_end(d, "month", 3).alias("month_end_flag"),
        calendar.near_period_end(d, "quarter", 5).alias("quarter_end_flag"),
        calendar.near_period_end(d, "year", 10).alias("year_end_flag"),
    )


_WD = "least(isodow(o_orderdate) - 1, 4)"


@query(
    "add_bdays",
    f"""SELECT o_orderkey, n, strftime({_D} - CAST(isodow(o_orderdate) - 1 - {_WD} AS INTEGER)
          + CAST(n + 2 * (({_WD} + n) // 5) AS INTEGER), '%Y-%m-%d') AS shifted
        FROM orders, (VALUES (1), (3), (5), (10)) h(n)""",
)
def add_bdays(spark, sf):
    horizons = F.explode(F.array(*[F.lit(n) for n in (1, 3, 5, 10)])).alias("n")
    days = views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", horizons)
    moved = calendar.add_business_days(F.col("o_orderdate"), F.col("n"))
    return days.select("o_orderkey", "n", F.date_format(moved, "yyyy-MM-dd").alias("shifted"))


_BASIS = """SELECT event_id, rate_bps - sofr * 100 AS repo_sofr_spread, rate_bps - fed_funds * 100 AS repo_ff_spread,
  (sofr - ois) * 100 AS ois_basis, (libor_3m - sofr) * 100 AS curve_slope_proxy
  FROM v_repo LEFT JOIN v_funding USING (day)"""
_basis = "repo_sofr_spread repo_ff_spread ois_basis curve_slope_proxy"


@query("macro_basis_bps", _BASIS, "v_repo v_funding", _basis)
def macro_basis_bps(spark, sf):
    # One funding row per calendar day.
    joined = views.repo(spark, sf).join(F.broadcast(views.funding(spark, sf)), "day", "left")
    return financing.macro_basis(joined).select("event_id", *_basis.split())


@query(
    "repo_star_join",
    """SELECT event_id, instrument_type, rate_bps, sofr, notional, budget_rate_bps FROM v_repo
       LEFT JOIN v_funding USING (day) LEFT JOIN v_notional USING (day, instrument_type)
       LEFT JOIN v_budget USING (instrument_type)""",
    "v_repo v_funding v_notional v_budget",
    "rate_bps sofr notional:3 budget_rate_bps",
)
def repo_star_join(spark, sf):
    joined = financing.star_join(
        views.repo(spark, sf), views.funding(spark, sf), views.notionals(spark, sf), views.budget(spark, sf)
    )
    return joined.select("event_id", "instrument_type", "rate_bps", "sofr", "notional", "budget_rate_bps")


@query(
    "tenor_spreads",
    """SELECT day, instrument_type, avg(CASE WHEN tenor = 'T/N' THEN rate_bps END)
         - avg(CASE WHEN tenor = 'O/N' THEN rate_bps END) AS tn_on_spread,
         avg(CASE WHEN tenor = '1W' THEN rate_bps END)
         - avg(CASE WHEN tenor = 'O/N' THEN rate_bps END) AS w1_on_spread
       FROM v_repo GROUP BY 1, 2""",
    "v_repo",
    "tn_on_spread w1_on_spread",
    "day",
)
def tenor_spreads(spark, sf):
    return financing.tenor_spreads(views.repo(spark, sf))


@query(
    "category_codes",
    """SELECT event_id, CAST(dense_rank() OVER (ORDER BY instrument_type) - 1 AS INTEGER) AS instrument_type_code
       FROM v_repo""",
    "v_repo",
)
def category_codes(spark, sf):
    out = financing.category_codes(views.repo(spark, sf), "instrument_type", "instrument_type_code")
    return out.select("event_id", "instrument_type_code")


def _naive(spark, sf):
    """Forecasts from trailing means, so forecast rules have something to judge."""
    rolled = financing.shifted_rolling(views.repo(spark, sf), REPO_SERIES, RATE)
    return rolled.withColumns(
        {
            "current_rate_bps": F.col(RATE),
            "forecast_1d_bps": F.col(f"{RATE}_roll5_mean"),
            "forecast_3d_bps": F.col(f"{RATE}_roll10_mean"),
            "forecast_5d_bps": F.col(f"{RATE}_roll20_mean"),
        }
    )


_NAIVE = (
    f"SELECT *, rate_bps AS current_rate_bps, {_roll[RATE + '_roll5_mean']} AS forecast_1d_bps, "
    f"{_roll[RATE + '_roll10_mean']} AS forecast_3d_bps, {_roll[RATE + '_roll20_mean']} AS forecast_5d_bps, "
    + ", ".join(f"{e} AS {n}" for n, e in _targets.items())
    + " FROM v_repo"
)


@query(
    "forecast_metrics",
    " UNION ALL ".join(
        f"""SELECT CAST({h} AS INTEGER) AS horizon, avg(abs(forecast_{h}d_bps - target_{h}d)) AS mae,
            sqrt(avg((forecast_{h}d_bps - target_{h}d) * (forecast_{h}d_bps - target_{h}d))) AS rmse, count(*) AS n_samples
            FROM ({_NAIVE}) WHERE target_{h}d IS NOT NULL"""
        for h in (1, 3, 5)
    ),
    "v_repo",
    "mae rmse",
)
def forecast_metrics(spark, sf):
    return financing.forecast_metrics(financing.horizon_targets(_naive(spark, sf), REPO_SERIES, RATE))


@query(
    "cost_vs_budget",
    f"""SELECT event_id, forecast_1d_bps - budget_rate_bps AS cost_vs_budget_bps,
        coalesce(forecast_1d_bps - budget_rate_bps > 5, false) AS alert_flag
        FROM ({_NAIVE}) LEFT JOIN v_budget USING (instrument_type)""",
    "v_repo v_budget",
    "cost_vs_budget_bps",
)
def cost_vs_budget(spark, sf):
    out = financing.cost_vs_budget(_naive(spark, sf), views.budget(spark, sf))
    return out.select("event_id", "cost_vs_budget_bps", "alert_flag")


_HORIZONS = " UNION ALL ".join(
    f"SELECT *, CAST({h} AS INTEGER) AS horizon_days, forecast_{h}d_bps AS forecast_bps FROM joined" for h in (1, 3, 5)
)


@query(
    "forecast_alerts",
    f"""WITH joined AS (SELECT * FROM ({_NAIVE}) LEFT JOIN v_budget USING (instrument_type)), long AS ({_HORIZONS})
        SELECT event_id, horizon_days, forecast_bps, coalesce(forecast_bps - budget_rate_bps, 0) AS breach_bps, 'RATE_SPIKE' AS alert_type
        FROM long WHERE forecast_bps - current_rate_bps >= 10
        UNION ALL
        SELECT event_id, horizon_days, forecast_bps, forecast_bps - budget_rate_bps, 'BUDGET_BREACH'
        FROM long WHERE forecast_bps - budget_rate_bps >= 5""",
    "v_repo v_budget",
    "forecast_bps breach_bps",
)
def forecast_alerts(spark, sf):
    alerts = financing.forecast_alerts(_naive(spark, sf), views.budget(spark, sf))
    return alerts.select("event_id", "horizon_days", "forecast_bps", "breach_bps", "alert_type")


@query(
    "forecast_messages",
    f"""WITH joined AS (SELECT * FROM ({_NAIVE}) LEFT JOIN v_budget USING (instrument_type)), long AS ({_HORIZONS}),
        fired AS (SELECT *, 'RATE_SPIKE' AS alert_type FROM long WHERE forecast_bps - current_rate_bps >= 10
          UNION ALL SELECT *, 'BUDGET_BREACH' FROM long WHERE forecast_bps - budget_rate_bps >= 5)
        SELECT event_id, horizon_days, printf('%s: in %d days %s may pay %.1f bps, now it pays %.1f', alert_type, horizon_days,
          CAST(instrument_type AS VARCHAR), CAST(forecast_bps AS DOUBLE) + 1e-9, CAST(current_rate_bps AS DOUBLE) + 1e-9)
          || coalesce(printf(', budgeted are %.1f', CAST(budget_rate_bps AS DOUBLE) + 1e-9), '') AS message FROM fired""",
    "v_repo v_budget",
)
def forecast_messages(spark, sf):
    alerts = financing.forecast_alerts(_naive(spark, sf), views.budget(spark, sf))
    return alerts.select("event_id", "horizon_days", financing.forecast_message().alias("message"))


@query("synthetic_panel")
def synthetic_panel(spark, sf):
    bases = views.budget(spark, sf)
    return random_walk_panel(bases, "instrument_type", "budget_rate_bps", end="2024-01-31")


@query(
    "publish_latest",
    """SELECT instrument_type, event_id, rate_bps FROM v_repo
       QUALIFY row_number() OVER (PARTITION BY instrument_type ORDER BY date DESC, event_id DESC) = 1""",
    "v_repo",
    "rate_bps",
)
def publish_latest(spark, sf):
    return latest_row(views.repo(spark, sf), REPO_SERIES).select("instrument_type", "event_id", "rate_bps")
