"""Macro feature, regime and dashboard queries."""

from pyspark.sql import functions as F

from ..functions.numeric import right_closed_bin
from ..operators import macro
from ..operators.series import latest_rows
from ..sources import publish, views
from ..sources.views import MACRO_DAYS
from .registry import query

O = "(ORDER BY date)"


def _f(n):
    return f"(ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(agg, x, n):
    return f"(CASE WHEN count({x}) OVER {_f(n)} >= {n} THEN {agg}({x}) OVER {_f(n)} END)"


def _z(x, n):
    return f"(({x} - {_roll('avg', x, n)}) / ({_roll('stddev_samp', x, n)} + 1e-8))"


def _d(x, k):
    return f"({x} - lag({x}, {k}) OVER {O})"


def _p(x, k):
    return f"({x} / nullif(lag({x}, {k}) OVER {O}, 0) - 1)"


def _select(exprs, src="v_macro"):
    return "SELECT date, " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {src}"


def _daily(spark, sf):
    return views.macro(spark, sf)


_levels = {}
for c in macro.RATES:
    for n in (5, 10, 20, 60, 120):
        _levels[f"{c}_ma{n}"] = _roll("avg", c, n)
        _levels[f"{c}_std{n}"] = _roll("stddev_samp", c, n)
        _levels[f"{c}_z{n}"] = _z(c, n)
        _levels[f"{c}_mom{n}"] = _d(c, n)
_levels |= {"fed_sofr_spread": "fed_funds - sofr", "prime_sofr_spread": "prime_rate - sofr", "iorb_sofr_spread": "iorb - sofr"}


@query("macro_levels", _select(_levels), "v_macro", " ".join(_levels), "date")
def macro_levels(spark, sf):
    return macro.level_features(_daily(spark, sf), MACRO_DAYS).select("date", *_levels)


_CURVE = """SELECT *, t_10yr - t_2yr AS curve_10y2y, CASE WHEN t_10yr - t_2yr < 0 THEN 1 ELSE 0 END AS curve_10y2y_inverted,
  t_10yr - t_3mo AS curve_10y3m, t_5yr - t_2yr AS curve_5y2y, 2 * t_5yr - (t_2yr + t_10yr) AS curve_butterfly,
  (coalesce(t_2yr, 0) + coalesce(t_5yr, 0) + coalesce(t_10yr, 0)) / nullif((t_2yr IS NOT NULL)::INT + (t_5yr IS NOT NULL)::INT
    + (t_10yr IS NOT NULL)::INT, 0) AS curve_level FROM v_macro"""
_curve = {c: c for c in ("curve_10y2y", "curve_10y2y_inverted", "curve_10y3m", "curve_5y2y", "curve_butterfly", "curve_level")}
for c in ("curve_10y2y", "curve_10y3m"):
    for n in (5, 10, 20):
        _curve[f"{c}_mom{n}d"] = _d(c, n)
    _curve[f"{c}_z60"] = _z(c, 60)


@query("curve_shape", _select(_curve, f"({_CURVE})"), "v_macro", " ".join(_curve), "date")
def curve_shape(spark, sf):
    return macro.curve_shape(_daily(spark, sf), MACRO_DAYS).select("date", *_curve)


_TENORS = ["t_3mo", "t_2yr", "t_5yr", "t_10yr"]
# Columns of the published curve.
CURVE_TABLE = ["date", *_TENORS, "curve_slope_10y2y", "curve_butterfly", "run_id"]


@query(
    "publish_curve_snapshot",
    f"""SELECT strftime(CAST(date AS DATE), '%Y-%m-%d') AS date, {', '.join(_TENORS)}, t_10yr - t_2yr AS curve_slope_10y2y,
        2 * t_5yr - t_2yr - t_10yr AS curve_butterfly, 'run-1' AS run_id FROM ({_CURVE})""",
    "v_macro",
    " ".join([*_TENORS, "curve_slope_10y2y", "curve_butterfly"]),
)
def publish_curve_snapshot(spark, sf):
    """The curve of every day as the published table has it."""
    shape = macro.curve_shape(_daily(spark, sf), MACRO_DAYS).withColumnRenamed("curve_10y2y", "curve_slope_10y2y")
    return publish.to_contract(shape.withColumn("run_id", F.lit("run-1")).withColumn("date", F.date_format("date", "yyyy-MM-dd")), CURVE_TABLE)


_spreads = {}
for c in macro.SPREADS:
    for n in (60, 120):
        _spreads[f"{c}_z{n}"] = _z(c, n)
    for n in (5, 10, 20):
        _spreads[f"{c}_mom{n}d"] = _d(c, n)
_spreads |= {"hy_ig_diff": "hy_ig_diff", "mbs_basis": "mbs_basis", "hy_ig_diff_z60": _z("hy_ig_diff", 60), "mbs_basis_z60": _z("mbs_basis", 60)}
_SPREAD_SRC = "(SELECT *, hy_oas - ig_oas AS hy_ig_diff, mortgage_30y - t_10yr AS mbs_basis FROM v_macro)"


@query("macro_spreads", _select(_spreads, _SPREAD_SRC), "v_macro", " ".join(_spreads), "date")
def macro_spreads(spark, sf):
    return macro.spread_features(_daily(spark, sf), MACRO_DAYS).select("date", *_spreads)


_BINS = "CASE WHEN {x} > 0 AND {x} <= 15 THEN 0 WHEN {x} > 15 AND {x} <= 20 THEN 1 WHEN {x} > 20 AND {x} <= 30 THEN 2 WHEN {x} > 30 AND {x} <= 40 THEN 3 WHEN {x} > 40 AND {x} <= 999 THEN 4 ELSE -1 END"
_liq = {f"vix_z{n}": _z("vix", n) for n in (10, 20, 60)} | {"vix_mom5d": _d("vix", 5), "rrp_balance_bn": "rrp_balance / 1e9"}
for n in (5, 10, 20):
    _liq[f"rrp_change{n}d"] = _d("rrp_balance", n)
    _liq[f"rrp_pct_change{n}d"] = _p("rrp_balance", n)
_liq |= {"rrp_z60": _z("rrp_balance", 60), "reserves_yoy": _p("reserve_balances", 252), "reserves_z60": _z("reserve_balances", 60), "m2_yoy": _p("m2", 12)}
_liq_digits = " ".join(f"{c}:9" if c == "rrp_balance_bn" else f"{c}:4" if "change" in c and "pct" not in c else c for c in _liq)


@query("macro_liquidity", _select(_liq | {"vix_regime": _BINS.format(x="vix")}), "v_macro", _liq_digits, "date")
def macro_liquidity(spark, sf):
    return macro.liquidity_features(_daily(spark, sf), MACRO_DAYS).select("date", *_liq, "vix_regime")


@query("vix_bins", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_BINS.format(x='l_quantity')} AS vix_regime FROM lineitem")
def vix_bins(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        right_closed_bin(F.col("l_quantity"), macro.VIX_EDGES).alias("vix_regime"),
    )


_STRESS = f"0.30 * {_z('ted_spread', 60)} + 0.25 * {_z('vix', 20)} + 0.30 * {_z('hy_oas', 60)} + 0.15 * {_d('rrp_balance', 5)}"
_QUALITY = f"-(0.40 * {_z('ig_oas', 60)} + 0.30 * curve_level + 0.30 * {_z('vix', 20)})"
_INDEX = _select({"funding_stress_index": _STRESS, "collateral_quality_index": _QUALITY}, f"({_CURVE})")


def _features(spark, sf):
    d = macro.curve_shape(_daily(spark, sf), MACRO_DAYS)
    return macro.composites(macro.liquidity_features(macro.spread_features(d, MACRO_DAYS), MACRO_DAYS))


@query("stress_index", _INDEX, "v_macro", "funding_stress_index:4 collateral_quality_index", "date")
def stress_index(spark, sf):
    return _features(spark, sf).select("date", "funding_stress_index", "collateral_quality_index")


_moms = ["curve_10y2y", "curve_10y3m", *macro.SPREADS, "vix"]
_MOM_SRC = "SELECT date, " + ", ".join(f"{_d(c, 5)} AS m_{c}" for c in _moms) + f" FROM ({_CURVE})"
_MOMENTUM = (
    "SELECT date, (" + " + ".join(f"coalesce(m_{c}, 0)" for c in _moms) + ") / nullif("
    + " + ".join(f"(m_{c} IS NOT NULL)::INT" for c in _moms) + f", 0) AS macro_momentum FROM ({_MOM_SRC})"
)


@query("macro_momentum", _MOMENTUM, "v_macro", "macro_momentum", "date")
def macro_momentum(spark, sf):
    return _features(spark, sf).select("date", "macro_momentum")


@query(
    "finite_rows",
    "SELECT * FROM (" + _select({"reserves_yoy": _p("reserve_balances", 252), "vix_z60": _z("vix", 60)}) + ") WHERE reserves_yoy IS NOT NULL OR vix_z60 IS NOT NULL",
    "v_macro",
    "reserves_yoy vix_z60",
    "date",
)
def finite_rows(spark, sf):
    d = macro.liquidity_features(_daily(spark, sf), MACRO_DAYS).select("date", "reserves_yoy", "vix_z60")
    return macro.finite_rows(d)


_ISLANDS = f"""SELECT *, sum(CASE WHEN f = p THEN 0 ELSE 1 END) OVER {O} AS island FROM
  (SELECT *, lag(f) OVER {O} AS p FROM (SELECT *, CASE WHEN t_10yr - t_2yr < 0 THEN 1 ELSE 0 END AS f FROM v_macro))"""


@query(
    "days_since_inversion",
    f"SELECT date, f AS curve_10y2y_inverted, CAST((row_number() OVER (PARTITION BY island ORDER BY date) - 1) * f AS INTEGER) AS days_since_inversion FROM ({_ISLANDS})",
    "v_macro",
    "",
    "date",
)
def days_since_inversion(spark, sf):
    d = macro.curve_shape(_daily(spark, sf), MACRO_DAYS)
    out = macro.run_length(d, MACRO_DAYS, "curve_10y2y_inverted", "days_since_inversion")
    return out.select("date", "curve_10y2y_inverted", "days_since_inversion")


_LABEL = """CASE WHEN vix > 27 THEN 'Stress / Crisis' WHEN t_10yr - t_2yr < 0 THEN 'Late Cycle / Inversion'
  WHEN sofr > 5 THEN 'Hiking Cycle' ELSE 'Neutral / Normal' END"""
_LABELLED = f"SELECT *, {_LABEL} AS regime_label FROM v_macro"


def _labelled(spark, sf):
    return _daily(spark, sf).withColumn("regime_label", F.expr(_LABEL))


@query(
    "regime_segments",
    f"""SELECT regime_label, min(date) AS start_date, max(date) AS end_date, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN regime_label = p THEN 0 ELSE 1 END) OVER {O} AS segment FROM
        (SELECT *, lag(regime_label) OVER {O} AS p FROM ({_LABELLED}))) GROUP BY segment, regime_label""",
    "v_macro",
    "",
    "start_date end_date",
)
def regime_segments(spark, sf):
    out = macro.segments(_labelled(spark, sf), MACRO_DAYS, "regime_label")
    return out.select("regime_label", "start_date", "end_date", "n")


@query(
    "transition_matrix",
    f"""SELECT from_label, to_label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY from_label) AS p FROM
        (SELECT regime_label AS from_label, lead(regime_label) OVER {O} AS to_label FROM ({_LABELLED}))
        WHERE to_label IS NOT NULL GROUP BY 1, 2""",
    "v_macro",
    "p",
)
def transition_matrix(spark, sf):
    return macro.transition_matrix(_labelled(spark, sf), MACRO_DAYS, "regime_label")


_CHANGES = f"""SELECT date, p AS from_regime, regime_label AS to_regime,
  CASE WHEN regime_label = 'Stress / Crisis' THEN 'CRITICAL' ELSE 'WARNING' END AS severity
  FROM (SELECT *, lag(regime_label) OVER {O} AS p FROM ({_LABELLED})) WHERE p <> regime_label"""


@query("regime_change_alerts", _CHANGES, "v_macro", "", "date")
def regime_change_alerts(spark, sf):
    return macro.regime_change_alerts(_labelled(spark, sf), MACRO_DAYS, "regime_label")


@query("min_severity", f"SELECT * FROM ({_CHANGES}) WHERE severity = 'CRITICAL'", "v_macro", "", "date")
def min_severity(spark, sf):
    return macro.at_least(macro.regime_change_alerts(_labelled(spark, sf), MACRO_DAYS, "regime_label"), "CRITICAL")


_SPIKE = "SELECT date, '{t}' AS target, {z} AS z_score FROM v_macro"
_SPIKES = " UNION ALL ".join(_SPIKE.format(t=t.upper(), z=_z(t, 60)) for t in ("hy_oas", "ig_oas", "sofr"))


@query(
    "spread_spike_alerts",
    f"SELECT *, CASE WHEN abs(z_score) > 3 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM ({_SPIKES}) WHERE abs(z_score) > 2",
    "v_macro",
    "z_score",
    "date",
)
def spread_spike_alerts(spark, sf):
    d = macro.level_features(_daily(spark, sf), MACRO_DAYS, windows=(60,), columns=("sofr",))
    d = macro.spread_features(d, MACRO_DAYS, windows=(60,))
    return macro.spread_spike_alerts(d, {"hy_oas_z60": "HY_OAS", "ig_oas_z60": "IG_OAS", "sofr_z60": "SOFR"})


_FILLED = ["sofr", "vix"]
_BDAYS = """SELECT d.date, m.* EXCLUDE (date) FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM v_macro), (SELECT max(date) FROM v_macro),
  INTERVAL 1 DAY)) AS DATE) AS date) d LEFT JOIN v_macro m ON m.date = d.date WHERE isodow(d.date) <= 5"""


@query("bday_reindex", f"SELECT date, sofr, vix FROM ({_BDAYS})", "v_macro", "sofr vix", "date")
def bday_reindex(spark, sf):
    return macro.business_days(_daily(spark, sf).select("date", *_FILLED))


_SPARSE = "SELECT date, CASE WHEN day(date) % 9 < 2 THEN sofr END AS sofr, CASE WHEN day(date) % 4 = 0 THEN vix END AS vix FROM v_macro"


@query(
    "ffill_limit",
    f"""SELECT date, last_value(sofr IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sofr,
        last_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS vix FROM ({_SPARSE})""",
    "v_macro",
    "sofr vix",
    "date",
)
def ffill_limit(spark, sf):
    day = F.dayofmonth("date")
    sparse = _daily(spark, sf).select(
        "date", F.when(day % 9 < 2, F.col("sofr")).alias("sofr"), F.when(day % 4 == 0, F.col("vix")).alias("vix")
    )
    return macro.forward_fill(sparse, MACRO_DAYS, _FILLED)


@query(
    "weekly_last",
    """SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS week, max_by(sofr, date) FILTER (WHERE sofr IS NOT NULL) AS sofr,
       max_by(vix, date) FILTER (WHERE vix IS NOT NULL) AS vix FROM v_macro GROUP BY 1""",
    "v_macro",
    "sofr vix",
    "week",
)
def weekly_last(spark, sf):
    return macro.weekly_last(_daily(spark, sf), _FILLED)


@query(
    "calendar_heatmap",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(weekofyear(o_orderdate) AS INTEGER) AS week,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3""",
    "",
    "value:4",
)
def calendar_heatmap(spark, sf):
    return macro.calendar_heatmap(views.table(spark, sf, "orders"), "o_totalprice", "o_orderdate")


@query("tail_n", "SELECT date, sofr, vix FROM v_macro ORDER BY date DESC LIMIT 120", "v_macro", "sofr vix", "date")
def tail_n(spark, sf):
    return latest_rows(_daily(spark, sf), MACRO_DAYS, 120).select("date", "sofr", "vix")


_corr = ["sofr", "hy_oas", "ig_oas", "vix", "t_10yr"]


@query(
    "corr_matrix_tail",
    "WITH t AS (SELECT * FROM v_macro ORDER BY date DESC LIMIT 252) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM t" for a in _corr for b in _corr),
    "v_macro",
    "corr",
)
def corr_matrix_tail(spark, sf):
    return macro.correlation_tail(_daily(spark, sf), _corr, 252)


_LAST365 = "(ORDER BY date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND CURRENT ROW)"


@query(
    "dax_days_inverted",
    f"SELECT date, CAST(sum(CASE WHEN t_10yr - t_2yr < 0 THEN 1 ELSE 0 END) OVER {_LAST365.format(n=364)} AS BIGINT) AS days_inverted FROM v_macro",
    "v_macro",
    "",
    "date",
)
def dax_days_inverted(spark, sf):
    return macro.days_inverted(macro.curve_shape(_daily(spark, sf), MACRO_DAYS), MACRO_DAYS).select("date", "days_inverted")


_W252 = _LAST365.format(n=251)


@query(
    "dax_hy_spike",
    f"SELECT date, CASE WHEN hy_oas > avg(hy_oas) OVER {_W252} + 2 * stddev_pop(hy_oas) OVER {_W252} THEN 'SPIKE' ELSE 'NORMAL' END AS alert_flag FROM v_macro",
    "v_macro",
    "",
    "date",
)
def dax_hy_spike(spark, sf):
    return macro.spike_flag(_daily(spark, sf), MACRO_DAYS, "hy_oas").select("date", "alert_flag")


@query(
    "dax_stress_level",
    f"""SELECT date, CASE WHEN x >= 2 THEN 'CRITICAL' WHEN x >= 1 THEN 'ELEVATED' WHEN x >= 0 THEN 'NORMAL' ELSE 'LOW' END AS stress_level
        FROM (SELECT date, {_z('vix', 20)} AS x FROM v_macro)""",
    "v_macro",
    "",
    "date",
)
def dax_stress_level(spark, sf):
    d = macro.liquidity_features(_daily(spark, sf), MACRO_DAYS)
    return d.select("date", macro.stress_level(F.col("vix_z20")).alias("stress_level"))


@query(
    "dax_current_regime",
    f"SELECT max_by(regime_label, date) AS current_regime, max(date) AS date FROM ({_LABELLED})",
    "v_macro",
    "",
    "date",
)
def dax_current_regime(spark, sf):
    return _labelled(spark, sf).agg(F.max_by("regime_label", "date").alias("current_regime"), F.max("date").alias("date"))


_TARGETS = ["sofr", "hy_oas", "ig_oas"]


def _wide_forecasts(spark, sf):
    """Forecasts that drift from the level towards its 20-day mean with the horizon."""
    d = macro.level_features(_daily(spark, sf), MACRO_DAYS, windows=(20,), columns=tuple(_TARGETS))
    return d.withColumns(
        {
            f"{t}_{h}d": F.col(t) + (F.col(f"{t}_ma20") - F.col(t)) * (h / 20)
            for t in _TARGETS
            for h in (1, 3, 5, 10)
        }
    )


_FORECASTS = " UNION ALL ".join(
    f"""SELECT date, '{t}' AS target, CAST({h} AS INTEGER) AS horizon_days, {t} + ({_roll('avg', t, 20)} - {t}) * ({h} / 20.0) AS forecast,
    date - CAST(isodow(date) - 1 - least(isodow(date) - 1, 4) AS INTEGER) + CAST({h} + 2 * ((least(isodow(date) - 1, 4) + {h}) // 5) AS INTEGER) AS forecast_date
    FROM v_macro"""
    for t in _TARGETS
    for h in (1, 3, 5, 10)
)


@query("spread_forecast_long", _FORECASTS, "v_macro", "forecast", "date forecast_date")
def spread_forecast_long(spark, sf):
    return macro.spread_forecasts(_wide_forecasts(spark, sf), _TARGETS)


@query(
    "dax_sofr_delta",
    f"""SELECT (max_by(forecast, date) - (SELECT max_by(sofr, date) FROM v_macro)) * 100 AS delta_bps
        FROM ({_FORECASTS}) WHERE target = 'sofr' AND horizon_days = 5""",
    "v_macro",
    "delta_bps",
)
def dax_sofr_delta(spark, sf):
    d = _wide_forecasts(spark, sf)
    return d.agg(((F.max_by("sofr_5d", "date") - F.max_by("sofr", "date")) * 100).alias("delta_bps"))


@query(
    "forecast_timeline",
    f"""SELECT date, vix AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, 'history' AS kind
        FROM (SELECT * FROM v_macro ORDER BY date DESC LIMIT 120)
        UNION ALL SELECT l - CAST(isodow(l) - 1 - least(isodow(l) - 1, 4) AS INTEGER) + CAST(h + 2 * ((least(isodow(l) - 1, 4) + h) // 5) AS INTEGER),
          m, m - 1.645 * s, m + 1.645 * s, 'forecast'
        FROM (SELECT max(date) AS l, avg(vix) AS m, stddev_samp(vix) AS s FROM v_macro), (VALUES (1), (3), (5), (10)) x(h)""",
    "v_macro",
    "value lower upper",
    "date",
)
def forecast_timeline(spark, sf):
    history = _daily(spark, sf)
    m, s = F.avg("vix"), F.stddev_samp("vix")
    one = history.agg(m.alias("value"), (m - 1.645 * s).alias("lower"), (m + 1.645 * s).alias("upper"))
    ahead = one.select("*", F.explode(F.array(*[F.lit(h) for h in (1, 3, 5, 10)])).alias("horizon_days"))
    return macro.forecast_timeline(history, ahead, MACRO_DAYS, "vix")


_drivers = [f"{c}_z60" for c in macro.SPREADS]
_DRIVERS = ", ".join(f"{{'s': -abs({_z(c, 60)}), 'name': '{c}_z60', 'value': {_z(c, 60)}}}" for c in macro.SPREADS)


@query(
    "row_drivers",
    "SELECT date, " + ", ".join(f"d[{i}].name AS driver_{i}, d[{i}].value AS value_{i}" for i in (1, 2, 3))
    + f" FROM (SELECT date, list_sort(list_filter([{_DRIVERS}], lambda x: x.value IS NOT NULL)) AS d FROM v_macro)",
    "v_macro",
    "value_1 value_2 value_3",
    "date",
)
def row_drivers(spark, sf):
    return macro.row_drivers(macro.spread_features(_daily(spark, sf), MACRO_DAYS), ["date"], _drivers)


_feat = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(
    "top_features",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs({c})) AS importance FROM lineitem" for c in _feat)
    + ") ORDER BY importance DESC LIMIT 3",
    "",
    "importance",
)
def top_features(spark, sf):
    return macro.top_features(views.table(spark, sf, "lineitem"), _feat, 3)


@query(
    "importance_mean",
    "SELECT feature, avg(importance) AS importance FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS importance FROM lineitem WHERE l_returnflag = '{f}'"
        for c in _feat
        for f in "ANR"
    )
    + ") GROUP BY 1",
    "",
    "importance",
)
def importance_mean(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    tables = []
    for flag in "ANR":
        one = lines.where(F.col("l_returnflag") == flag).agg(
            *[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in _feat]
        )
        tables.append(macro.unpivot(one, [], {c: c for c in _feat}, "feature", "importance"))
    return macro.importance_mean(tables)


_CONTRIB = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS driver,
  avg(o_totalprice) / 100000 - 2.5 AS contribution FROM orders GROUP BY 1, 2"""


@query(
    "contribution_waterfall",
    f"""SELECT month, driver, contribution, CAST(row_number() OVER w AS INTEGER) AS step, 100 + sum(contribution) OVER
        (PARTITION BY month ORDER BY abs(contribution), driver ROWS UNBOUNDED PRECEDING) AS running_total
        FROM ({_CONTRIB}) WINDOW w AS (PARTITION BY month ORDER BY abs(contribution), driver)""",
    "",
    "contribution running_total",
    "month",
)
def contribution_waterfall(spark, sf):
    contributions = (
        views.table(spark, sf, "orders")
        .groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.col("o_orderpriority").alias("driver"))
        .agg((F.avg("o_totalprice") / 100000 - 2.5).alias("contribution"))
    )
    return macro.waterfall(contributions, ["month"], "driver", "contribution", 100.0)


_PLAY = ", ".join(f"('{k}', '{v}')" for k, v in macro.PLAYBOOK.items())


@query(
    "regime_action",
    f"SELECT date, regime_label, action FROM ({_LABELLED}) LEFT JOIN (VALUES {_PLAY}) p(regime_label, action) USING (regime_label)",
    "v_macro",
    "",
    "date",
)
def regime_action(spark, sf):
    return macro.regime_action(_labelled(spark, sf), "regime_label").select("date", "regime_label", "action")


@query(
    "regime_conflict",
    f"""SELECT date, CASE WHEN ({_LABEL}) <> b THEN 1 ELSE 0 END AS ensemble_conflict FROM
        (SELECT *, CASE WHEN vix > 26.5 THEN 'Stress / Crisis' WHEN t_10yr - t_2yr < 0.1 THEN 'Late Cycle / Inversion'
         WHEN sofr > 5 THEN 'Hiking Cycle' ELSE 'Neutral / Normal' END AS b FROM v_macro)""",
    "v_macro",
    "",
    "date",
)
def regime_conflict(spark, sf):
    from ..operators.regimes import conflicts

    other = _daily(spark, sf).select(
        "date", F.expr(_LABEL.replace("vix > 27", "vix > 26.5").replace("< 0 ", "< 0.1 ")).alias("regime_label")
    )
    return conflicts(_labelled(spark, sf).select("date", "regime_label"), other, "date", "regime_label")
