"""Portfolio exposure and concentration queries."""

from pyspark.sql import functions as F

from ..operators import exposure
from ..operators.sizes import broadcast_if_small
from ..session import lineage_cut
from ..sources import views
from ..sources.views import PORTFOLIO_SERIES
from .registry import query

G = "portfolio_id, date"
ORDER = ["order_id", "line_no", "isin", "counterparty"]


def _utilisation(spark, sf):
    used = views.loans(spark, sf).groupBy("counterparty_id").agg((F.sum("borrow_rate") * 10).alias("current_exposure"))
    joined = views.counterparties(spark, sf).join(used, "counterparty_id", "left")
    return exposure.credit_utilisation(joined)


_UTIL = """SELECT counterparty_id, credit_limit, current_exposure,
  CASE WHEN credit_limit > 0 THEN current_exposure / credit_limit END AS credit_utilisation
  FROM v_cp LEFT JOIN (SELECT counterparty_id, sum(borrow_rate) * 10 AS current_exposure FROM v_loan GROUP BY 1) u
  USING (counterparty_id)"""


@query("credit_utilisation", _UTIL, "v_cp v_loan", "credit_limit current_exposure credit_utilisation")
def credit_utilisation(spark, sf):
    return _utilisation(spark, sf).select("counterparty_id", "credit_limit", "current_exposure", "credit_utilisation")


def _exposed(spark, sf):
    used = _utilisation(spark, sf).select(F.col("counterparty_id").alias("counterparty"), "credit_utilisation")
    return (
        views.positions(spark, sf)
        .join(broadcast_if_small(used), "counterparty", "left")
        .withColumn("credit_utilisation", F.coalesce("credit_utilisation", F.lit(0.0)))
    )


_EXPOSED = f"""SELECT p.*, coalesce(u.credit_utilisation, 0) AS credit_utilisation FROM v_pos p
  LEFT JOIN ({_UTIL}) u ON u.counterparty_id = p.counterparty"""

_MARKET = """SELECT l_partkey AS isin, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, max(l_extendedprice) AS price,
  max(CASE WHEN l_linenumber > 2 THEN l_tax END) AS bid_ask_spread, max(CASE WHEN l_linenumber > 3 THEN l_discount END) AS volatility_30d
  FROM lineitem GROUP BY 1, 2"""


def _market(spark, sf):
    """Month-end market data per instrument; spread and volatility are missing in places."""
    return (
        views.table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("isin"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"))
        .agg(
            F.max("l_extendedprice").alias("price"),
            F.max(F.when(F.col("l_linenumber") > 2, F.col("l_tax"))).alias("bid_ask_spread"),
            F.max(F.when(F.col("l_linenumber") > 3, F.col("l_discount"))).alias("volatility_30d"),
        )
    )


def _bare(spark, sf):
    return views.positions(spark, sf).drop("bid_ask_spread", "volatility_30d")


_PKEY = "portfolio_id, isin, order_id, line_no, counterparty"
_pkey = _PKEY.split(", ")


@query(
    "exposure_join",
    f"SELECT {_PKEY}, market_value, credit_utilisation FROM ({_EXPOSED})",
    "v_pos v_cp v_loan",
    "market_value credit_utilisation",
)
def exposure_join(spark, sf):
    return _exposed(spark, sf).select(*_pkey, "market_value", "credit_utilisation")


@query(
    "latest_price_fill",
    f"""SELECT {', '.join('p.' + c for c in _pkey)},
        CASE WHEN m.price IS NULL THEN l.price ELSE m.price END AS price,
        CASE WHEN m.price IS NULL THEN l.bid_ask_spread ELSE m.bid_ask_spread END AS bid_ask_spread,
        CASE WHEN m.price IS NULL THEN l.volatility_30d ELSE m.volatility_30d END AS volatility_30d
        FROM v_pos p LEFT JOIN ({_MARKET}) m ON m.isin = p.isin AND m.date = p.date
        LEFT JOIN (SELECT isin, max_by(price, date) FILTER (WHERE price IS NOT NULL) AS price,
          max_by(bid_ask_spread, date) FILTER (WHERE bid_ask_spread IS NOT NULL) AS bid_ask_spread,
          max_by(volatility_30d, date) FILTER (WHERE volatility_30d IS NOT NULL) AS volatility_30d
          FROM ({_MARKET}) GROUP BY 1) l ON l.isin = p.isin""",
    "v_pos",
    "price bid_ask_spread volatility_30d",
)
def latest_price_fill(spark, sf):
    filled = exposure.latest_price_fill(
        _bare(spark, sf), _market(spark, sf), ["price", "bid_ask_spread", "volatility_30d"]
    )
    return filled.select(*_pkey, "price", "bid_ask_spread", "volatility_30d")


@query(
    "asof_fill",
    f"""SELECT {', '.join('p.' + c for c in _pkey)}, m.price AS asof_price
        FROM v_pos p ASOF LEFT JOIN ({_MARKET}) m ON m.isin = p.isin AND p.date >= m.date""",
    "v_pos",
    "asof_price",
)
def asof_fill(spark, sf):
    market = _market(spark, sf)
    return exposure.asof_fill(_bare(spark, sf), market, "price", "isin", "date", "order_id").select(*_pkey, "asof_price")


@query(
    "drop_invalid",
    f"SELECT {_PKEY} FROM v_pos WHERE isin IS NOT NULL AND counterparty IS NOT NULL AND (bid_ask_spread IS NULL OR bid_ask_spread > 0)",
    "v_pos",
)
def drop_invalid(spark, sf):
    valid = exposure.valid_positions(views.positions(spark, sf), ["isin", "counterparty"])
    return exposure.valid_prices(valid, "bid_ask_spread").select(*_pkey)


@query(
    "aum_weight",
    f"""SELECT {_PKEY}, date, portfolio_aum, CASE WHEN portfolio_aum > 0 THEN market_value / portfolio_aum ELSE 0 END AS aum_weight
        FROM v_pos JOIN (SELECT {G}, sum(market_value) AS portfolio_aum FROM v_pos GROUP BY ALL) USING ({G})""",
    "v_pos",
    "portfolio_aum:2 aum_weight:9",
    "date",
)
def aum_weight(spark, sf):
    return exposure.aum_weight(views.positions(spark, sf)).select(*_pkey, "date", "portfolio_aum", "aum_weight")


_HHI = f"""SELECT {G}, round(CASE WHEN sum(market_value) > 0 THEN sum(market_value * market_value) / pow(sum(market_value), 2)
  ELSE 0 END, 6) AS hhi_portfolio FROM v_pos GROUP BY {G}"""


@query("hhi", _HHI, "v_pos", "hhi_portfolio", "date")
def hhi(spark, sf):
    return exposure.hhi(views.positions(spark, sf))


_TOP5 = f"""SELECT {G}, round(CAST(100 AS DOUBLE) * sum(market_value) FILTER (WHERE rn <= 5) / sum(market_value), 4) AS top5_exposure_pct
  FROM (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY market_value DESC, order_id, line_no) AS rn FROM v_pos)
  GROUP BY {G}"""


@query("top_n_exposure", _TOP5, "v_pos", "top5_exposure_pct:4", "date")
def top_n_exposure(spark, sf):
    return exposure.top_n_exposure(views.positions(spark, sf), ORDER)


def _conc(by, hhi_name, max_name, breach, limit):
    return f"""SELECT {G}, sum(w * w) AS {hhi_name}, max(w) AS {max_name},
      CASE WHEN max(w) * 100 > {limit} THEN 1 ELSE 0 END AS {breach}
      FROM (SELECT {G}, {by}, sum(market_value) / sum(sum(market_value)) OVER (PARTITION BY {G}) AS w
            FROM v_pos GROUP BY {G}, {by}) GROUP BY {G}"""


_SECTOR = _conc("sector", "hhi_sector", "max_sector_weight", "sector_limit_breach", 30)
_CPC = _conc("counterparty", "hhi_counterparty", "max_cp_weight", "cp_limit_breach", 20)


@query("sector_concentration", _SECTOR, "v_pos", "hhi_sector max_sector_weight", "date")
def sector_concentration(spark, sf):
    return exposure.sector_concentration(views.positions(spark, sf))


@query("counterparty_concentration", _CPC, "v_pos", "hhi_counterparty max_cp_weight", "date")
def counterparty_concentration(spark, sf):
    return exposure.counterparty_concentration(views.positions(spark, sf))


_LIQ = f"""SELECT {G}, sum(market_value / coalesce(nullif(bid_ask_spread, 0), (SELECT median(bid_ask_spread) FROM v_pos)))
  AS liquidity_adjusted_exposure FROM v_pos GROUP BY {G}"""


@query("liquidity_adjusted", _LIQ, "v_pos", "liquidity_adjusted_exposure:3", "date")
def liquidity_adjusted(spark, sf):
    return exposure.liquidity_adjusted(views.positions(spark, sf))


@query(
    "var_proxy",
    f"""SELECT {G}, sum(CASE WHEN aum > 0 THEN market_value / aum ELSE 0 END * volatility_30d * 1.6449) AS portfolio_var_proxy
        FROM v_pos JOIN (SELECT {G}, sum(market_value) AS aum FROM v_pos GROUP BY ALL) USING ({G}) GROUP BY {G}""",
    "v_pos",
    "portfolio_var_proxy",
    "date",
)
def var_proxy(spark, sf):
    return exposure.var_proxy(exposure.aum_weight(views.positions(spark, sf)))


_BASE = f"""SELECT *, CASE WHEN hhi_portfolio > 0.25 THEN 1 ELSE 0 END AS hhi_breach,
  CASE WHEN top5_exposure_pct > 40 THEN 1 ELSE 0 END AS top5_breach FROM
  (SELECT {G}, sum(market_value) AS market_value, avg(volatility_30d) AS volatility_30d,
     avg(credit_utilisation) AS avg_credit_utilisation, max(credit_utilisation) AS max_credit_utilisation,
     sum(market_value * volatility_30d) / sum(market_value) * 1.6449 AS portfolio_var_proxy
   FROM ({_EXPOSED}) GROUP BY {G})
  JOIN ({_HHI}) USING ({G}) JOIN ({_SECTOR}) USING ({G}) JOIN ({_CPC}) USING ({G}) JOIN ({_LIQ}) USING ({G})
  JOIN ({_TOP5}) USING ({G})"""
_CHANGE = ", ".join(
    f"coalesce({c} - lag({c}, 5) OVER (PARTITION BY portfolio_id ORDER BY date), 0) AS {n}"
    for c, n in exposure.CHANGES.items()
)
_ROLLUP = f"SELECT *, {_CHANGE} FROM ({_BASE})"
_FEATURE_DIGITS = (
    "hhi_portfolio hhi_sector hhi_counterparty top5_exposure_pct:4 max_sector_weight max_cp_weight "
    "liquidity_adjusted_exposure:3 portfolio_var_proxy avg_credit_utilisation max_credit_utilisation "
    "hhi_rolling_change top5_rolling_change:4 max_sector_rolling_change"
)
_FEATURES = ", ".join(exposure.RISK_FEATURES)


def rollup(spark, sf):
    return exposure.portfolio_rollup(_exposed(spark, sf), ORDER, PORTFOLIO_SERIES)


@query("portfolio_rollup", f"SELECT {G}, market_value, {_FEATURES} FROM ({_ROLLUP})", "v_pos v_cp v_loan",
       "market_value:2 " + _FEATURE_DIGITS, "date")
def portfolio_rollup(spark, sf):
    return rollup(spark, sf).select("portfolio_id", "date", "market_value", *exposure.RISK_FEATURES)


def _summary(spark, sf):
    # Three features read the positions; the joins behind them run once.
    rows = lineage_cut(views.positions(spark, sf).select("portfolio_id", "date", "sector", "market_value", *ORDER), "positions")
    base = exposure.hhi(rows)
    for part in (exposure.top_n_exposure(rows, ORDER), exposure.sector_concentration(rows)):
        base = base.join(part, ["portfolio_id", "date"])
    return base


_SUMMARY = f"SELECT * FROM ({_HHI}) JOIN ({_TOP5}) USING ({G}) JOIN ({_SECTOR}) USING ({G})"


@query(
    "exposure_change",
    f"SELECT {G}, {', '.join(exposure.CHANGES.values())} FROM (SELECT *, {_CHANGE} FROM ({_SUMMARY}))",
    "v_pos",
    "hhi_rolling_change top5_rolling_change:4 max_sector_rolling_change",
    "date",
)
def exposure_change(spark, sf):
    out = exposure.exposure_change(_summary(spark, sf), PORTFOLIO_SERIES, exposure.CHANGES)
    return out.select("portfolio_id", "date", *exposure.CHANGES.values())


@query(
    "breach_flags",
    f"""SELECT {G}, CASE WHEN hhi_portfolio > 0.02 THEN 1 ELSE 0 END AS hhi_breach,
        CASE WHEN top5_exposure_pct > 25 THEN 1 ELSE 0 END AS top5_breach FROM ({_SUMMARY})""",
    "v_pos",
    "",
    "date",
)
def breach_flags(spark, sf):
    out = exposure.breach_flags(_summary(spark, sf), hhi_limit=0.02, top_limit=25.0)
    return out.select("portfolio_id", "date", "hhi_breach", "top5_breach")


@query(
    "risk_level",
    f"""SELECT {G}, CASE WHEN s >= 0.85 THEN 'CRITICAL' WHEN s >= 0.60 THEN 'HIGH' WHEN s >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
        s >= 0.60 AS alert_flag FROM (SELECT *, least(top5_exposure_pct / 50, 1) AS s FROM ({_TOP5}))""",
    "v_pos",
    "",
    "date",
)
def risk_level(spark, sf):
    top = exposure.top_n_exposure(views.positions(spark, sf), ORDER)
    scored = top.withColumn("concentration_score", F.least(F.col("top5_exposure_pct") / 50, F.lit(1.0)))
    return exposure.risk_alerts(scored, "concentration_score").select("portfolio_id", "date", "risk_level", "alert_flag")


@query(
    "portfolio_messages",
    f"""SELECT {G}, printf('%s: portfolio %s scores %.3f, driven by %s',
          CASE WHEN s >= 0.85 THEN 'CRITICAL' WHEN s >= 0.60 THEN 'HIGH' WHEN s >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END,
          CAST(portfolio_id AS VARCHAR), s + 1e-9, drivers) AS message
        FROM (SELECT {G}, CAST(least(top5_exposure_pct / 50, 1) AS DOUBLE) AS s, (SELECT string_agg(n, ', ' ORDER BY v DESC, n) FROM
          (VALUES ('hhi_portfolio', CAST(hhi_portfolio AS DOUBLE)), ('max_sector_weight', CAST(max_sector_weight AS DOUBLE)),
          ('top5_exposure_pct', top5_exposure_pct / 100.0)) t(n, v)) AS drivers FROM ({_SUMMARY}))""",
    "v_pos",
    "",
    "date",
)
def portfolio_messages(spark, sf):
    table = _summary(spark, sf).withColumn("score", F.least(F.col("top5_exposure_pct") / 50, F.lit(1.0)))
    scored = exposure.risk_alerts(table, "score").withColumn("top5_exposure_pct", F.col("top5_exposure_pct") / 100)
    message = exposure.portfolio_message("score", ["hhi_portfolio", "max_sector_weight", "top5_exposure_pct"])
    return scored.select("portfolio_id", "date", message.alias("message"))


@query(
    "align_features",
    f"SELECT {G}, max_sector_weight, CAST(0 AS DOUBLE) AS settlement_lag, hhi_sector FROM ({_SECTOR})",
    "v_pos",
    "max_sector_weight settlement_lag hhi_sector",
    "date",
)
def align_features(spark, sf):
    table = exposure.sector_concentration(views.positions(spark, sf))
    return exposure.align_features(table, ["max_sector_weight", "settlement_lag", "hhi_sector"], ["portfolio_id", "date"])


@query(
    "fill_numeric",
    f"SELECT isin, date, coalesce(price, 0) AS price, coalesce(bid_ask_spread, 0) AS bid_ask_spread, coalesce(volatility_30d, 0) AS volatility_30d FROM ({_MARKET})",
    "",
    "price bid_ask_spread volatility_30d",
    "date",
)
def fill_numeric(spark, sf):
    return exposure.fill_numeric(_market(spark, sf))
