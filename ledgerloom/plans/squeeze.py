"""Short-squeeze queries."""

from pyspark.sql import functions as F

from ..operators import squeeze
from ..sources import views
from ..sources.views import PANEL_SERIES
from .registry import query
from .sqltext import Windowed

W = Windowed("ticker", "date, order_id, line_no, counterparty_id")
KEY = ["ticker", "order_id", "line_no", "counterparty_id"]
K = ", ".join(KEY)


def _cols(exprs: dict[str, str], src: str = "v_panel") -> str:
    return f"SELECT {K}, " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {src}"


@query(
    "days_to_cover",
    _cols({"days_to_cover": f"shares_short / nullif({W.roll('avg', 'volume', 20, 1)}, 0)"}),
    "v_panel",
    "days_to_cover",
)
def days_to_cover(spark, sf):
    return squeeze.days_to_cover(views.panel(spark, sf), PANEL_SERIES).select(*KEY, "days_to_cover")


@query("utilization_change", _cols({"utilization_change": W.diff("utilization_rate")}), "v_panel", "utilization_change")
def utilization_change(spark, sf):
    out = squeeze.change(views.panel(spark, sf), PANEL_SERIES, "utilization_rate", "utilization_change")
    return out.select(*KEY, "utilization_change")


_si = {f"si_ratio_momentum_{n}": W.pct("short_interest_ratio", n) for n in (5, 10, 20)}
_px = {f"price_momentum_{n}": W.pct("close", n) for n in (5, 10, 20)}
_vr = {f"volume_ratio_{n}": f"volume / nullif({W.roll('avg', 'volume', n, 1)}, 0)" for n in (10, 20)}


@query("si_momentum", _cols(_si), "v_panel", " ".join(_si))
def si_momentum(spark, sf):
    out = squeeze.momentum(views.panel(spark, sf), PANEL_SERIES, "short_interest_ratio", "si_ratio_momentum")
    return out.select(*KEY, *_si)


@query("price_momentum", _cols(_px), "v_panel", " ".join(_px))
def price_momentum(spark, sf):
    return squeeze.momentum(views.panel(spark, sf), PANEL_SERIES, "close", "price_momentum").select(*KEY, *_px)


@query("volume_ratio", _cols(_vr), "v_panel", " ".join(_vr))
def volume_ratio(spark, sf):
    return squeeze.volume_ratio(views.panel(spark, sf), PANEL_SERIES).select(*KEY, *_vr)


@query("borrow_zscore", _cols({"borrow_rate_zscore": W.z("borrow_rate", 20, 2)}), "v_panel", "borrow_rate_zscore")
def borrow_zscore(spark, sf):
    return squeeze.borrow_zscore(views.panel(spark, sf), PANEL_SERIES).select(*KEY, "borrow_rate_zscore")


_RSI = f"""WITH RECURSIVE steps AS (
  SELECT {K}, row_number() OVER {W.w} AS n, {W.diff('close')} AS d FROM ({views.SQL['v_panel']}) p),
walk AS (
  SELECT *, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM steps WHERE n = 1
  UNION ALL
  SELECT s.*, w.up * 13 / 14 + greatest(s.d, 0) / 14, w.down * 13 / 14 + greatest(-s.d, 0) / 14
  FROM walk w JOIN steps s ON s.ticker = w.ticker AND s.n = w.n + 1)
SELECT {K}, CASE WHEN n >= 14 THEN CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) ELSE 100 END END AS rsi_14
FROM walk"""


@query("rsi_14", _RSI, "", "rsi_14")
def rsi_14(spark, sf):
    return squeeze.rsi(views.panel(spark, sf), PANEL_SERIES).select(*KEY, "rsi_14")


_TIER = """CASE WHEN p >= 0.80 THEN 'CRITICAL' WHEN p >= 0.60 THEN 'HIGH'
  WHEN p >= 0.35 THEN 'ELEVATED' ELSE 'LOW' END"""
_PROB = f"SELECT *, utilization_rate * 10 AS p, {_TIER.replace('p >=', 'utilization_rate * 10 >=')} AS risk_tier FROM v_panel"


def _probable(spark, sf):
    return views.panel(spark, sf).withColumn("squeeze_probability", F.col("utilization_rate") * 10)


@query("squeeze_tier", f"SELECT {K}, risk_tier FROM ({_PROB})", "v_panel")
def squeeze_tier(spark, sf):
    tier = squeeze.squeeze_tier(F.col("squeeze_probability")).alias("risk_tier")
    return _probable(spark, sf).select(*KEY, tier)


@query(
    "alerts_ranked",
    f"""SELECT {K}, risk_tier, p AS squeeze_probability FROM ({_PROB})
        WHERE risk_tier IN ('HIGH', 'CRITICAL') ORDER BY p DESC, {K}""",
    "v_panel",
    "squeeze_probability",
)
def alerts_ranked(spark, sf):
    scored = squeeze.days_to_cover(_probable(spark, sf), PANEL_SERIES)
    alerts = squeeze.squeeze_alerts(scored)
    ranked = squeeze.ranked_alerts(alerts, "squeeze_probability", KEY)
    return ranked.select(*KEY, "risk_tier", "squeeze_probability")


def _panels(spark, sf):
    lines = views.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ticker"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"),
        "l_returnflag", "l_discount", "l_tax", "l_extendedprice",
    )

    def monthly(flag, source, name):
        return lines.where(F.col("l_returnflag") == flag).groupBy("ticker", "date").agg(F.avg(source).alias(name))

    return (
        monthly("A", "l_discount", "short_interest_ratio"),
        monthly("N", "l_tax", "borrow_rate"),
        monthly("R", "l_extendedprice", "close"),
    )


def _panel_sql(flag, source, name):
    return f"""(SELECT l_partkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg({source}) AS {name}
      FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1, 2)"""


_A = _panel_sql("A", "l_discount", "short_interest_ratio")
_N = _panel_sql("N", "l_tax", "borrow_rate")
_R = _panel_sql("R", "l_extendedprice", "close")


@query(
    "panel_inner_join",
    f"""SELECT ticker, date, short_interest_ratio, borrow_rate, close
        FROM {_A} a JOIN {_N} n USING (ticker, date) JOIN {_R} r USING (ticker, date)""",
    "",
    "short_interest_ratio borrow_rate close:4",
    "date",
)
def panel_inner_join(spark, sf):
    return squeeze.join_panels(*_panels(spark, sf), ["ticker", "date"])


@query(
    "panel_join_loss",
    f"""SELECT count(*) AS entities_lost FROM (SELECT DISTINCT ticker FROM {_A} a WHERE ticker NOT IN
        (SELECT ticker FROM {_A} a JOIN {_N} n USING (ticker, date) JOIN {_R} r USING (ticker, date)))""",
)
def panel_join_loss(spark, sf):
    first, *others = _panels(spark, sf)
    return squeeze.join_loss(first, others, ["ticker", "date"], "ticker")
