"""Quantile forecasts of demand and spreads, and how often they hold on rows left out."""

from pyspark.sql import functions as F

from ..functions.rolling import Rolling
from ..operators import demand, financing, quantile_forest
from ..operators.series import over_history
from ..session import lineage_cut
from ..sources import views
from ..sources.views import MACRO_DAYS, Series
from .registry import query
from .sqltext import Windowed

LOANS = Series(("ticker",), ("date", "order_id", "line_no", "counterparty_id"), "day")
PANEL_KEY = ["ticker", "order_id", "line_no", "counterparty_id"]
HORIZONS = (1, 3, 5, 10)
WINDOWS = (5, 10, 20, 60)
DEMAND_ALPHA, SPREAD_ALPHA = 0.6, 0.7
DEMAND_TARGETS = [f"target_{h}d" for h in HORIZONS]
WINDOWED = ("vol_rolling_mean", "vol_rolling_std", "rate_rolling_mean", "rate_z")
DEMAND_INPUTS = ["borrow_volume", "borrow_rate", "vol_mom_1d", "vol_mom_5d", *(f"{c}_{n}d" for c in WINDOWED for n in WINDOWS)]
# Three folds of five to learn from, one to see how far forecasts are off, one left out.
_FOLD = "(order_id * 7 + line_no) % 5"
_BIN = "CASE WHEN {cv} < 0.4 THEN 0 WHEN {cv} < 0.55 THEN 1 WHEN {cv} < 0.7 THEN 2 ELSE 3 END"


def _demand(spark, sf):
    """Loans with all windows; a window without enough rows yet has the value of the next shorter one."""
    book = demand.demand_features(views.loans(spark, sf), LOANS, windows=WINDOWS)
    book = financing.horizon_targets(book, LOANS, "borrow_volume", horizons=HORIZONS)
    for short, long in zip(WINDOWS, WINDOWS[1:]):
        book = book.withColumns({f"{c}_{long}d": F.coalesce(f"{c}_{long}d", f"{c}_{short}d") for c in WINDOWED})
    volatility = F.expr(_BIN.format(cv="vol_rolling_std_5d / vol_rolling_mean_5d"))
    book = book.withColumns({"fold": F.expr(_FOLD), "volatility_bin": volatility})
    return lineage_cut(book.select(*PANEL_KEY, "fold", "volatility_bin", *DEMAND_INPUTS, *DEMAND_TARGETS), "demand")


def _demand_forest(book):
    return quantile_forest.fit(
        book.where("fold < 3"), DEMAND_INPUTS, DEMAND_TARGETS, DEMAND_ALPHA, book.where("fold = 3"), "volatility_bin", floor=0.0
    )


@query("quantile_forecast")
def quantile_forecast(spark, sf):
    """The 0.6 quantile of a ticker's borrow volume 1, 3, 5 and 10 loans ahead, never below zero."""
    book = _demand(spark, sf)
    out = _demand_forest(book).predict(book)
    ahead = [F.col(f"target_{h}d_q").alias(f"demand_forecast_{h}d") for h in HORIZONS[1:]]
    return out.select(*PANEL_KEY, *DEMAND_TARGETS, F.col("target_1d_q").alias("demand_forecast"), *ahead)


_W = Windowed("ticker", "date, order_id, line_no, counterparty_id")
_HELD_OUT = f"""SELECT output, {_BIN.format(cv='(sd / mean)')} AS volatility_bin, count(*) AS n, true AS covered
  FROM (SELECT {_W.roll('stddev_samp', 'borrow_volume', 5)} AS sd, {_W.roll('avg', 'borrow_volume', 5)} AS mean,
      {_W.diff('borrow_volume', 5)} AS moved, {_FOLD} AS fold,
      unnest([{', '.join(f"{{'output': 'target_{h}d', 'y': {_W.lead('borrow_volume', h)}}}" for h in HORIZONS)}], recursive := true)
    FROM v_loan)
  WHERE y IS NOT NULL AND sd IS NOT NULL AND moved IS NOT NULL AND fold = 4 GROUP BY ALL"""


@query("quantile_coverage", _HELD_OUT, "v_loan")
def quantile_coverage(spark, sf):
    """Loans left out: by horizon and volatility, whether 0.6 of them lie below their forecast."""
    book = _demand(spark, sf)
    out = _demand_forest(book).predict(book.where("fold = 4"))
    found = quantile_forest.coverage(out, DEMAND_TARGETS, DEMAND_ALPHA, F.col("volatility_bin"), "volatility_bin")
    return found.select("output", "volatility_bin", "n", "covered")


SPREADS = ("sofr", "hy_oas", "ig_oas")
LEVELS = (*SPREADS, "vix")
SPREAD_TARGETS = [f"{c}_{h}d" for c in SPREADS for h in HORIZONS]
SPREAD_INPUTS = [f"{c}{x}" for c in LEVELS for x in ("", "_mom1d", "_mom5d", "_mean5d", "_mean20d", "_std20d")]


def _spreads(spark, sf):
    days = views.macro(spark, sf).select("date", *LEVELS)

    def compute(d, w):
        r, new = Rolling(w), {}
        for c in LEVELS:
            new |= {f"{c}_mom1d": r.diff(c, 1), f"{c}_mom5d": r.diff(c, 5), f"{c}_mean5d": r.mean(c, 5), f"{c}_mean20d": r.mean(c, 20), f"{c}_std20d": r.sd(c, 20)}
        return r.add(d, new)

    days = over_history(days, MACRO_DAYS, compute, depth=19)
    for c in SPREADS:
        days = financing.horizon_targets(days, MACRO_DAYS, c, horizons=HORIZONS)
        days = days.withColumnsRenamed({f"target_{h}d": f"{c}_{h}d" for h in HORIZONS})
    # Days are a calendar's worth of rows: dealt by their number.
    return lineage_cut(days.withColumn("fold", F.pmod(F.unix_date("date") * 7, F.lit(11)) % 5), "spreads")


_D = Windowed("1", "date")
_SPREAD_ROWS = f"""SELECT output, count(*) AS n, true AS covered FROM (SELECT date, datediff('day', DATE '1970-01-01', date) * 7 % 11 % 5 AS fold,
    {' AND '.join(f"{c} IS NOT NULL AND {_D.diff(c)} IS NOT NULL AND {_D.diff(c, 5)} IS NOT NULL AND count({c}) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 AND count({c}) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5" for c in LEVELS)} AS whole,
    unnest([{', '.join(f"{{'output': '{c}_{h}d', 'y': {_D.lead(c, h)}}}" for c in SPREADS for h in HORIZONS)}], recursive := true) FROM v_macro)
  WHERE y IS NOT NULL AND whole AND fold = 4 GROUP BY ALL"""


@query("spread_coverage", _SPREAD_ROWS, "v_macro")
def spread_coverage(spark, sf):
    """Spreads 1, 3, 5 and 10 days ahead: whether 0.7 of the days left out lie below their forecast."""
    days = _spreads(spark, sf)
    fitted = quantile_forest.fit(days.where("fold < 3"), SPREAD_INPUTS, SPREAD_TARGETS, SPREAD_ALPHA, days.where("fold = 3"))
    out = fitted.predict(days.where("fold = 4"))
    return quantile_forest.coverage(out, SPREAD_TARGETS, SPREAD_ALPHA, F.lit(0), "all").select("output", "n", "covered")
