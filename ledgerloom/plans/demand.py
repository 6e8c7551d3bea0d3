"""Loan demand and recall queries."""

from pyspark.sql import functions as F

from ..operators import demand
from ..sources import views
from ..sources.views import LOAN_SERIES, Series
from .registry import query
from .sqltext import Windowed

TICKER = Series(("ticker",), ("date", "order_id", "line_no", "counterparty_id"), "day")
W = Windowed("ticker", "date, order_id, line_no, counterparty_id")
KEY = ["ticker", "order_id", "line_no", "counterparty_id"]
K = ", ".join(KEY)

_cols = {}
for n in (5, 10, 20, 60):
    _cols[f"vol_rolling_mean_{n}d"] = W.roll("avg", "borrow_volume", n)
    _cols[f"vol_rolling_std_{n}d"] = W.roll("stddev_samp", "borrow_volume", n)
    _cols[f"rate_rolling_mean_{n}d"] = W.roll("avg", "borrow_rate", n)
    _cols[f"rate_dev_{n}d"] = (
        f"(borrow_rate - {W.roll('avg', 'borrow_rate', n)}) / ({W.roll('stddev_samp', 'borrow_rate', n)} + 1e-8)"
    )
_cols["vol_mom_1d"] = W.diff("borrow_volume")
_cols["vol_mom_5d"] = W.diff("borrow_volume", 5)
_named = {k.replace("rate_dev", "rate_z"): v for k, v in _cols.items()}


@query(
    "demand_features",
    f"SELECT {K}, " + ", ".join(f"{e} AS {n}" for n, e in _named.items()) + " FROM v_loan",
    "v_loan",
    " ".join(_named),
)
def demand_features(spark, sf):
    return demand.demand_features(views.loans(spark, sf), TICKER).select(*KEY, *_named)


_AHEAD = """(PARTITION BY counterparty_id, ticker ORDER BY date, order_id, line_no
  ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"""


@query(
    "recall_label",
    f"""SELECT {K}, coalesce(CASE WHEN count(is_recall) OVER {_AHEAD} >= 5
        THEN max(is_recall) OVER {_AHEAD} END, 0) AS recall_ahead FROM v_loan""",
    "v_loan",
)
def recall_label(spark, sf):
    return demand.recall_label(views.loans(spark, sf), LOAN_SERIES).select(*KEY, "recall_ahead")


_PROFILE = """SELECT counterparty_id, avg(is_recall) AS cp_recall_rate, avg(trade_term_days) AS cp_avg_term,
  max(h.cp_hhi) AS cp_hhi FROM v_loan JOIN (
    SELECT counterparty_id, sum(n * n) / (sum(n) * sum(n)) AS cp_hhi FROM
      (SELECT counterparty_id, asset_class, CAST(count(*) AS DOUBLE) AS n FROM v_loan GROUP BY 1, 2) GROUP BY 1) h
  USING (counterparty_id) GROUP BY 1"""


@query("counterparty_profile", _PROFILE, "v_loan", "cp_recall_rate cp_avg_term cp_hhi")
def counterparty_profile(spark, sf):
    return demand.counterparty_profile(views.loans(spark, sf))


@query(
    "loan_market_join",
    f"""SELECT {K}, cp_recall_rate, cp_hhi, coalesce(vix, 0) / 30 AS market_stress FROM v_loan
        LEFT JOIN ({_PROFILE}) p USING (counterparty_id)
        LEFT JOIN v_macro m ON m.date = CAST(v_loan.date AS DATE)""",
    "v_loan v_macro",
    "cp_recall_rate cp_hhi market_stress",
)
def loan_market_join(spark, sf):
    book = views.loans(spark, sf).withColumn("date", F.to_date("date"))
    out = demand.recall_features(book, views.macro(spark, sf))
    return out.select(*KEY, "cp_recall_rate", "cp_hhi", "market_stress")


_D30 = "(PARTITION BY {k} ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)"
_CP = _D30.format(k="counterparty_id")
_TK = _D30.format(k="ticker")


@query(
    "cp_recall_30d",
    f"""SELECT counterparty_id, day, sum(r) OVER {_CP} / sum(n) OVER {_CP} AS cp_recall_rate_30d,
        sum(t) OVER {_CP} / sum(n) OVER {_CP} AS cp_avg_term_days,
        sum(v) OVER {_CP} / nullif(sum(m) OVER {_CP}, 0) AS cp_utilization_rate
        FROM (SELECT counterparty_id, CAST(date AS DATE) AS day, sum(is_recall) AS r, count(*) AS n,
              sum(trade_term_days) AS t, sum(borrow_volume) AS v, sum(notional) AS m FROM v_loan GROUP BY 1, 2)""",
    "v_loan",
    "cp_recall_rate_30d cp_avg_term_days cp_utilization_rate",
    "day",
)
def cp_recall_30d(spark, sf):
    return demand.recall_rate_30d(views.loans(spark, sf))


@query(
    "inventory_cover",
    """SELECT ticker, sum(s) / sum(n) AS specials_ratio, max(a) / nullif(avg(d) * 1.5, 0) AS inventory_cover_days
       FROM (SELECT ticker, CAST(date AS DATE) AS day, sum(borrow_volume) AS d, max(notional) AS a, count(*) AS n,
             count(*) FILTER (WHERE borrow_rate > 0.075) AS s FROM v_loan GROUP BY 1, 2) GROUP BY 1""",
    "v_loan",
    "specials_ratio inventory_cover_days:4",
)
def inventory_cover(spark, sf):
    return demand.inventory_cover(views.loans(spark, sf), special_rate=0.075, surge=1.5)


@query(
    "book_pnl_30d",
    f"""SELECT ticker, day, sum(p) OVER {_TK} AS book_pnl_rolling_30d, sum(r) OVER {_TK} / sum(n) OVER {_TK} AS settlement_fail_rate,
        CAST(sum(r) OVER {_TK} AS BIGINT) AS open_recall_count
        FROM (SELECT ticker, CAST(date AS DATE) AS day, sum(notional * borrow_rate) AS p, sum(is_recall) AS r,
              count(*) AS n FROM v_loan GROUP BY 1, 2)""",
    "v_loan",
    "book_pnl_rolling_30d:4 settlement_fail_rate",
    "day",
)
def book_pnl_30d(spark, sf):
    return demand.book_pnl_30d(views.loans(spark, sf))
