"""Role views: the driver tables seen as securities-finance tables.

Each view names its columns the way the operators expect them. Aggregated
views (macro, funding, budget) reduce to one row per calendar day or per
instrument, so they are small whatever the size of the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import ratio
from ..operators.series import Series

RATE_SERIES = Series(("ticker",), ("date", "event_id"), "hour")
REPO_SERIES = Series(("instrument_type",), ("date", "event_id"), "hour")
PANEL_SERIES = Series(("ticker",), ("date", "order_id", "line_no", "counterparty_id"), "day")
LOAN_SERIES = Series(("counterparty_id", "ticker"), ("date", "order_id", "line_no"), "day")
PORTFOLIO_SERIES = Series(("portfolio_id",), ("date",), "day", one_per_slot=True)
# One row per day in all: a window without keys over it is bounded by the calendar.
MACRO_DAYS = Series((), ("date",), "day", one_per_slot=True)

# Asset classes by product type.
ASSET_CLASS = {
    "STANDARD": "UST",
    "ECONOMY": "Agency",
    "MEDIUM": "Corp",
    "SMALL": "Muni",
    "LARGE": "Equity",
    "PROMO": "MBS_Non_Agency",
}
# Credit ratings from best to worst.
RATINGS = [
    "AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-",
    "BB+", "BB", "BB-", "B+", "B", "B-", "NR", "D",
]
# Sectors and tickers given to collateral items in turn.
SECTORS = ["Financials", "Real Estate", "Technology", "Energy", "Utilities"]
TICKERS = ["C", "BAC", "GS", "JPM", "MS", "WFC", "KEY"]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _pick(values: list[str], i) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def asset_class(p_type):
    out = F.lit(None).cast("string")
    for source, target in ASSET_CLASS.items():
        out = F.when(p_type == source, F.lit(target)).otherwise(out)
    return out


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borrow rates: one row per ticker and tick, with the hour's mean as benchmark."""
    ticks = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("ticker"),
        F.col("ts").alias("date"),
        F.col("value").alias("rate"),
        F.date_trunc("hour", "ts").alias("hour"),
    )
    hourly = ticks.groupBy("hour").agg(F.avg("rate").alias("benchmark"))
    # One row per calendar hour: under 9,000 a year.
    return ticks.join(F.broadcast(hourly), "hour").drop("hour")


def repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("instrument_type"),
        _pick(["O/N", "T/N", "1W"], F.col("user_id") % 3).alias("tenor"),
        F.col("ts").alias("date"),
        F.to_date("ts").alias("day"),
        F.col("value").alias("rate_bps"),
    )


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("instrument_type"))
        .agg(F.avg("value").alias("budget_rate_bps"))
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily funding rates in percent: one row per calendar day."""

    def rate_of(kind: str):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value"))) / 100

    return (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            rate_of("view").alias("sofr"),
            rate_of("click").alias("fed_funds"),
            rate_of("signup").alias("ois"),
            rate_of("purchase").alias("libor_3m"),
        )
    )


def notionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("instrument_type"))
        .agg(F.sum("value").alias("notional"))
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-interest, borrow and price panel per ticker."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("ticker"),
        F.col("l_shipdate").alias("date"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("counterparty_id"),
        F.col("l_quantity").alias("volume"),
        ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("close"),
        (F.col("l_extendedprice") / 10).alias("shares_short"),
        (F.col("l_discount") + F.col("l_tax")).alias("short_interest_ratio"),
        F.col("l_discount").alias("utilization_rate"),
        F.col("l_tax").alias("borrow_rate"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("ticker"),
        F.col("l_suppkey").alias("counterparty_id"),
        F.col("l_shipdate").alias("date"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_discount").alias("borrow_rate"),
        F.col("l_quantity").alias("borrow_volume"),
        F.col("l_extendedprice").alias("notional"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_recall"),
        (F.col("l_linenumber") * 10).alias("trade_term_days"),
    )
    classes = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ticker"), asset_class(F.col("p_type")).alias("asset_class")
    )
    return book.join(classes, "ticker", "left")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collateral pool: one row per item."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("collateral_id"),
        asset_class(F.col("p_type")).alias("asset_class"),
        F.col("p_retailprice").alias("market_value"),
        (F.col("p_size") / 100).alias("haircut"),
        (key % 10).cast("double").alias("modified_duration"),
        (key % 7).cast("double").alias("spread_duration"),
        _pick(RATINGS, key % 18).alias("rating"),
        _pick(SECTORS, key % 5).alias("gics_sector"),
        _pick(TICKERS, key % 7).alias("ticker"),
        (F.col("p_size") / 1000).alias("bid_ask_spread_pct"),
        ((key % 20) / 20).alias("recall_prob"),
        ((key % 13) / 1000).alias("fee_rate"),
        ((key % 11) / 100).alias("capital_charge_est"),
        (1 + key % 9).cast("double").alias("days_to_cover"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 3650).cast("int")).alias("maturity_date"),
        F.when(key % 17 != 0, (key % 8) / 100).alias("coupon_rate"),
        (key % 19 != 0).alias("eligible"),
        F.col("p_size").cast("double").alias("financing_rate_bps"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio positions by month: orders own the lines, parts give the sector."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    )
    owners = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_custkey") % 50).alias("portfolio_id"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"),
    )
    sectors = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("sector")
    )
    return (
        lines.join(owners, "l_orderkey")
        .join(sectors, "l_partkey")
        .select(
            "portfolio_id",
            "date",
            "sector",
            F.col("l_suppkey").alias("counterparty"),
            F.col("l_partkey").alias("isin"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("market_value"),
            F.col("l_discount").alias("volatility_30d"),
            F.col("l_tax").alias("bid_ask_spread"),
        )
    )


def counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("counterparty_id"),
        (F.col("s_acctbal") - 1000).alias("credit_limit"),
        F.col("s_nationkey").alias("nation_id"),
    )


# Macro series: a daily mean of one measure over one slice of the lines.
_MACRO = {
    "sofr": ("l_discount * 100", "l_returnflag = 'A'"),
    "fed_funds": ("l_discount * 100", "l_returnflag = 'N'"),
    "prime_rate": ("l_discount * 100 + 3", "l_returnflag = 'R'"),
    "iorb": ("l_discount * 100", "l_linestatus = 'O'"),
    "ois": ("l_discount * 100", "l_linestatus = 'F'"),
    "t_3mo": ("l_tax * 100", "l_linestatus = 'F'"),
    "t_2yr": ("l_tax * 100", "l_returnflag = 'A'"),
    "t_5yr": ("l_tax * 100", "l_returnflag = 'N'"),
    "t_10yr": ("l_tax * 100", "l_returnflag = 'R'"),
    "hy_oas": ("l_quantity / 10", "l_returnflag = 'A'"),
    "ig_oas": ("l_quantity / 20", "l_returnflag = 'N'"),
    "ted_spread": ("l_quantity / 100", "l_returnflag = 'R'"),
    "mortgage_30y": ("l_tax * 100 + 2", "l_linestatus = 'O'"),
    "vix": ("l_quantity", "l_linestatus = 'F'"),
    "rrp_balance": ("l_extendedprice", "l_linestatus = 'O'"),
    "reserve_balances": ("l_extendedprice", "l_linestatus = 'F'"),
    "m2": ("l_extendedprice", "l_returnflag = 'A'"),
}
MACRO_SERIES = list(_MACRO)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide macro table: at most one row per calendar day."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        *[
            F.avg(F.when(F.expr(keep), F.expr(measure))).alias(name)
            for name, (measure, keep) in _MACRO.items()
        ]
    )


def _case_asset_class() -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASSET_CLASS.items())
    return f"CASE p_type {arms} END"


def _sql_pick(values: list[str], i: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[CAST({i} AS INTEGER) + 1]"


_EVENT_DAY = "CAST(ts AS DATE)"
SQL = {
    "v_rate": """
        SELECT e.event_id, e.user_id AS ticker, e.ts AS date, e.value AS rate, h.benchmark
        FROM events e JOIN (SELECT date_trunc('hour', ts) AS hour, avg(value) AS benchmark
                            FROM events GROUP BY 1) h ON h.hour = date_trunc('hour', e.ts)""",
    "v_repo": f"""
        SELECT event_id, event_type AS instrument_type,
               {_sql_pick(["O/N", "T/N", "1W"], "user_id % 3")} AS tenor,
               ts AS date, {_EVENT_DAY} AS day, value AS rate_bps FROM events""",
    "v_budget": """
        SELECT event_type AS instrument_type, avg(value) AS budget_rate_bps FROM events GROUP BY 1""",
    "v_funding": f"""
        SELECT {_EVENT_DAY} AS day,
               avg(CASE WHEN event_type = 'view' THEN value END) / 100 AS sofr,
               avg(CASE WHEN event_type = 'click' THEN value END) / 100 AS fed_funds,
               avg(CASE WHEN event_type = 'signup' THEN value END) / 100 AS ois,
               avg(CASE WHEN event_type = 'purchase' THEN value END) / 100 AS libor_3m
        FROM events GROUP BY 1""",
    "v_notional": f"""
        SELECT {_EVENT_DAY} AS day, event_type AS instrument_type, sum(value) AS notional
        FROM events GROUP BY 1, 2""",
    "v_panel": """
        SELECT l_partkey AS ticker, l_shipdate AS date, l_orderkey AS order_id, l_linenumber AS line_no,
               l_suppkey AS counterparty_id, l_quantity AS volume,
               l_extendedprice / nullif(l_quantity, 0) AS close, l_extendedprice / 10 AS shares_short,
               l_discount + l_tax AS short_interest_ratio, l_discount AS utilization_rate,
               l_tax AS borrow_rate FROM lineitem""",
    "v_loan": f"""
        SELECT l_partkey AS ticker, l_suppkey AS counterparty_id, l_shipdate AS date,
               l_orderkey AS order_id, l_linenumber AS line_no, l_discount AS borrow_rate,
               l_quantity AS borrow_volume, l_extendedprice AS notional,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_recall,
               l_linenumber * 10 AS trade_term_days, {_case_asset_class()} AS asset_class
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
    "v_pool": f"""
        SELECT p_partkey AS collateral_id, {_case_asset_class()} AS asset_class,
               p_retailprice AS market_value, p_size / 100 AS haircut,
               CAST(p_partkey % 10 AS DOUBLE) AS modified_duration,
               CAST(p_partkey % 7 AS DOUBLE) AS spread_duration,
               {_sql_pick(RATINGS, "p_partkey % 18")} AS rating,
               {_sql_pick(SECTORS, "p_partkey % 5")} AS gics_sector,
               {_sql_pick(TICKERS, "p_partkey % 7")} AS ticker,
               p_size / 1000 AS bid_ask_spread_pct, (p_partkey % 20) / 20 AS recall_prob,
               (p_partkey % 13) / 1000 AS fee_rate, (p_partkey % 11) / 100 AS capital_charge_est,
               CAST(1 + p_partkey % 9 AS DOUBLE) AS days_to_cover,
               DATE '2024-01-01' + CAST(p_partkey % 3650 AS INTEGER) AS maturity_date,
               CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 8) / 100 END AS coupon_rate,
               p_partkey % 19 <> 0 AS eligible, CAST(p_size AS DOUBLE) AS financing_rate_bps
        FROM part""",
    "v_pos": """
        SELECT o_custkey % 50 AS portfolio_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               p_type AS sector, l_suppkey AS counterparty, l_partkey AS isin, l_orderkey AS order_id,
               l_linenumber AS line_no, l_quantity AS quantity, l_extendedprice AS market_value,
               l_discount AS volatility_30d, l_tax AS bid_ask_spread
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "v_cp": """
        SELECT s_suppkey AS counterparty_id, s_acctbal - 1000 AS credit_limit, s_nationkey AS nation_id
        FROM supplier""",
    "v_macro": "SELECT CAST(l_shipdate AS DATE) AS date, "
    + ", ".join(f"avg(CASE WHEN {keep} THEN {measure} END) AS {name}" for name, (measure, keep) in _MACRO.items())
    + " FROM lineitem GROUP BY 1",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
