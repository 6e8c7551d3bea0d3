"""Portfolio exposures: joins, fills, concentration and risk aggregates.

Group totals are aggregates joined back by key rather than keyed windows:
aggregation combines before the shuffle and the join splits skewed partitions,
so one dominant portfolio does not land in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import numeric_columns, ratio, settled
from ..session import lineage_cut
from .quantiles import exact_quantiles
from .series import Series, last_known, over_history
from .sizes import attach_one_row, broadcast_if_small

GROUP = ["portfolio_id", "date"]
# Fixed value: one-sided 95% normal quantile.
VAR_Z_95 = 1.6449


def valid_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def valid_prices(df: DataFrame, price: str = "price") -> DataFrame:
    """Drop rows with a price at or below zero; a missing price is kept for filling."""
    return df.where(F.col(price).isNull() | (F.col(price) > 0))


def credit_utilisation(df: DataFrame, exposure: str = "current_exposure", limit: str = "credit_limit") -> DataFrame:
    used = F.when(F.col(limit) > 0, F.col(exposure) / F.col(limit))
    return df.withColumn("credit_utilisation", used)


def latest_price_fill(positions: DataFrame, market: DataFrame, columns: list[str], key: str = "isin", date: str = "date") -> DataFrame:
    """Market columns by (key, date), missing prices from the latest known value per column."""
    latest = market.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(f"latest_{c}") for c in columns]
    )
    joined = positions.join(market.select(key, date, *columns), [key, date], "left").join(latest, key, "left")
    missing = F.col(columns[0]).isNull()
    filled = [F.when(missing, F.col(f"latest_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(*positions.columns, *filled)


def asof_fill(positions: DataFrame, market: DataFrame, column: str, key: str, order: str, tiebreak: str) -> DataFrame:
    """Latest market value at or before each position, by key."""
    p = positions.withColumn("__seq", F.lit(1))
    m = market.select(key, order, column).withColumn("__seq", F.lit(0))
    both = p.unionByName(m, allowMissingColumns=True)
    series = Series((key,), (order, "__seq", tiebreak), "day")
    known = last_known(both, series, column, f"asof_{column}")
    return known.where(F.col("__seq") == 1).drop("__seq", column)


def group_total(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*group).agg(F.sum(value).alias(name))


def aum_weight(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Portfolio total and each position's share of it."""
    totals = group_total(df, group, "market_value", "portfolio_aum")
    share = F.when(F.col("portfolio_aum") > 0, F.col("market_value") / F.col("portfolio_aum")).otherwise(0.0)
    return df.join(broadcast_if_small(totals), group).withColumn("aum_weight", share)


def herfindahl(x: Column) -> Column:
    """Sum of squared shares; 0 when the total is not positive."""
    x = F.coalesce(x, F.lit(0.0))
    total = F.sum(x)
    return F.when(total > 0, F.sum(x * x) / F.pow(total, F.lit(2))).otherwise(0.0)


def hhi(df: DataFrame, group: list[str] = GROUP, value: str = "market_value") -> DataFrame:
    return df.groupBy(*group).agg(F.round(herfindahl(F.col(value)), 6).alias("hhi_portfolio"))


def top_n_exposure(df: DataFrame, order: list[str], n: int = 5, group: list[str] = GROUP) -> DataFrame:
    """Percent of the total held in the n largest positions."""
    value = F.coalesce("market_value", F.lit(0.0))
    w = Window.partitionBy(*group).orderBy(F.desc("market_value"), *order)
    largest = (
        df.select(*group, value.alias("market_value"), *order)
        .withColumn("__rank", F.row_number().over(w))
        .where(F.col("__rank") <= n)
        .groupBy(*group)
        .agg(F.sum("market_value").alias("__top"))
    )
    total = F.col("__total")
    share = F.when(total > 0, F.round(F.lit(100.0) * F.col("__top") / total, 4)).otherwise(0.0)
    return (
        group_total(df, group, "market_value", "__total")
        .join(largest, group)
        .select(*group, share.alias(f"top{n}_exposure_pct"))
    )


def concentration(df: DataFrame, by: str, names: dict[str, str], limit_pct: float, group: list[str] = GROUP) -> DataFrame:
    """Herfindahl index and largest weight of the totals per ``by``, with the limit flag."""
    parts = df.groupBy(*group, by).agg(F.sum("market_value").alias("part"))
    whole = F.sum("part")
    top = F.when(whole > 0, F.max("part") / whole).otherwise(0.0)
    return (
        parts.groupBy(*group)
        .agg(
            F.when(whole > 0, F.sum(F.col("part") * F.col("part")) / F.pow(whole, F.lit(2))).otherwise(0.0).alias(names["hhi"]),
            top.alias(names["max"]),
        )
        .withColumn(names["breach"], (F.col(names["max"]) * 100 > limit_pct).cast("int"))
    )


def sector_concentration(df: DataFrame, limit_pct: float = 30.0) -> DataFrame:
    names = {"hhi": "hhi_sector", "max": "max_sector_weight", "breach": "sector_limit_breach"}
    return concentration(df, "sector", names, limit_pct)


def counterparty_concentration(df: DataFrame, limit_pct: float = 20.0) -> DataFrame:
    names = {"hhi": "hhi_counterparty", "max": "max_cp_weight", "breach": "cp_limit_breach"}
    return concentration(df, "counterparty", names, limit_pct)


def liquidity_adjusted(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Sum of value over spread; a zero or missing spread takes the median of the raw spreads."""
    median = exact_quantiles(df, "bid_ask_spread", {"median_spread": 0.5})
    spread = F.coalesce(F.nullif("bid_ask_spread", F.lit(0.0)), "median_spread")
    return (
        attach_one_row(df, median)
        .groupBy(*group)
        .agg(F.sum(ratio(F.col("market_value"), spread)).alias("liquidity_adjusted_exposure"))
    )


def var_proxy(weighted: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Sum of weight times volatility at the 95% quantile."""
    part = F.col("aum_weight") * F.col("volatility_30d") * VAR_Z_95
    return weighted.groupBy(*group).agg(F.sum(part).alias("portfolio_var_proxy"))


def exposure_change(df: DataFrame, series: Series, columns: dict[str, str], k: int = 5) -> DataFrame:
    """Change over k rows per portfolio; the first rows give 0."""

    def compute(d, w):
        deltas = [
            F.coalesce(F.col(c) - F.lag(c, k).over(w), F.lit(0.0)).alias(name) for c, name in columns.items()
        ]
        return d.select("*", *deltas)

    return over_history(df, series, compute, depth=k)


def breach_flags(df: DataFrame, hhi_limit: float = 0.25, top_limit: float = 40.0) -> DataFrame:
    return df.withColumn("hhi_breach", (F.col("hhi_portfolio") > hhi_limit).cast("int")).withColumn(
        "top5_breach", (F.col("top5_exposure_pct") > top_limit).cast("int")
    )


def fill_numeric(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    return df.fillna(0.0, subset=numeric_columns(df, exclude))


CHANGES = {
    "hhi_portfolio": "hhi_rolling_change",
    "top5_exposure_pct": "top5_rolling_change",
    "max_sector_weight": "max_sector_rolling_change",
}


def portfolio_rollup(
    df: DataFrame, order: list[str], series: Series, sector_limit: float = 30.0, counterparty_limit: float = 20.0
) -> DataFrame:
    """One row per portfolio and date with every concentration and risk feature.

    ``df`` holds positions with a credit utilisation. Totals per sector, per
    counterparty and per portfolio come from one pass with grouping sets. The
    positions are written once, with the columns that count: the median spread
    and the largest positions read those again, not the joins behind them.
    """
    used = ["sector", "counterparty", "market_value", "bid_ask_spread", "volatility_30d", "credit_utilisation"]
    df = lineage_cut(df.select(*dict.fromkeys([*GROUP, *used, *order])), "positions")
    median = exact_quantiles(df, "bid_ask_spread", {"median_spread": 0.5})
    spread = F.coalesce(F.nullif("bid_ask_spread", F.lit(0.0)), "median_spread")
    value = F.col("market_value")
    by_sector, by_counterparty = [*GROUP, "sector"], [*GROUP, "counterparty"]
    cells = (
        attach_one_row(df, median)
        .groupingSets([by_sector, by_counterparty, GROUP], *GROUP, "sector", "counterparty")
        .agg(
            F.sum(value).alias("part"),
            F.round(herfindahl(value), 6).alias("hhi"),
            F.avg("volatility_30d").alias("volatility"),
            F.avg("credit_utilisation").alias("avg_used"),
            F.max("credit_utilisation").alias("max_used"),
            F.sum(value * F.col("volatility_30d")).alias("risk"),
            F.sum(ratio(value, spread)).alias("liquid"),
            F.grouping("sector").alias("no_sector"),
            F.grouping("counterparty").alias("no_counterparty"),
        )
    )
    whole_row = (F.col("no_sector") == 1) & (F.col("no_counterparty") == 1)

    def whole(c: str) -> Column:
        return F.max(F.when(whole_row, F.col(c)))

    def concentrated(level: Column, prefix: str, top: str, breach: str, limit: float) -> list[Column]:
        part = F.when(level, F.col("part"))
        weight = F.when(whole("part") > 0, F.max(part) / whole("part")).otherwise(0.0)
        shares = F.when(whole("part") > 0, F.sum(part * part) / F.pow(whole("part"), F.lit(2))).otherwise(0.0)
        return [shares.alias(prefix), weight.alias(top), (weight * 100 > limit).cast("int").alias(breach)]

    base = cells.groupBy(*GROUP).agg(
        whole("part").alias("market_value"),
        whole("part").alias("portfolio_aum"),
        whole("hhi").alias("hhi_portfolio"),
        whole("volatility").alias("volatility_30d"),
        whole("avg_used").alias("avg_credit_utilisation"),
        whole("max_used").alias("max_credit_utilisation"),
        F.when(whole("part") > 0, whole("risk") / whole("part") * VAR_Z_95).otherwise(0.0).alias("portfolio_var_proxy"),
        whole("liquid").alias("liquidity_adjusted_exposure"),
        *concentrated(F.col("no_sector") == 0, "hhi_sector", "max_sector_weight", "sector_limit_breach", sector_limit),
        *concentrated(
            F.col("no_counterparty") == 0, "hhi_counterparty", "max_cp_weight", "cp_limit_breach", counterparty_limit
        ),
    )
    table = breach_flags(base.join(top_n_exposure(df, order), GROUP, "left"))
    return fill_numeric(exposure_change(table, series, CHANGES), ("portfolio_id",))


RISK_FEATURES = [
    "hhi_portfolio", "hhi_sector", "hhi_counterparty", "top5_exposure_pct", "max_sector_weight",
    "max_cp_weight", "sector_limit_breach", "cp_limit_breach", "liquidity_adjusted_exposure",
    "portfolio_var_proxy", "avg_credit_utilisation", "max_credit_utilisation", "hhi_breach",
    "top5_breach", "hhi_rolling_change", "top5_rolling_change", "max_sector_rolling_change",
]


def align_features(df: DataFrame, wanted: list[str], keep: list[str]) -> DataFrame:
    """The model's columns in its order; absent ones are 0."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in wanted])


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.85, "CRITICAL").when(score >= 0.60, "HIGH").when(score >= 0.35, "MEDIUM").otherwise("LOW")


def portfolio_message(score: str, drivers: list[str], top: int = 3) -> Column:
    """Text of a portfolio alert with its largest measures, the largest first."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("n")) for c in drivers]))
    names = F.array_join(F.transform(F.slice(ranked, 1, top), lambda d: d["n"]), ", ")
    return F.format_string(
        "%s: portfolio %s scores %.3f, driven by %s", F.col("risk_level"), F.col("portfolio_id").cast("string"), settled(score), names
    )


def risk_alerts(scored: DataFrame, score: str) -> DataFrame:
    """Level of every row and whether it calls for action."""
    return scored.withColumn("risk_level", risk_level(F.col(score))).withColumn(
        "alert_flag", F.col("risk_level").isin("HIGH", "CRITICAL")
    )
