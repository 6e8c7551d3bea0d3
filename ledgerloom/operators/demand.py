"""Loan demand and recall features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.rolling import Rolling
from .series import Series, over_history
from .sizes import broadcast_if_small


def demand_features(
    df: DataFrame, series: Series, windows=(5, 10, 20, 60), rate_scale: str = "rate"
) -> DataFrame:
    """Rolling volume and rate statistics, rate z-score and volume momentum.

    ``rate_scale='volume'`` divides the rate deviation by the volume's standard
    deviation instead of the rate's own.
    """

    def compute(d, w):
        r, new = Rolling(w), {}
        vol, rate = "borrow_volume", "borrow_rate"
        for n in windows:
            new[f"vol_rolling_mean_{n}d"] = r.mean(vol, n)
            new[f"vol_rolling_std_{n}d"] = r.sd(vol, n)
            new[f"rate_rolling_mean_{n}d"] = r.mean(rate, n)
            spread = r.sd(rate if rate_scale == "rate" else vol, n)
            new[f"rate_z_{n}d"] = (F.col(rate) - r.mean(rate, n)) / (spread + 1e-8)
        new["vol_mom_1d"] = r.diff(vol, 1)
        new["vol_mom_5d"] = r.diff(vol, 5)
        return r.add(d, new)

    return over_history(df, series, compute, depth=max(windows) - 1)


def recall_label(df: DataFrame, series: Series, horizon: int = 5) -> DataFrame:
    """1 when a recall happens in the next ``horizon`` rows; 0 where they are not all there."""

    def compute(d, w):
        # The series runs backwards: the rows before this one are the later ones.
        ahead = w.rowsBetween(-horizon, -1)
        label = F.when(F.count("is_recall").over(ahead) >= horizon, F.max("is_recall").over(ahead))
        return d.select("*", F.coalesce(label, F.lit(0)).cast("int").alias("recall_ahead"))

    return over_history(df, series, compute, depth=horizon, descending=True)


def counterparty_profile(loans: DataFrame) -> DataFrame:
    """Recall rate, mean term and concentration of asset-class counts per counterparty."""
    per_class = loans.groupBy("counterparty_id", "asset_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("is_recall").alias("recalls"),
        F.sum("trade_term_days").alias("terms"),
        F.count("trade_term_days").alias("with_term"),
    )
    known = F.when(F.col("asset_class").isNotNull(), F.col("n"))
    return per_class.groupBy("counterparty_id").agg(
        ratio(F.sum("recalls"), F.sum("n")).alias("cp_recall_rate"),
        ratio(F.sum("terms"), F.sum("with_term")).alias("cp_avg_term"),
        ratio(F.sum(known * known), F.pow(F.sum(known), F.lit(2))).alias("cp_hhi"),
    )


def recall_features(loans: DataFrame, market: DataFrame) -> DataFrame:
    """Counterparty profile and market stress on every loan row; absent numbers are 0."""
    stress = market.select("date", (F.coalesce("vix", F.lit(0.0)) / 30).alias("market_stress"))
    return (
        loans.join(broadcast_if_small(counterparty_profile(loans)), "counterparty_id", "left")
        .join(broadcast_if_small(stress), "date", "left")
        .fillna(0.0, subset=["cp_recall_rate", "cp_avg_term", "cp_hhi", "market_stress", "borrow_rate"])
    )


def rolling_days(loans: DataFrame, keys: list[str], date: str, days: int, measures: dict) -> DataFrame:
    """Sums over the trailing ``days`` calendar days, from one row per key and day.

    The daily totals combine before the shuffle, so a busy key costs one row
    per day in the window that follows.
    """
    daily = loans.groupBy(*keys, F.to_date(date).alias("day")).agg(
        *[expr.alias(name) for name, expr in measures.items()]
    )
    w = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.select(*keys, "day", *[F.sum(name).over(w).alias(name) for name in measures])


def recall_rate_30d(loans: DataFrame) -> DataFrame:
    """Trailing 30-day recall rate, utilisation and average term per counterparty and day."""
    sums = rolling_days(
        loans, ["counterparty_id"], "date", 30,
        {
            "recalls": F.sum("is_recall"),
            "trades": F.count(F.lit(1)),
            "terms": F.sum("trade_term_days"),
            "lent": F.sum("borrow_volume"),
            "valued": F.sum("notional"),
        },
    )
    return sums.select(
        "counterparty_id",
        "day",
        ratio(F.col("recalls"), F.col("trades")).alias("cp_recall_rate_30d"),
        ratio(F.col("terms"), F.col("trades")).alias("cp_avg_term_days"),
        ratio(F.col("lent"), F.col("valued")).alias("cp_utilization_rate"),
    )


def inventory_cover(loans: DataFrame, special_rate: float, surge: float = 1.0) -> DataFrame:
    """Share of the book on special and days of inventory against mean daily demand, per ticker."""
    daily = loans.groupBy("ticker", F.to_date("date").alias("day")).agg(
        F.sum("borrow_volume").alias("demand"),
        F.max("notional").alias("available"),
        F.count_if(F.col("borrow_rate") > special_rate).alias("specials"),
        F.count(F.lit(1)).alias("trades"),
    )
    return daily.groupBy("ticker").agg(
        ratio(F.sum("specials"), F.sum("trades")).alias("specials_ratio"),
        ratio(F.max("available"), F.avg("demand") * surge).alias("inventory_cover_days"),
    )


def book_pnl_30d(loans: DataFrame) -> DataFrame:
    """Trailing 30-day earnings, fail rate and open recalls per ticker and day."""
    sums = rolling_days(
        loans, ["ticker"], "date", 30,
        {
            "pnl": F.sum(F.col("notional") * F.col("borrow_rate")),
            "recalls": F.sum("is_recall"),
            "trades": F.count(F.lit(1)),
        },
    )
    return sums.select(
        "ticker",
        "day",
        F.col("pnl").alias("book_pnl_rolling_30d"),
        ratio(F.col("recalls"), F.col("trades")).alias("settlement_fail_rate"),
        F.col("recalls").alias("open_recall_count"),
    )

