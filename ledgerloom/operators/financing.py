"""Repo and financing-cost features, horizon targets, budgets and forecast alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.numeric import settled
from ..functions.rolling import Rolling
from .series import Series, Step, chained, over_history
from .sizes import broadcast_if_small


def lag_features_step(column: str, lags=(1, 3, 5, 10, 20)) -> Step:
    def compute(d, w):
        return d.select("*", *[F.lag(column, k).over(w).alias(f"{column}_lag_{k}") for k in lags])

    return compute, max(lags)


def lag_features(df: DataFrame, series: Series, column: str, lags=(1, 3, 5, 10, 20)) -> DataFrame:
    return over_history(df, series, *lag_features_step(column, lags))


def shifted_rolling_step(column: str, windows=(5, 10, 20)) -> Step:
    def compute(d, w):
        r, new = Rolling(w), {}
        for n in windows:
            least = max(1, n // 2)
            for stat, fn in (("mean", r.mean), ("std", r.sd), ("min", r.low), ("max", r.high)):
                new[f"{column}_roll{n}_{stat}"] = fn(column, n, least, skip=1)
        return r.add(d, new)

    return compute, max(windows)


def shifted_rolling(df: DataFrame, series: Series, column: str, windows=(5, 10, 20)) -> DataFrame:
    """Rolling statistics of the rows before the current one, so the target does not leak in."""
    return over_history(df, series, *shifted_rolling_step(column, windows))


def rate_change_accel_step(column: str = "rate_bps") -> Step:
    def compute(d, w):
        r = Rolling(w)
        d = r.add(d, {"rate_change_1d": r.diff(column, 1), "rate_change_3d": r.diff(column, 3)})
        r = Rolling(w)
        return r.add(d, {"rate_accel_1d": r.diff("rate_change_1d", 1)})

    return compute, 3


def rate_change_accel(df: DataFrame, series: Series, column: str = "rate_bps") -> DataFrame:
    return over_history(df, series, *rate_change_accel_step(column))


def horizon_targets(df: DataFrame, series: Series, column: str, horizons=(1, 3, 5)) -> DataFrame:
    """The value h rows ahead, per entity."""

    def compute(d, w):
        # The series runs backwards, so a lag looks ahead in time.
        return d.select("*", *[F.lag(column, h).over(w).alias(f"target_{h}d") for h in horizons])

    return over_history(df, series, compute, depth=max(horizons), descending=True)


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.select(
        "*",
        F.weekday(d).alias("day_of_week"),
        F.month(d).alias("month"),
        F.quarter(d).alias("quarter"),
        calendar.days_to_month_end(d).alias("days_to_month_end"),
        calendar.is_month_end(d).alias("is_month_end"),
        calendar.is_quarter_end(d).alias("is_quarter_end"),
    )


def macro_basis(df: DataFrame) -> DataFrame:
    """Basis columns in basis points; rates are in percent."""
    return df.select(
        "*",
        (F.col("rate_bps") - F.col("sofr") * 100).alias("repo_sofr_spread"),
        (F.col("rate_bps") - F.col("fed_funds") * 100).alias("repo_ff_spread"),
        ((F.col("sofr") - F.col("ois")) * 100).alias("ois_basis"),
        ((F.col("libor_3m") - F.col("sofr")) * 100).alias("curve_slope_proxy"),
    )


def star_join(repo: DataFrame, funding: DataFrame, notionals: DataFrame, budget: DataFrame) -> DataFrame:
    """Repo rates with the day's funding rates, notional and the instrument's budget."""
    return (
        repo.join(broadcast_if_small(funding), "day", "left")
        .join(broadcast_if_small(notionals), ["day", "instrument_type"], "left")
        .join(broadcast_if_small(budget), "instrument_type", "left")
    )


def tenor_spreads(repo: DataFrame) -> DataFrame:
    """Mean rate by tenor for each day and instrument, and spreads over overnight."""
    wide = (
        repo.groupBy("day", "instrument_type")
        .pivot("tenor", ["O/N", "T/N", "1W"])
        .agg(F.avg("rate_bps"))
    )
    return wide.select(
        "day",
        "instrument_type",
        (F.col("T/N") - F.col("O/N")).alias("tn_on_spread"),
        (F.col("1W") - F.col("O/N")).alias("w1_on_spread"),
    )


def category_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Position of a category in the sorted list of categories, from 0; -1 for NULL."""
    # One row per category, and a category code fits a byte in the feature tables.
    codes = df.select(column).where(F.col(column).isNotNull()).distinct().select(
        column, (F.row_number().over(Window.orderBy(column)) - 1).alias(name)
    )
    return df.join(broadcast_if_small(codes), column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def forecast_metrics(df: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """Mean absolute error, root mean squared error and count per horizon."""
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(h).alias("horizon"),
                        (F.col(f"forecast_{h}d_bps") - F.col(f"target_{h}d")).alias("e"),
                        F.col(f"target_{h}d").isNotNull().alias("known"),
                    )
                    for h in horizons
                ]
            )
        ).alias("r")
    ).where("r.known")
    e = F.col("r.e")
    return long.groupBy(F.col("r.horizon").alias("horizon")).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n_samples")
    )


def cost_vs_budget(forecasts: DataFrame, budget: DataFrame, horizon: int = 1, threshold: float = 5.0) -> DataFrame:
    """Forecast minus budget at the chosen horizon, flagged when strictly over the threshold."""
    cost = F.col(f"forecast_{horizon}d_bps") - F.col("budget_rate_bps")
    return (
        forecasts.join(broadcast_if_small(budget), "instrument_type", "left")
        .withColumn("cost_vs_budget_bps", cost)
        .withColumn("alert_flag", F.coalesce(F.col("cost_vs_budget_bps") > threshold, F.lit(False)))
    )


def forecast_alerts(
    forecasts: DataFrame, budget: DataFrame, spike: float = 10.0, breach: float = 5.0, horizons=(1, 3, 5)
) -> DataFrame:
    """A row per horizon and rule that fires: a spike over current, a breach of budget, or both."""
    joined = forecasts.join(broadcast_if_small(budget), "instrument_type", "left")
    over = F.col("forecast_bps") - F.col("budget_rate_bps")

    def rule(name: str, fires: Column) -> Column:
        return F.when(fires, F.lit(name))

    long = joined.select(
        *joined.columns,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(h).alias("horizon_days"), F.col(f"forecast_{h}d_bps").alias("forecast_bps"))
                    for h in horizons
                ]
            )
        ).alias("f"),
    ).select(*joined.columns, "f.*")
    fired = F.array_compact(
        F.array(
            rule("RATE_SPIKE", F.col("forecast_bps") - F.col("current_rate_bps") >= spike),
            rule("BUDGET_BREACH", over >= breach),
        )
    )
    return long.withColumn("breach_bps", F.coalesce(over, F.lit(0.0))).withColumn("alert_type", F.explode(fired))


def forecast_message() -> Column:
    """Text of a forecast alert; a budget that is not known is left out."""
    told = F.format_string(
        "%s: in %d days %s may pay %.1f bps, now it pays %.1f",
        F.col("alert_type"), F.col("horizon_days"), F.col("instrument_type").cast("string"), settled("forecast_bps"), settled("current_rate_bps"),
    )
    budgeted = F.when(F.col("budget_rate_bps").isNotNull(), F.format_string(", budgeted are %.1f", settled("budget_rate_bps")))
    return F.concat(told, F.coalesce(budgeted, F.lit("")))


def build_features(df: DataFrame, series: Series, column: str = "rate_bps") -> DataFrame:
    """Lag, rolling, momentum and calendar features of a repo panel; the history is passed once."""
    steps = chained(lag_features_step(column), shifted_rolling_step(column), rate_change_accel_step(column))
    return calendar_features(over_history(df, series, *steps)).dropna(subset=[column])
