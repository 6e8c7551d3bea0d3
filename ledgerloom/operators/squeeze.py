"""Short-squeeze features, risk tiers and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.rolling import Rolling
from .series import Series, Step, chained, over_history


def join_panels(short_interest: DataFrame, borrow: DataFrame, prices: DataFrame, on: list[str]) -> DataFrame:
    """Rows present in all three panels."""
    return short_interest.join(borrow, on).join(prices, on)


def join_loss(base: DataFrame, others: list[DataFrame], on: list[str], entity: str) -> DataFrame:
    """Entities of the base panel with no row left after the inner join."""
    kept = reduce(lambda a, b: a.join(b.select(*on).distinct(), on, "left_semi"), others, base)
    lost = base.select(entity).distinct().join(kept.select(entity).distinct(), entity, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("entities_lost"))


def days_to_cover_step() -> Step:
    def compute(d, w):
        r = Rolling(w)
        usual = F.nullif(r.mean("volume", 20, 1), F.lit(0.0))
        return r.add(d, {"days_to_cover": ratio(F.col("shares_short"), usual)})

    return compute, 19


def days_to_cover(df: DataFrame, series: Series) -> DataFrame:
    return over_history(df, series, *days_to_cover_step())


def change_step(column: str, name: str, k: int = 1) -> Step:
    return lambda d, w: d.withColumn(name, F.col(column) - F.lag(column, k).over(w)), k


def change(df: DataFrame, series: Series, column: str, name: str, k: int = 1) -> DataFrame:
    return over_history(df, series, *change_step(column, name, k))


def momentum_step(column: str, prefix: str, windows=(5, 10, 20)) -> Step:
    def compute(d, w):
        r = Rolling(w)
        return r.add(d, {f"{prefix}_{n}": r.pct(column, n) for n in windows})

    return compute, max(windows)


def momentum(df: DataFrame, series: Series, column: str, prefix: str, windows=(5, 10, 20)) -> DataFrame:
    """Percent change over each of the windows."""
    return over_history(df, series, *momentum_step(column, prefix, windows))


def volume_ratio_step(windows=(10, 20)) -> Step:
    def compute(d, w):
        r = Rolling(w)
        usual = {n: F.nullif(r.mean("volume", n, 1), F.lit(0.0)) for n in windows}
        return r.add(d, {f"volume_ratio_{n}": ratio(F.col("volume"), m) for n, m in usual.items()})

    return compute, max(windows) - 1


def volume_ratio(df: DataFrame, series: Series, windows=(10, 20)) -> DataFrame:
    return over_history(df, series, *volume_ratio_step(windows))


def borrow_zscore_step() -> Step:
    def compute(d, w):
        r = Rolling(w)
        return r.add(d, {"borrow_rate_zscore": r.z("borrow_rate", 20, 2)})

    return compute, 19


def borrow_zscore(df: DataFrame, series: Series) -> DataFrame:
    return over_history(df, series, *borrow_zscore_step())


# Rows per block of the decayed sums: weights stay far inside the double range.
_BLOCK = 4096


def rsi_step(series: Series, price: str = "close", n: int = 14) -> Step:
    keep = (n - 1) / n

    def compute(d: DataFrame, w) -> DataFrame:
        d = d.select(
            "*",
            (F.row_number().over(w) - 1).alias("__seq"),
            F.coalesce(F.col(price) - F.lag(price).over(w), F.lit(0.0)).alias("__step"),
        )
        d = d.select(
            "*",
            F.floor(F.col("__seq") / F.lit(_BLOCK)).alias("__block"),
            (F.col("__seq") % F.lit(_BLOCK)).alias("__at"),
            F.greatest("__step", F.lit(0.0)).alias("__gain"),
            F.greatest(-F.col("__step"), F.lit(0.0)).alias("__loss"),
        ).drop("__step")
        parts = _partition_columns(d, series)
        running = Window.partitionBy(*parts, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        grow = F.pow(F.lit(1 / keep), F.col("__at"))
        shrink = F.pow(F.lit(keep), F.col("__at"))
        d = d.select(
            "*",
            *[(F.sum(F.col(c) / n * grow).over(running) * shrink).alias(f"{c}_in") for c in ("__gain", "__loss")],
        )
        by_block = Window.partitionBy(*parts).orderBy("__block")
        closing = F.col("__at") == F.lit(_BLOCK - 1)
        fade = keep**_BLOCK

        def smoothed(c: str) -> Column:
            total = F.col(f"{c}_in")
            for back in (1, 2, 3):
                at = by_block.rangeBetween(-back, -back)
                ended = F.sum(F.when(closing, F.col(f"{c}_in"))).over(at)
                weight = shrink * F.lit(keep) * F.lit(fade ** (back - 1))
                total = total + F.coalesce(ended, F.lit(0.0)) * weight
            return total

        d = d.select("*", smoothed("__gain").alias("__up"), smoothed("__loss").alias("__down"))
        value = F.when(F.col("__down") > 0, 100 - 100 / (1 + F.col("__up") / F.col("__down"))).otherwise(100.0)
        return d.withColumn(f"rsi_{n}", F.when(F.col("__seq") >= n - 1, value)).drop(
            "__seq", "__block", "__at", "__gain", "__loss", "__gain_in", "__loss_in", "__up", "__down"
        )

    return compute, 4 * _BLOCK


def rsi(df: DataFrame, series: Series, price: str = "close", n: int = 14) -> DataFrame:
    """Relative strength index with Wilder smoothing.

    The smoothing is a decayed sum. Within a block of rows it is a running sum
    of growing weights scaled back at each row; earlier blocks enter through
    their closing values. The decay over three blocks leaves nothing a double
    can hold, so the look-back is bounded and no history is gathered in memory.
    """
    return over_history(df, series, *rsi_step(series, price, n))


def _partition_columns(d: DataFrame, series: Series) -> list[str]:
    return [*series.keys, *[c for c in d.columns if c == "__chunk"]]


def squeeze_tier(p: Column) -> Column:
    return F.when(p >= 0.80, "CRITICAL").when(p >= 0.60, "HIGH").when(p >= 0.35, "ELEVATED").otherwise("LOW")


def squeeze_alerts(scored: DataFrame, probability: str = "squeeze_probability") -> DataFrame:
    """Rows of tier HIGH and above, with the message."""
    tiered = scored.withColumn("risk_tier", squeeze_tier(F.col(probability)))
    return tiered.where(F.col("risk_tier").isin("HIGH", "CRITICAL")).withColumn(
        "message",
        F.format_string(
            "%s may be squeezed (%s, chance %.1f%%): %.1f%% of the float is short, %.1f days cover it, %.1f%% of supply is lent",
            F.col("ticker").cast("string"), "risk_tier", F.col(probability) * 100,
            F.col("short_interest_ratio") * 100, "days_to_cover", F.col("utilization_rate") * 100,
        ),
    )


def ranked_alerts(alerts: DataFrame, probability: str, tiebreak: list[str]) -> DataFrame:
    """Alerts in order of falling probability."""
    return alerts.orderBy(F.desc(probability), *tiebreak)


SQUEEZE_FEATURES = [
    "short_interest_ratio", "days_to_cover", "utilization_rate", "utilization_change",
    *[f"si_ratio_momentum_{n}" for n in (5, 10, 20)],
    *[f"price_momentum_{n}" for n in (5, 10, 20)],
    "rsi_14", "volume_ratio_10", "volume_ratio_20", "borrow_rate_zscore",
]


def build_features(df: DataFrame, series: Series) -> DataFrame:
    """All squeeze features of a panel in one pass."""
    steps = chained(
        days_to_cover_step(),
        change_step("utilization_rate", "utilization_change"),
        momentum_step("short_interest_ratio", "si_ratio_momentum"),
        momentum_step("close", "price_momentum"),
        volume_ratio_step(),
        borrow_zscore_step(),
        rsi_step(series),
    )
    return over_history(df, series, *steps)
