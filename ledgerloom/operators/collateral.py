"""Collateral pool merging and quality features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, first_available, min_max
from .quantiles import exact_quantiles
from .series import first_row
from .sizes import attach_one_row, broadcast_if_small, fixed_table

# Rating scale from best (1) to worst (18).
RATING_SCALE = {
    "AAA": 1, "AA+": 2, "AA": 3, "AA-": 4, "A+": 5, "A": 6, "A-": 7, "BBB+": 8, "BBB": 9,
    "BBB-": 10, "BB+": 11, "BB": 12, "BB-": 13, "B+": 14, "B": 15, "B-": 16, "NR": 17, "D": 18,
}
WORST = max(RATING_SCALE.values())


def join_first_rule(df: DataFrame, rules: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join of a dimension kept to its first row per key."""
    return df.join(broadcast_if_small(first_row(rules, [key], order).drop(*order)), key, "left")


def join_average(df: DataFrame, detail: DataFrame, key: str, value: str) -> DataFrame:
    """Left join of a mean per key; missing gives 0."""
    means = detail.groupBy(key).agg(F.avg(value).alias(value))
    return df.join(broadcast_if_small(means), key, "left").fillna(0.0, subset=[value])


def attach_first(df: DataFrame, source: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Columns of the source's first row on every row; 0 when the source is empty."""
    one = source.agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    picked = one.select(*[F.coalesce(F.col(f"r.{c}"), F.lit(0.0)).alias(c) for c in columns])
    return attach_one_row(df, picked)


def rating_score(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Ordinal rating (unknown is worst) and its score, best 1 to worst 0."""
    scale = fixed_table(df.sparkSession, list(RATING_SCALE.items()), ["r", "rating_numeric"])
    # The rating scale is a fixed list.
    joined = df.join(F.broadcast(scale), F.trim(F.col(rating)) == F.col("r"), "left").drop("r")
    return joined.withColumn("rating_numeric", F.coalesce("rating_numeric", F.lit(WORST))).withColumn(
        "rating_score", F.lit(1.0) - (F.col("rating_numeric") - 1) / F.lit(float(WORST - 1))
    )


def percent_to_fraction(df: DataFrame, column: str) -> DataFrame:
    """Divide by 100 when the column's maximum shows it is in percent."""
    top = df.agg(F.max(column).alias("__top"))
    scaled = F.when(F.col("__top") > 1, F.col(column) / 100).otherwise(F.col(column))
    return attach_one_row(df, top).withColumn(column, scaled).drop("__top")


def scaled_0_1(df: DataFrame, raw: Column, name: str, invert: bool = False) -> DataFrame:
    """Min-max scale an expression over the whole table."""
    df = df.withColumn("__raw", raw)
    bounds = df.agg(F.min("__raw").alias("__low"), F.max("__raw").alias("__high"))
    scaled = min_max(F.col("__raw"), F.col("__low"), F.col("__high"))
    if invert:
        scaled = F.lit(1.0) - scaled
    return attach_one_row(df, bounds).withColumn(name, scaled).drop("__raw", "__low", "__high")


def duration_score(df: DataFrame, as_of: str, maturity: str = "maturity_date") -> DataFrame:
    """Modified-duration proxy, short scored high; 0.5 without maturities."""
    if maturity not in df.columns:
        return df.withColumn("duration_score", F.lit(0.5))
    return scaled_0_1(df, _duration(df, as_of, maturity), "duration_score", invert=True)


def _duration(df: DataFrame, as_of: str, maturity: str = "maturity_date") -> Column:
    years = clip(F.datediff(F.col(maturity), F.to_date(F.lit(as_of))) / 365.25, low=0.0)
    return years / (1 + first_available(df, ["coupon_rate"], 0.05))


def liquidity_score(df: DataFrame, haircut: str = "haircut") -> DataFrame:
    """Inverse haircut capped at its 99th percentile, scaled to 0..1."""
    if haircut not in df.columns:
        return df.withColumn("liquidity_score", F.lit(0.5))
    df = percent_to_fraction(df.withColumn("__inverse", F.col(haircut)), "__inverse")
    df = df.withColumn("__inverse", 1.0 / (F.col("__inverse") + 1e-6))
    cap = exact_quantiles(df, "__inverse", {"__cap": 0.99})
    capped = attach_one_row(df, cap).withColumn("__inverse", F.least("__inverse", "__cap")).drop("__cap")
    return scaled_0_1(capped, F.col("__inverse"), "liquidity_score").drop("__inverse")


def cost_of_carry(df: DataFrame, haircut: str = "haircut", rate: str = "financing_rate_bps") -> DataFrame:
    """Haircut times financing rate, and the same scaled to 0..1."""
    df = percent_to_fraction(df.withColumn("cost_of_carry", first_available(df, [haircut], 0.0)), "cost_of_carry")
    df = df.withColumn("cost_of_carry", F.col("cost_of_carry") * first_available(df, [rate], 0.0) / 10_000.0)
    return scaled_0_1(df, F.col("cost_of_carry"), "cost_of_carry_norm")


def type_share(df: DataFrame, by: str = "asset_class", limit: float = 0.30) -> DataFrame:
    """Share of the pool held in each row's asset type, and whether it is over the limit."""
    by_type = df.groupBy(by).agg(F.sum("market_value").alias("__part"))
    total = by_type.agg(F.sum("__part").alias("__total"))
    shares = attach_one_row(by_type, total).select(
        by, F.coalesce(F.col("__part") / F.nullif("__total", F.lit(0.0)), F.lit(0.0)).alias("concentration_pct")
    )
    return df.join(broadcast_if_small(shares), by, "left").withColumn(
        "is_concentrated", F.col("concentration_pct") > limit
    )


QUALITY_FEATURES = [
    "duration_score", "rating_score", "liquidity_score", "concentration_pct", "cost_of_carry_norm",
    "haircut", "eligible",
]


def build_features(df: DataFrame, as_of: str) -> DataFrame:
    """All quality features of a pool that has maturities, haircuts and financing rates.

    The single scores each take their own pass over the pool for its bounds;
    here one pass gives all bounds and one more the haircut quantile.
    """
    haircut, carry = F.coalesce("haircut", F.lit(0.0)), F.col("__carry")
    raw = rating_score(df).withColumns(
        {
            "__md": _duration(df, as_of),
            "__carry": haircut * F.coalesce("financing_rate_bps", F.lit(0.0)) / 10_000.0,
        }
    )
    bounds = raw.agg(
        F.min("__md").alias("__md0"), F.max("__md").alias("__md1"), F.max("haircut").alias("__top"),
        F.min(carry).alias("__carry0"), F.max(carry).alias("__carry1"),
    )
    factor = F.when(F.col("__top") > 1, F.lit(0.01)).otherwise(1.0)
    scaled = attach_one_row(raw, bounds).withColumn("__factor", factor)
    scaled = scaled.withColumn("__inverse", 1.0 / (F.col("haircut") * F.col("__factor") + 1e-6))
    cap = exact_quantiles(scaled, "__inverse", {"__cap": 0.99})
    # The inverse falls with the haircut, so its least value is at the largest one.
    least = 1.0 / (F.col("__top") * F.col("__factor") + 1e-6)
    scored = attach_one_row(scaled, cap).withColumns(
        {
            "duration_score": F.lit(1.0) - min_max(F.col("__md"), F.col("__md0"), F.col("__md1")),
            "liquidity_score": min_max(F.least("__inverse", "__cap"), least, F.col("__cap")),
            "cost_of_carry": carry * F.col("__factor"),
            "cost_of_carry_norm": min_max(carry, F.col("__carry0"), F.col("__carry1")),
            "eligible": F.col("eligible").cast("int"),
        }
    )
    kept = [*df.columns, "rating_numeric", "rating_score", "duration_score", "liquidity_score", "cost_of_carry", "cost_of_carry_norm"]
    return type_share(scored.select(*kept))


def collateral_alerts(recommended: DataFrame, quality_floor: float = 0.55, savings: float = 5.0) -> DataFrame:
    """One alert per recommended item: low quality first, then savings, then information."""
    q, s = F.col("quality_score"), F.col("cost_savings_bps")
    low = q < quality_floor
    item = [F.col("collateral_id").cast("string"), F.col("asset_class")]
    level = F.when(low | (s >= 2 * savings), "CRITICAL").when(s >= savings, "WARNING").otherwise("INFO")
    kind = F.when(low, "SUBOPTIMAL_COLLATERAL").otherwise("COST_SAVINGS_AVAILABLE")
    message = (
        F.when(low, F.format_string("Quality score %.4f of %s (%s) is under %.4f", q, *item, F.lit(quality_floor)))
        .when(s >= savings, F.format_string("%.2f bps saved with %s (%s)", s, *item))
        .otherwise(F.format_string("%s (%s) recommended at quality %.4f", *item, q))
    )
    return recommended.select("*", level.alias("alert_level"), kind.alias("alert_type"), message.alias("message"))


def concentration_alerts(shares: DataFrame, by: str = "asset_class") -> DataFrame:
    """One CONCENTRATION_BREACH per asset type over its limit."""
    return (
        shares.where("is_concentrated")
        .groupBy(by)
        .agg(F.max("concentration_pct").alias("concentration_pct"))
        .withColumn("alert_type", F.lit("CONCENTRATION_BREACH"))
    )
