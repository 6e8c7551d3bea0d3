"""Macro features over a wide table with one row per calendar day.

A day table is bounded by the calendar (about 260 rows a year), whatever fed
it, so ordered windows over the whole of it stay small.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.numeric import mean_skipping_null, right_closed_bin
from ..functions.rolling import Rolling
from .scans import with_runs
from .series import Series, latest_rows, over_history
from .sizes import attach_one_row, fixed_table

RATES = ("sofr", "fed_funds", "prime_rate", "iorb")
SPREADS = ("hy_oas", "ig_oas", "ted_spread", "mortgage_30y")
# Upper and lower edges of the volatility regimes.
VIX_EDGES = [0, 15, 20, 30, 40, 999]
# Component weights of the composite indexes.
STRESS_WEIGHTS = {"ted_spread_z60": 0.30, "vix_z20": 0.25, "hy_oas_z60": 0.30, "rrp_change5d": 0.15}
QUALITY_WEIGHTS = {"ig_oas_z60": 0.40, "curve_level": 0.30, "vix_z20": 0.30}


def soft_z(r: Rolling, column: str, n: int) -> Column:
    """Rolling z-score over n full rows with a small constant under the ratio."""
    return (F.col(column) - r.mean(column, n)) / (r.sd(column, n) + 1e-8)


def _add(d: DataFrame, new: dict[str, Column]) -> DataFrame:
    return d.select("*", *[c.alias(name) for name, c in new.items()])


def level_features(df: DataFrame, series: Series, windows=(5, 10, 20, 60, 120), columns=RATES) -> DataFrame:
    """Mean, deviation, z-score and change of each rate, and the policy-rate spreads."""
    present = [c for c in columns if c in df.columns]

    def compute(d, w):
        r, new = Rolling(w), {}
        for c in present:
            for n in windows:
                new[f"{c}_ma{n}"] = r.mean(c, n)
                new[f"{c}_std{n}"] = r.sd(c, n)
                new[f"{c}_z{n}"] = soft_z(r, c, n)
                new[f"{c}_mom{n}"] = r.diff(c, n)
        return r.add(d, new)

    out = over_history(df, series, compute, depth=max(windows))
    spreads = {"fed_sofr_spread": "fed_funds", "prime_sofr_spread": "prime_rate", "iorb_sofr_spread": "iorb"}
    return _add(
        out, {n: F.col(c) - F.col("sofr") for n, c in spreads.items() if c in df.columns and "sofr" in df.columns}
    )


def run_length(df: DataFrame, series: Series, flag: str, name: str) -> DataFrame:
    """Rows since the flag was last switched on, 0 in its first row and while off.

    Histories of any length: see ``scans``.
    """
    return with_runs(df, series, flag).withColumn(name, (F.col("__place") - 1) * F.col(flag)).drop("__run", "__place")


def curve_shape(df: DataFrame, series: Series) -> DataFrame:
    """Slopes, inversion flag, butterfly, level, slope momentum and slope z-score."""
    have = set(df.columns)
    new = {}
    if {"t_10yr", "t_2yr"} <= have:
        slope = F.col("t_10yr") - F.col("t_2yr")
        new["curve_10y2y"] = slope
        new["curve_10y2y_inverted"] = F.coalesce((slope < 0).cast("int"), F.lit(0))
    if {"t_10yr", "t_3mo"} <= have:
        new["curve_10y3m"] = F.col("t_10yr") - F.col("t_3mo")
    if {"t_5yr", "t_2yr"} <= have:
        new["curve_5y2y"] = F.col("t_5yr") - F.col("t_2yr")
    if {"t_2yr", "t_5yr", "t_10yr"} <= have:
        new["curve_butterfly"] = 2 * F.col("t_5yr") - (F.col("t_2yr") + F.col("t_10yr"))
    tenors = [F.col(c) for c in ("t_2yr", "t_5yr", "t_10yr") if c in have]
    if tenors:
        new["curve_level"] = mean_skipping_null(tenors)
    out = _add(df, new)
    slopes = [c for c in ("curve_10y2y", "curve_10y3m") if c in new]

    def compute(d, w):
        r, more = Rolling(w), {}
        for c in slopes:
            for n in (5, 10, 20):
                more[f"{c}_mom{n}d"] = r.diff(c, n)
            more[f"{c}_z60"] = soft_z(r, c, 60)
        return r.add(d, more)

    return over_history(out, series, compute, depth=60) if slopes else out


def spread_features(df: DataFrame, series: Series, windows=(60, 120), columns=SPREADS) -> DataFrame:
    have = set(df.columns)
    present = [c for c in columns if c in have]
    new = {}
    if {"hy_oas", "ig_oas"} <= have:
        new["hy_ig_diff"] = F.col("hy_oas") - F.col("ig_oas")
    if {"mortgage_30y", "t_10yr"} <= have:
        new["mbs_basis"] = F.col("mortgage_30y") - F.col("t_10yr")

    def compute(d, w):
        r, more = Rolling(w), {}
        for c in present:
            more |= {f"{c}_z{n}": soft_z(r, c, n) for n in windows}
            more |= {f"{c}_mom{n}d": r.diff(c, n) for n in (5, 10, 20)}
        more |= {f"{c}_z60": soft_z(r, c, 60) for c in new}
        return r.add(d, more)

    return over_history(_add(df, new), series, compute, depth=max(windows))


def liquidity_features(df: DataFrame, series: Series) -> DataFrame:
    """Volatility z-scores and regime, balance changes and long percent changes."""
    have = set(df.columns)

    def compute(d, w):
        r, new = Rolling(w), {}
        if "vix" in have:
            new |= {f"vix_z{n}": soft_z(r, "vix", n) for n in (10, 20, 60)}
            new["vix_mom5d"] = r.diff("vix", 5)
            new["vix_regime"] = right_closed_bin(F.col("vix"), VIX_EDGES)
        if "rrp_balance" in have:
            new["rrp_balance_bn"] = F.col("rrp_balance") / 1e9
            for n in (5, 10, 20):
                new[f"rrp_change{n}d"] = r.diff("rrp_balance", n)
                new[f"rrp_pct_change{n}d"] = r.pct("rrp_balance", n)
            new["rrp_z60"] = soft_z(r, "rrp_balance", 60)
        if "reserve_balances" in have:
            new["reserves_yoy"] = r.pct("reserve_balances", 252)
            new["reserves_z60"] = soft_z(r, "reserve_balances", 60)
        if "m2" in have:
            new["m2_yoy"] = r.pct("m2", 12)
        return r.add(d, new)

    return over_history(df, series, compute, depth=252)


def _weighted(df: DataFrame, weights: dict[str, float]) -> Column | None:
    usable = {c: w for c, w in weights.items() if c in df.columns}
    if not usable:
        return None
    total = sum(usable.values())
    return reduce(add, [F.col(c) * (w / total) for c, w in usable.items()])


def composites(df: DataFrame) -> DataFrame:
    """Stress, collateral-quality and momentum composites over the columns that exist."""
    new = {}
    stress, quality = _weighted(df, STRESS_WEIGHTS), _weighted(df, QUALITY_WEIGHTS)
    if stress is not None:
        new["funding_stress_index"] = stress
    if quality is not None:
        new["collateral_quality_index"] = -quality
    momentum = [F.col(c) for c in df.columns if c.endswith("_mom5d")]
    if momentum:
        new["macro_momentum"] = mean_skipping_null(momentum)
    return _add(df, new)


def finite_rows(df: DataFrame, keep: tuple[str, ...] = ("date",)) -> DataFrame:
    """Drop rows in which every feature is missing."""
    return df.dropna(how="all", subset=[c for c in df.columns if c not in keep])


def build_features(df: DataFrame, series: Series) -> DataFrame:
    df = curve_shape(level_features(df, series), series)
    df = composites(liquidity_features(spread_features(df, series), series))
    if "curve_10y2y_inverted" in df.columns:
        df = run_length(df, series, "curve_10y2y_inverted", "days_since_inversion")
    d = F.col("date")
    flags = {
        "month_end_flag": calendar.near_period_end(d, "month", 3),
        "quarter_end_flag": calendar.near_period_end(d, "quarter", 5),
        "year_end_flag": calendar.near_period_end(d, "year", 10),
    }
    return finite_rows(_add(df, flags))


def long_to_wide(df: DataFrame, names: list[str]) -> DataFrame:
    """(date, series, value) to one column per named series."""
    return df.groupBy("date").pivot("series", names).agg(F.first("value", ignorenulls=True))


def business_days(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows for every Monday-to-Friday day between the first and last date."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = span.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias(date))
    return days.where(F.weekday(date) < 5).join(df, date, "left")


def forward_fill(df: DataFrame, series: Series, columns: list[str], limit: int = 5) -> DataFrame:
    """Carry the last present value over at most ``limit`` rows."""

    def compute(d, w):
        reach = w.rowsBetween(-limit, 0)
        filled = {c: F.last(c, ignorenulls=True).over(reach).alias(c) for c in columns}
        return d.select(*[filled.get(c, F.col(c)) for c in d.columns])

    return over_history(df, series, compute, depth=limit)


def weekly_last(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Last present value of each column per week, dated by the Sunday that ends it."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns]
    weekly = df.groupBy(calendar.week_ending_sunday(F.col(date)).alias("week")).agg(*last)
    return weekly.dropna(how="all", subset=columns)


def calendar_heatmap(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.groupBy(
        F.year(d).alias("year"), F.weekofyear(d).alias("week"), F.weekday(d).alias("weekday")
    ).agg(F.avg(value).alias("value"))


def tail_rows(df: DataFrame, series: Series, n: int) -> DataFrame:
    return latest_rows(df, series, n)


def correlation_tail(df: DataFrame, columns: list[str], n: int, date: str = "date") -> DataFrame:
    """Correlations of the last n rows in long form."""
    tail = df.orderBy(F.desc(date)).limit(n)
    one = tail.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in columns for b in columns])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
        for a in columns
        for b in columns
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def transition_matrix(df: DataFrame, series: Series, label: str) -> DataFrame:
    """How often one label follows another, with the share among the label's successors."""
    ahead = over_history(
        df, series, lambda d, w: d.withColumn("__next", F.lag(label).over(w)), depth=1, descending=True
    )
    moves = (
        ahead.where(F.col("__next").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(label).alias("from_label"), F.col("__next").alias("to_label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = moves.groupBy("from_label").agg(F.sum("n").alias("total"))
    return moves.join(totals, "from_label").select("from_label", "to_label", "n", (F.col("n") / F.col("total")).alias("p"))


def segments(df: DataFrame, series: Series, label: str) -> DataFrame:
    """Runs of an unchanged label with first day, last day and length.

    Histories of any length: see ``scans``. A missing label is a run of its own.
    """
    date = series.order[0]
    return (
        with_runs(df, series, label)
        .withColumnRenamed("__run", "segment")
        .groupBy(*series.keys, "segment", label)
        .agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("n"))
    )


def regime_change_alerts(df: DataFrame, series: Series, label: str, critical: str = "Stress / Crisis") -> DataFrame:
    """A row for every change of label."""
    before = over_history(df, series, lambda d, w: d.withColumn("from_regime", F.lag(label).over(w)), depth=1)
    return before.where(F.col("from_regime") != F.col(label)).select(
        *series.keys,
        *series.order,
        "from_regime",
        F.col(label).alias("to_regime"),
        F.when(F.col(label) == critical, "CRITICAL").otherwise("WARNING").alias("severity"),
    )


def unpivot(df: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    cells = [F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in columns.items()]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def spread_spike_alerts(df: DataFrame, columns: dict[str, str], threshold: float = 2.0) -> DataFrame:
    """Targets whose z-score leaves the band, CRITICAL beyond one and a half times it."""
    z = F.abs("z_score")
    return (
        unpivot(df, ["date"], columns, "target", "z_score")
        .where(z > threshold)
        .withColumn("severity", F.when(z > threshold * 1.5, "CRITICAL").otherwise("WARNING"))
    )


# Order of severities.
SEVERITY = {"INFO": 0, "WARNING": 1, "CRITICAL": 2}


def at_least(alerts: DataFrame, floor: str, severity: str = "severity") -> DataFrame:
    """Alerts at or above a severity; an unknown severity counts as INFO."""
    level = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), F.col(severity)), F.lit(0)
    )
    return alerts.where(level >= SEVERITY[floor])


def stress_level(x: Column) -> Column:
    return F.when(x >= 2.0, "CRITICAL").when(x >= 1.0, "ELEVATED").when(x >= 0.0, "NORMAL").otherwise("LOW")


def _trailing_days(series: Series, days: int):
    return Window.partitionBy(*series.keys).orderBy(F.unix_date(series.order[0])).rangeBetween(-(days - 1), 0)


def days_inverted(df: DataFrame, series: Series, days: int = 365) -> DataFrame:
    return df.withColumn("days_inverted", F.sum("curve_10y2y_inverted").over(_trailing_days(series, days)))


def spike_flag(df: DataFrame, series: Series, column: str, days: int = 252) -> DataFrame:
    w = _trailing_days(series, days)
    limit = F.avg(column).over(w) + 2 * F.stddev_pop(column).over(w)
    return df.withColumn("alert_flag", F.when(F.col(column) > limit, "SPIKE").otherwise("NORMAL"))


def spread_forecasts(df: DataFrame, targets: list[str], horizons=(1, 3, 5, 10)) -> DataFrame:
    """One row per date, target and horizon from columns named ``<target>_<h>d``."""
    cells = [
        F.struct(F.lit(t).alias("target"), F.lit(h).alias("horizon_days"), F.col(f"{t}_{h}d").alias("forecast"))
        for t in targets
        for h in horizons
    ]
    long = df.select("date", F.explode(F.array(*cells)).alias("c")).select("date", "c.*")
    return long.withColumn("forecast_date", calendar.add_business_days(F.col("date"), F.col("horizon_days")))


def forecast_timeline(history: DataFrame, forecasts: DataFrame, series: Series, value: str, n: int = 120) -> DataFrame:
    """The last n observed rows followed by forecasts dated from the last one, with their band."""
    last = history.agg(F.max("date").alias("__last"))
    ahead = attach_one_row(forecasts, last).select(
        calendar.add_business_days(F.col("__last"), F.col("horizon_days")).alias("date"),
        "value", "lower", "upper", F.lit("forecast").alias("kind"),
    )
    nothing = F.lit(None).cast("double")
    seen = latest_rows(history, series, n).select(
        "date", F.col(value).alias("value"), nothing.alias("lower"), nothing.alias("upper"), F.lit("history").alias("kind")
    )
    return seen.unionByName(ahead)


def row_drivers(df: DataFrame, keys: list[str], columns: list[str], n: int = 3) -> DataFrame:
    """The n columns of largest absolute value in each row, largest first."""
    cells = F.array(
        *[
            F.struct((-F.abs(c)).alias("size"), F.lit(c).alias("name"), F.col(c).alias("value"))
            for c in columns
        ]
    )
    ranked = F.slice(F.array_sort(F.filter(cells, lambda s: s["value"].isNotNull())), 1, n)
    picked = df.select(*keys, ranked.alias("d"))
    return picked.select(
        *keys,
        *[
            c
            for i in range(n)
            for c in (
                F.get("d", F.lit(i))["name"].alias(f"driver_{i + 1}"),
                F.get("d", F.lit(i))["value"].alias(f"value_{i + 1}"),
            )
        ],
    )


def top_features(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n columns with the largest mean absolute value."""
    one = df.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    return unpivot(one, [], {c: c for c in columns}, "feature", "importance").orderBy(
        F.desc("importance"), "feature"
    ).limit(n)


def importance_mean(tables: list[DataFrame]) -> DataFrame:
    """Mean importance per feature over the tables of several models."""
    return reduce(DataFrame.unionByName, tables).groupBy("feature").agg(F.avg("importance").alias("importance"))


def waterfall(df: DataFrame, keys: list[str], name: str, value: str, base: float) -> DataFrame:
    """Running total from a base over a short list of contributions, smallest first."""
    w = Window.partitionBy(*keys).orderBy(F.abs(value), name)
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("step", F.row_number().over(w)).withColumn("running_total", F.lit(base) + running)


# Recommended action by regime.
PLAYBOOK = {
    "Easing / QE": "Extend loan terms, accumulate equity collateral",
    "Neutral / Normal": "Hold current allocations",
    "Hiking Cycle": "Shorten duration, increase cash collateral %",
    "Stress / Crisis": "Tighten concentration limits, increase haircuts",
    "Late Cycle / Inversion": "Reduce HY exposure, maximize liquidity buffer",
}


def regime_action(df: DataFrame, label: str) -> DataFrame:
    book = fixed_table(df.sparkSession, list(PLAYBOOK.items()), [label, "action"])
    # The playbook is a fixed list.
    return df.join(F.broadcast(book), label, "left")
