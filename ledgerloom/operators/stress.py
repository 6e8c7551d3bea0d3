"""Stress tests: every scenario against the whole book in one job.

The scenario table is short and broadcast; book rows are repeated per scenario
on the map side and combine per scenario before the shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.random import normal
from .quantiles import exact_quantiles
from .sizes import attach_one_row, broadcast_if_small

FIXED_INCOME = ("UST", "Agency", "Corp", "Muni")
INVESTMENT_GRADE = ("AAA", "AA", "A", "BBB")
CHANGEABLE = ("market_value", "haircut", "eligible", "recall_prob", "days_to_cover")
MARKET_RATES = ("sofr", "fed_funds", "repo_rate", "financing_rate")


def against(book: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every book row under every scenario, keeping the unshocked values alongside."""
    base = book.withColumns(
        {f"base_{c}": F.col(c) for c in CHANGEABLE if c in book.columns}
    ).withColumnRenamed("name", "item_name")
    return base.crossJoin(broadcast_if_small(scenarios))


def _rate_on() -> Column:
    return (F.col("rate_shift_bps") != 0) | (F.col("sofr_shock_set") != 0)


def _scaled(df: DataFrame, applies: Column, factor: Column) -> DataFrame:
    value = F.col("market_value")
    return df.withColumn("market_value", F.when(applies, value * factor).otherwise(value))


def shock_rates(df: DataFrame) -> DataFrame:
    """Reprice fixed income by modified duration."""
    applies = F.col("asset_class").isin(*FIXED_INCOME) & _rate_on()
    return _scaled(df, applies, 1 - F.col("modified_duration") * F.col("rate_shift_bps") / 10_000)


def shock_twist(df: DataFrame) -> DataFrame:
    """Shift by place on the curve: short end up to 2 years, long end from 10, straight in between."""
    tenor = F.col("modified_duration")
    short, long = F.col("short_end_shift_bps"), F.col("long_end_shift_bps")
    along = F.least(F.greatest((tenor - 2) / 8, F.lit(0.0)), F.lit(1.0))
    shift = short + (long - short) * along
    return _scaled(df, F.col("asset_class").isin(*FIXED_INCOME), 1 - tenor * shift / 10_000)


def shock_credit(df: DataFrame) -> DataFrame:
    """Reprice by spread duration: grade first, then the sector's own widening."""
    ig, hy = F.col("ig_spread_shock_bps"), F.col("hy_spread_shock_bps")
    on = (ig != 0) | (hy != 0)
    widening = F.when(F.col("rating").isin(*INVESTMENT_GRADE), ig).when(F.col("rating").isNotNull(), hy)
    duration = F.col("spread_duration")
    df = _scaled(df, on & widening.isNotNull(), 1 - duration * widening / 10_000)
    sector = F.element_at("sector_spread_shocks", F.col("gics_sector"))
    return _scaled(df, on & sector.isNotNull(), 1 - duration * sector / 10_000)


def shock_equity(df: DataFrame) -> DataFrame:
    """Uniform equity move; a name's own move takes its place."""
    own = F.element_at("name_specific_equity_shocks", F.col("ticker"))
    move = F.coalesce(own, F.col("equity_shock_pct"))
    return _scaled(df, (F.col("asset_class") == "Equity") & (F.col("equity_shock_pct") != 0), 1 + move)


def shock_liquidity(df: DataFrame) -> DataFrame:
    """Liquidation discount: half the widened spread, larger in a thin market."""
    discount = F.col("bid_ask_spread_pct") * F.col("bid_ask_multiplier") * (1 + F.col("market_depth_reduction_pct")) / 2
    return _scaled(df, F.col("bid_ask_multiplier") != 1, 1 - discount)


def shock_recall(df: DataFrame) -> DataFrame:
    """Raise recall risk where the scenario removes counterparties."""
    spill = F.col("recall_risk_spillover_factor")
    on = (F.size("remove_counterparty_ids") > 0) & (spill > 1)
    raised = F.least(F.col("recall_prob") * spill, F.lit(1.0))
    return df.withColumn("recall_prob", F.when(on, raised).otherwise(F.col("recall_prob")))


def shock_regulation(df: DataFrame, floor: bool = False) -> DataFrame:
    """Higher haircuts and excluded classes.

    ``floor=True`` reads the increase as a floor under the haircut instead of
    points added to it.
    """
    points = F.col("haircut_floor_increase_pp") / 100
    on = points != 0
    raised = F.greatest(F.col("haircut"), points) if floor else F.least(F.col("haircut") + points, F.lit(1.0))
    banned = F.col("exclude_asset_classes")
    allowed = F.when(on & (F.size(banned) > 0), ~F.array_contains(banned, F.col("asset_class"))).otherwise(
        F.col("eligible")
    )
    return df.withColumns({"haircut": F.when(points > 0, raised).otherwise(F.col("haircut")), "eligible": allowed})


def apply_all(book: DataFrame, scenarios: DataFrame) -> DataFrame:
    """All shocks in their fixed order; collateral values follow from the final values."""
    df = against(book, scenarios)
    for shock in (shock_rates, shock_credit, shock_equity, shock_liquidity, shock_recall, shock_regulation):
        df = shock(df)
    return df.withColumn("collateral_value", F.col("market_value") * (1 - F.col("haircut"))).withColumn(
        "base_collateral_value", F.col("base_market_value") * (1 - F.col("base_haircut"))
    )


def shift_market(market: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Market rates under each scenario; rates are fractions."""
    move = F.when(_rate_on(), F.col("sofr_shock_bps") / 10_000).otherwise(0.0)
    moved = market.crossJoin(broadcast_if_small(scenarios))
    return moved.withColumns({c: F.col(c) + move for c in MARKET_RATES if c in market.columns})


def surviving_loans(loans: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Loans per scenario and counterparty that remain, with surged borrow volume.

    Loans combine per counterparty first, so scenarios meet one row each.
    """
    per_counterparty = loans.groupBy("counterparty_id").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("notional").alias("notional"),
        F.sum("borrow_volume").alias("borrow_volume"),
    )
    gone = F.array_contains("remove_counterparty_ids", F.col("counterparty_id").cast("string"))
    surge = F.when(F.col("bid_ask_multiplier") != 1, F.col("demand_surge_factor")).otherwise(1.0)
    return (
        per_counterparty.crossJoin(broadcast_if_small(scenarios))
        .where(~gone)
        .select("scenario_id", "counterparty_id", "trades", "notional", (F.col("borrow_volume") * surge).alias("borrow_volume"))
    )


def metrics(stressed: DataFrame) -> DataFrame:
    """Changes against the unshocked book, one row per scenario."""
    # Constant within a scenario.
    carried = ["name", "severity", "breach_thresholds", "sofr_shock_bps", "replacement_cost_bps", "cuts"]
    kept = [F.any_value(c).alias(c) for c in carried]
    value, base = F.col("market_value"), F.col("base_market_value")
    rate, capital = F.col("financing_rate_bps"), F.col("capital_charge_est")
    by_class = (
        stressed.withColumn("cuts", (F.size("remove_counterparty_ids") > 0).cast("double"))
        .groupBy("scenario_id", "asset_class")
        .agg(
            *kept,
            F.sum(value).alias("mv"),
            F.sum(base).alias("mv0"),
            F.sum("collateral_value").alias("cv"),
            F.sum("base_collateral_value").alias("cv0"),
            F.sum(value * rate).alias("cost"),
            F.sum(base * rate).alias("cost0"),
            F.sum(value * capital).alias("capital"),
            F.sum(base * capital).alias("capital0"),
            F.sum(value * F.col("recall_prob")).alias("recall"),
            F.sum(base * F.col("base_recall_prob")).alias("recall0"),
            F.count_if(F.col("eligible")).alias("usable"),
            F.count_if(F.col("base_eligible")).alias("usable0"),
            F.sum("days_to_cover").alias("dtc"),
            F.sum("base_days_to_cover").alias("dtc0"),
            F.count("days_to_cover").alias("items"),
        )
    )
    totals = by_class.groupBy("scenario_id").agg(
        *kept,
        *[F.sum(c).alias(c) for c in by_class.columns if c not in ("scenario_id", "asset_class", *carried)],
        F.sum(F.col("mv") * F.col("mv")).alias("mv_sq"),
        F.sum(F.col("mv0") * F.col("mv0")).alias("mv0_sq"),
    )

    def hhi(squares: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(squares) / F.pow(total, F.lit(2))).otherwise(0.0)

    shortfall = F.greatest(F.lit(0.0), F.col("cv0") - F.col("cv"))
    added_bps = F.col("sofr_shock_bps") + F.col("replacement_cost_bps") * F.col("cuts")
    cost_delta = ratio(F.col("cost"), F.col("mv")) - ratio(F.col("cost0"), F.col("mv0")) + added_bps
    recall, recall0 = ratio(F.col("recall"), F.col("mv")), ratio(F.col("recall0"), F.col("mv0"))
    return totals.select(
        "scenario_id", "name", "severity", "breach_thresholds",
        shortfall.alias("collateral_shortfall_usd"),
        cost_delta.alias("financing_cost_delta_bps"),
        (F.col("capital") - F.col("capital0")).alias("capital_charge_delta_usd"),
        shortfall.alias("margin_call_estimate_usd"),
        F.coalesce(ratio(F.col("usable0") - F.col("usable"), F.col("usable0")), F.lit(0.0)).alias("eligible_pool_shrinkage_pct"),
        F.when(recall0 > 1e-9, recall / recall0).otherwise(1.0).alias("recall_risk_multiplier"),
        (hhi("mv_sq", "mv") - hhi("mv0_sq", "mv0")).alias("hhi_delta"),
        ratio(F.col("dtc") - F.col("dtc0"), F.col("items")).alias("days_to_cover_delta"),
    )


def with_pnl(table: DataFrame, notional: float = 1e9) -> DataFrame:
    """Loss from shortfall, dearer financing on the notional and a tenth of extra capital."""
    cost = F.col("financing_cost_delta_bps") / 10_000 * notional
    loss = F.col("collateral_shortfall_usd") + cost + F.col("capital_charge_delta_usd") * 0.1
    return table.withColumn("pnl_impact_usd", -loss)


BREACHABLE = (
    "collateral_shortfall_usd", "financing_cost_delta_bps", "eligible_pool_shrinkage_pct", "capital_charge_delta_usd",
)


def with_breaches(table: DataFrame) -> DataFrame:
    """Metrics over the scenario's thresholds, as a map and a flag."""
    values = F.create_map(*[x for c in BREACHABLE for x in (F.lit(c), F.col(c))])
    limits = F.col("breach_thresholds")
    over = F.map_filter(values, lambda k, v: v > F.element_at(limits, k))
    return table.withColumn("breach_details", over).withColumn("any_breach", F.size("breach_details") > 0)


def summary(stressed: DataFrame) -> DataFrame:
    return with_breaches(with_pnl(metrics(stressed))).drop("breach_thresholds")


def differences(stressed: DataFrame, key: str) -> DataFrame:
    """Row by row: stressed minus unshocked value and haircut."""
    return stressed.select(
        "scenario_id", key, "base_market_value", "market_value",
        (F.col("market_value") - F.col("base_market_value")).alias("value_change"),
        (F.col("haircut") - F.col("base_haircut")).alias("haircut_change"),
        (F.col("base_eligible") & ~F.col("eligible")).alias("became_ineligible"),
    )


def one_at_a_time(scenarios: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """Two scenarios per parameter: the first scenario's value plus and minus one sigma.

    A shift of the rate level moves the overnight rate with it.
    """
    moves = [
        F.struct(F.lit(p).alias("param"), F.lit(s).alias("sign"), F.lit(float(sigma) * s).alias("move"))
        for p, sigma in sigmas.items()
        for s in (1, -1)
    ]
    base = scenarios.orderBy("scenario_id").limit(1)
    each = base.select("*", F.explode(F.array(*moves)).alias("m"))
    moved = {p: F.when(F.col("m.param") == p, F.col(p) + F.col("m.move")).otherwise(F.col(p)) for p in sigmas}
    if "rate_shift_bps" in sigmas:
        with_level = F.when(F.col("m.param") == "rate_shift_bps", F.col("m.move")).otherwise(0.0)
        moved["sofr_shock_bps"] = F.col("sofr_shock_bps") + with_level
    return each.withColumns(moved).withColumn("scenario_id", F.concat_ws("|", "m.param", "m.sign")).drop("m")


def tornado(book: DataFrame, scenarios: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """Loss for a sigma up and down in each parameter."""
    runs = with_pnl(metrics(apply_all(book, one_at_a_time(scenarios, sigmas))))
    part = F.split("scenario_id", r"\|")
    return runs.groupBy(part[0].alias("param")).agg(
        F.max(F.when(part[1] == "1", F.col("pnl_impact_usd"))).alias("up_impact"),
        F.max(F.when(part[1] == "-1", F.col("pnl_impact_usd"))).alias("dn_impact"),
    )


def tornado_top(table: DataFrame, n: int = 15) -> DataFrame:
    return table.orderBy(F.desc(F.abs("up_impact")), F.desc(F.abs("dn_impact")), "param").limit(n)


SCALABLE = (
    "rate_shift_bps", "sofr_shock_bps", "ig_spread_shock_bps", "hy_spread_shock_bps", "equity_shock_pct",
    "haircut_floor_increase_pp",
)


def reverse_stress(book: DataFrame, scenario: DataFrame, metric: str, limit: float, points: int = 10) -> DataFrame:
    """Smallest share of a scenario that takes a metric over a limit, to 1/points squared.

    A coarse pass finds the first breaching step, a second pass searches inside
    it; the loss grows with the share. NULL when the whole scenario stays within.
    """

    def first_breach(shares: DataFrame) -> DataFrame:
        scaled = {c: F.col(c) * F.col("share") for c in SCALABLE}
        scaled["bid_ask_multiplier"] = 1 + (F.col("bid_ask_multiplier") - 1) * F.col("share")
        runs = shares.withColumns(scaled).withColumn("scenario_id", F.col("share").cast("string"))
        over = F.when(F.col(metric) > limit, F.col("scenario_id").cast("double"))
        return metrics(apply_all(book, runs.drop("share"))).agg(F.min(over).alias("share"))

    steps = F.sequence(F.lit(1), F.lit(points))
    coarse = scenario.select("*", F.explode(F.transform(steps, lambda i: i / points)).alias("share"))
    found = first_breach(coarse).withColumnRenamed("share", "__found")
    inner = F.transform(steps, lambda i: F.round(F.col("__found") - 1 / points + i / (points * points), 6))
    fine = scenario.crossJoin(F.broadcast(found)).select("*", F.explode(inner).alias("share")).drop("__found")
    return first_breach(fine)


def factor_changes(market: DataFrame, factors: list[str], w) -> DataFrame:
    return market.select("date", *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in factors]).dropna()


def covariance(changes: DataFrame, factors: list[str]) -> DataFrame:
    """Sample covariance of every pair of factors, as one row of columns ``a|b``."""
    return changes.agg(
        *[F.covar_samp(a, b).alias(f"{a}|{b}") for i, a in enumerate(factors) for b in factors[: i + 1]]
    )


def covariance_long(changes: DataFrame, factors: list[str]) -> DataFrame:
    one = covariance(changes, factors)
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov"))
        for i, a in enumerate(factors)
        for b in factors[: i + 1]
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def cholesky(one: DataFrame, factors: list[str]) -> DataFrame:
    """Lower factor of the covariance row as columns ``L<i><j>``, built as expressions."""
    for i, a in enumerate(factors):
        for j, b in enumerate(factors[: i + 1]):
            inner = reduce(add, [F.col(f"L{i}{k}") * F.col(f"L{j}{k}") for k in range(j)], F.lit(0.0))
            rest = F.col(f"`{a}|{b}`") - inner
            value = F.sqrt(F.greatest(rest, F.lit(0.0))) if i == j else F.coalesce(ratio(rest, F.nullif(f"L{j}{j}", F.lit(0.0))), F.lit(0.0))
            one = one.withColumn(f"L{i}{j}", value)
    return one


def sensitivities(book: DataFrame) -> DataFrame:
    """First-order value change of the collateral per unit of rate, spread and equity move."""
    held = F.col("market_value") * (1 - F.col("haircut"))
    return book.agg(
        F.sum(F.when(F.col("asset_class").isin(*FIXED_INCOME), -held * F.col("modified_duration"))).alias("to_rate"),
        F.sum(-held * F.col("spread_duration")).alias("to_spread"),
        F.sum(F.when(F.col("asset_class") == "Equity", held)).alias("to_equity"),
    )


def simulate(book: DataFrame, changes: DataFrame, factors: list[str], units: list[float], draws: int, seed: int = 42) -> DataFrame:
    """P&L of correlated draws: ``factors`` are rate, spread and equity, scaled by ``units``."""
    one = cholesky(covariance(changes, factors), factors).crossJoin(F.broadcast(sensitivities(book)))
    ids = book.sparkSession.range(draws)
    ids = ids.withColumns({f"z{k}": normal(seed + k, F.col("id")) for k in range(len(factors))})
    shocked = attach_one_row(ids, one)
    moves = [
        reduce(add, [F.col(f"L{i}{k}") * F.col(f"z{k}") for k in range(i + 1)]) * units[i] for i in range(len(factors))
    ]
    effects = ("to_rate", "to_spread", "to_equity")
    pnl = reduce(add, [F.col(e) * m for e, m in zip(effects, moves)])
    return shocked.select("id", pnl.alias("pnl"))


def var_es(pnl: DataFrame, column: str = "pnl") -> DataFrame:
    """Value at risk at 95 and 99 percent and the mean loss at or beyond it."""
    cuts = exact_quantiles(pnl, column, {"var_95": 0.05, "var_99": 0.01})
    x = F.col(column)
    return attach_one_row(pnl, cuts).agg(
        F.max("var_95").alias("var_95"),
        F.avg(F.when(x <= F.col("var_95"), x)).alias("es_95"),
        F.max("var_99").alias("var_99"),
        F.avg(F.when(x <= F.col("var_99"), x)).alias("es_99"),
    )
