"""Collateral allocation: weights that minimise cost under caps.

The linear program has one equality (weights sum to 1), a cap per asset type,
and a few pool-wide limits. For given prices on the pool-wide limits what is
left is solved exactly by sorting: take the cheapest item of every type, fill
types in order of cost until the weights sum to 1. Prices are refined until the
blend of such fills is the optimum; each round is one aggregation of the pool.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import lineage_cut
from .simplex import simplex
from .sizes import attach_one_row, broadcast_if_small, fixed_table


def cheapest_per_type(pool: DataFrame, cost: Column, by: str = "asset_class", extra: list[str] | None = None) -> DataFrame:
    """Cheapest eligible item of each type; equal costs go to the lower id."""
    extra = extra or []
    row = F.struct("collateral_id", cost.alias("unit_cost"), *extra)
    return (
        pool.where("eligible")
        .groupBy(by)
        .agg(F.min_by(row, F.struct(cost, F.col("collateral_id"))).alias("r"))
        .select(by, "r.*")
    )


def fill_in_order(best: DataFrame, cap: float, keys: list[str]) -> DataFrame:
    """Give each type, cheapest first, up to the cap until the weights of a run sum to 1.

    ``best`` has one row per type and run; types are a short list.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = w.orderBy("unit_cost", "asset_class").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.lit(cap)).over(before), F.lit(0.0))
    weight = F.least(F.lit(cap), F.greatest(F.lit(0.0), 1 - used))
    enough = F.count(F.lit(1)).over(w) * F.lit(cap) >= 1 - 1e-9
    return best.withColumn("allocation_weight", F.when(enough, weight).otherwise(0.0))


def allocate(pool: DataFrame, cost: Column, cap: float = 0.30) -> DataFrame:
    """Weights for the whole pool without pool-wide limits; all zero when the caps cannot reach 1."""
    filled = fill_in_order(cheapest_per_type(pool, cost), cap, [])
    # One row per asset type.
    chosen = broadcast_if_small(filled.select("collateral_id", "allocation_weight"))
    weight = F.coalesce("allocation_weight", F.lit(0.0))
    return (
        pool.join(chosen, "collateral_id", "left")
        .withColumn("allocation_weight", weight)
        .withColumn("recommended", F.col("allocation_weight") > 1e-4)
    )


def allocate_within_limits(
    pool: DataFrame, cost: Column, cap: float, limits: dict[str, tuple[str, float]], tolerance: float = 1e-9, most_rounds: int = 200
) -> DataFrame:
    """The cheapest allocation under caps and pool-wide limits, for the whole pool.

    ``limits`` maps a column to ('max' or 'min', bound) on its weighted mean. Adds
    allocation_weight, recommended, status and gap (the distance to the dual
    bound). Where no weights keep the limits all of them are zero and the status
    is ``infeasible``.

    Column generation: prices on the limits give the cheapest fill by one
    aggregation of the pool, a blend of the fills so far gives new prices, and
    both end when no fill is cheaper at its own prices. Blends are of at most one
    fill more than there are limits.
    """
    names = list(limits)
    sign = {c: 1.0 if kind == "max" else -1.0 for c, (kind, _) in limits.items()}
    bounds = np.array([sign[c] * limits[c][1] for c in names])
    # Every round reads these columns again.
    priced = lineage_cut(
        pool.where("eligible").select(
            "collateral_id", "asset_class", cost.alias("__cost"), *(F.col(c) * F.lit(sign[c]) for c in names)
        ).toDF("collateral_id", "asset_class", "__cost", *[f"__a{j}" for j in range(len(names))]),
        "priced",
    )
    status, mix, gap = _generate(priced, cap, bounds, tolerance, most_rounds)
    weights: dict = {}
    for share, fill in mix:
        for item, weight in fill.items.items():
            weights[item] = weights.get(item, 0.0) + share * weight
    # At most one item of each type for each fill of the blend.
    rows = [(i, w) for i, w in sorted(weights.items()) if w > 0] or [(None, 0.0)]
    kind = pool.schema["collateral_id"].dataType
    chosen = fixed_table(pool.sparkSession, rows, ["collateral_id", "allocation_weight"])
    chosen = chosen.withColumn("collateral_id", F.col("collateral_id").cast(kind))
    weight = F.coalesce("allocation_weight", F.lit(0.0))
    return (
        pool.join(F.broadcast(chosen), "collateral_id", "left")
        .withColumn("allocation_weight", weight)
        .withColumn("recommended", F.col("allocation_weight") > 1e-4)
        .withColumn("status", F.lit(status))
        .withColumn("gap", F.lit(gap).cast("double"))
    )


@dataclass
class Fill:
    """One way to fill the types: item weights, its cost and its means of the limited columns."""

    items: dict
    cost: float
    means: np.ndarray


def _fills(priced: DataFrame, cap: float, prices: list[tuple[float, np.ndarray]]) -> list[Fill]:
    """The cheapest fill for each (weight of the cost, prices of the limits), in one aggregation.

    What comes back is one item for each type and price; types are a short list.
    """
    limited = [c for c in priced.columns if c.startswith("__a")]
    item = F.struct("collateral_id", "__cost", *limited)
    best = []
    for n, (weight, price) in enumerate(prices):
        reduced = sum((F.col(c) * float(v) for c, v in zip(limited, price)), F.col("__cost") * float(weight))
        best.append(F.min_by(F.struct(reduced.alias("r"), item.alias("i")), F.struct(reduced, F.col("collateral_id"))).alias(f"p{n}"))
    rows = priced.groupBy("asset_class").agg(*best).collect()
    out = []
    for n in range(len(prices)):
        left, items, cost, means = 1.0, {}, 0.0, np.zeros(len(limited))
        for row in sorted(rows, key=lambda r: (r[f"p{n}"]["r"], r["asset_class"])):
            weight = min(cap, left)
            left -= weight
            if weight > 0:
                found = row[f"p{n}"]["i"]
                items[found["collateral_id"]] = weight
                cost += weight * found["__cost"]
                means += weight * np.array([found[c] for c in limited])
        if left <= 1e-9:
            out.append(Fill(items, cost, means))
    return out


def _blend(fills: list[Fill], bounds: np.ndarray, feasible: bool):
    """The best blend of fills: (value, shares, price of one unit of weight, prices of the limits).

    With ``feasible`` the value is the cost of a blend inside the limits, else how
    far a blend is outside of them.
    """
    k = len(bounds)
    runs = np.array([[1.0, *f.means] for f in fills]).T
    slack = np.vstack([np.zeros(k), np.eye(k)])
    costs = np.array([f.cost if feasible else 0.0 for f in fills])
    # Beyond a limit: counted as such, or too dear to stay.
    beyond = 1e6 * (1.0 + np.abs(costs).max()) if feasible else 1.0
    values = np.concatenate([costs, np.zeros(k), np.full(k, beyond)])
    over = fills[0].means > bounds
    start = [0, *(len(fills) + j + k * int(over[j]) for j in range(k))]
    basis, x, y = simplex(np.hstack([runs, slack, -slack]), np.concatenate([[1.0], bounds]), values, start)
    share = np.zeros(len(values))
    share[basis] = np.maximum(x, 0)
    return float(share @ values), share[: len(fills)], y[0], np.maximum(-y[1:], 0)


def _generate(priced: DataFrame, cap: float, bounds: np.ndarray, tolerance: float, most_rounds: int):
    """(status, [(share, fill)], gap) by column generation: first towards the limits, then towards the least cost."""
    k = len(bounds)
    fills = _fills(priced, cap, [(1.0, np.zeros(k)), *((0.0, unit) for unit in np.eye(k))])
    if not fills:
        return "infeasible", [], None
    feasible = False
    for _ in range(most_rounds):
        value, shares, unit, prices = _blend(fills, bounds, feasible)
        if not feasible and value <= tolerance:
            feasible = True
            continue
        new = _fills(priced, cap, [(1.0 if feasible else 0.0, prices)])[0]
        reached = (new.cost if feasible else 0.0) + float(prices @ new.means)
        if reached >= unit - tolerance:
            if not feasible:
                return "infeasible", [], None
            gap = value - (reached - float(prices @ bounds))
            return "optimal", [(s, f) for s, f in zip(shares, fills) if s > 0], max(gap, 0.0)
        fills.append(new)
    raise ArithmeticError(f"no optimum after {most_rounds} rounds")


def recommendations(allocated: DataFrame, cost: str = "cost_of_carry") -> DataFrame:
    """Recommended rows with their cost and savings against equal weights."""
    mean = allocated.agg((F.sum(F.coalesce(cost, F.lit(0.0))) / F.count(F.lit(1))).alias("__mean"))
    own = F.coalesce(cost, F.lit(0.0)) * F.col("allocation_weight")
    return (
        attach_one_row(allocated.where("recommended"), mean)
        .withColumn("optimization_cost", own)
        .withColumn("cost_savings_bps", F.round((F.col("__mean") - F.col("optimization_cost")) * 10_000, 4))
        .drop("__mean")
    )


def totals(allocated: DataFrame) -> DataFrame:
    """Weighted cost, fee, capital and recall of an allocation."""
    x = F.col("allocation_weight")
    return allocated.agg(
        F.sum(x * F.col("financing_cost")).alias("total_cost"),
        F.sum(x * F.col("fee_rate")).alias("fee_revenue"),
        F.sum(x * F.col("capital_charge_est")).alias("capital_charge"),
        F.sum(x * F.col("recall_prob")).alias("recall_risk_weighted"),
    )


def blended_cost(weights: tuple[float, float, float, float]) -> Column:
    """Cost minus fees plus capital plus recall risk, each with its weight."""
    cost, fee, capital, recall = (float(w) for w in weights)
    return (
        cost * F.col("financing_cost")
        - fee * F.col("fee_rate")
        + capital * F.col("capital_charge_est")
        + recall * F.col("recall_prob")
    )


def normalise_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raise weights to at least 1e-6 and scale each row to sum to 1."""
    lifted = {c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)) for c in columns}
    total = sum(list(lifted.values())[1:], lifted[columns[0]])
    return df.withColumns({c: v / total for c, v in lifted.items()})


def allocation_alerts(runs: DataFrame, limit: float = 0.15) -> DataFrame:
    """Alerts of solved runs: a failed solve, and weighted recall risk over the limit."""
    failed = F.when(
        F.col("status") != "optimal",
        F.struct(F.lit("OPTIMIZATION_FAILURE").alias("alert_type"), F.lit("CRITICAL").alias("severity"),
                 F.format_string("No allocation was found: %s", F.col("status")).alias("message")),
    )
    risky = F.when(
        F.col("recall_risk_weighted") > limit,
        F.struct(F.lit("HIGH_RECALL_RISK").alias("alert_type"), F.lit("WARNING").alias("severity"),
                 F.format_string("The allocation recalls %.3f of its weight", F.col("recall_risk_weighted")).alias("message")),
    )
    return runs.select("*", F.explode(F.array_compact(F.array(failed, risky))).alias("a")).select(
        *runs.columns, "a.*"
    )


def recall_class(p: Column, threshold: float = 0.3) -> Column:
    return (p >= threshold).cast("int")
