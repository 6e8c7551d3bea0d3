"""Allocations of many portfolios under many scenarios at once, each with its own limits kept.

Every key (a portfolio, a portfolio under a scenario) has the linear program of
``allocation.allocate_within_limits``: weights that sum to 1, a cap per asset type,
and limits on weighted means. All keys are solved together by column generation:

* a round goes over the whole pool in three passes that hash, sort nothing and write
  a few rows: the least price of every key and type at the key's own prices for its
  limits, the lowest item that has it, and that item;
* the items found so far, some hundred a key, make a small program that a simplex
  in a task solves; its prices are the next round's;
* the cheapest items of a round also give a bound that no weights of the key can
  beat. A key is done when its cost is at its bound, and leaves the next rounds.

Nothing of a key passes through the driver, which only asks how many are open.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lineage_cut
from .allocation import fill_in_order
from .simplex import simplex
from .sizes import broadcast_if_small

SHARE = "array<struct<item:string,asset_class:string,weight:double>>"
STATE = "status string, cost double, bound double, prices array<double>, p array<double>, q array<double>, phase int, shares " + SHARE


@dataclass(frozen=True)
class Terms:
    """Caps and limits; each limit is an upper bound after its sign."""

    cap: float
    names: tuple[str, ...]
    signs: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, cap: float, limits: dict[str, tuple[str, float]]) -> Terms:
        signs = np.array([1.0 if kind == "max" else -1.0 for kind, _ in limits.values()])
        return cls(cap, tuple(limits), signs, signs * np.array([bound for _, bound in limits.values()], float))


def solved(costs: np.ndarray, means: np.ndarray, types: np.ndarray, terms: Terms):
    """(phase, value, prices of the limits, weights) for the items at hand.

    Phase 1 while they cannot keep the limits: the value then says by how much, and
    the prices weigh the limits that are missed. Phase 2: the least cost.
    """
    n, k = means.shape
    kinds, kind = np.unique(types, return_inverse=True)
    t = len(kinds)
    # Rows: the sum, a cap for each type, the limits in units of their own size.
    unit = np.maximum(np.maximum(np.abs(means).max(axis=0, initial=0), np.abs(terms.bounds)), 1e-12)
    rows = np.zeros((1 + t + k, n + t + k))
    rows[0, :n] = 1.0
    rows[1 + kind, np.arange(n)] = 1.0
    rows[1 + t :, :n] = (means / unit).T
    rows[1 : 1 + t + k, n:] = np.eye(t + k)
    right = np.concatenate([[1.0], np.full(t, terms.cap), terms.bounds / unit])
    sign = np.where(right < 0, -1.0, 1.0)
    rows, right = rows * sign[:, None], right * sign
    lacking = [0, *(np.flatnonzero(sign < 0))]
    helpers = np.zeros((len(right), len(lacking)))
    helpers[lacking, np.arange(len(lacking))] = 1.0
    wide = np.hstack([rows, helpers])
    helper = {row: rows.shape[1] + i for i, row in enumerate(lacking)}
    basis = [helper[r] if r in helper else n + r - 1 for r in range(len(right))]
    missed = np.concatenate([np.zeros(rows.shape[1]), np.ones(len(lacking))])
    basis, x, y = simplex(wide, right, missed, basis)
    value, phase = float(missed[basis] @ np.maximum(x, 0.0)), 1
    if value <= 1e-9:
        # Helpers still in the basis are at zero, and too dear to come back.
        dear = np.concatenate([costs, np.zeros(t + k), np.full(len(lacking), 1e6 * (1.0 + np.abs(costs).max(initial=0)))])
        basis, x, y = simplex(wide, right, dear, basis)
        value, phase = float(dear[:n][[i for i in basis if i < n]] @ x[[j for j, i in enumerate(basis) if i < n]]), 2
    weights = np.zeros(wide.shape[1])
    weights[basis] = np.maximum(x, 0.0)
    prices = np.maximum(-(y * sign)[1 + t :] / unit, 0.0)
    return phase, value, prices, weights[:n]


def _next_state(group: pd.DataFrame, keys: list[str], terms: Terms, tolerance: float) -> pd.DataFrame:
    """One key's state after a round: its items, and the bounds that the round's prices gave."""
    first = group.iloc[0]
    out = {c: first[c] for c in keys}
    best, bound = None, None
    for prices, reached in ((first["p"], first["at_p"]), (first["q"], first["at_q"]), (first["prices"], first["bound"])):
        if prices is not None and reached is not None and np.isfinite(reached) and (bound is None or reached > bound):
            best, bound = np.asarray(prices, float), float(reached)
    empty = {"shares": [], "p": None, "q": None, "prices": None if best is None else list(best)}
    if first["phase"] == 1 and bound is not None and bound > tolerance:
        return pd.DataFrame([{**out, **empty, "status": "infeasible", "cost": None, "bound": None, "phase": 1}])
    phase, value, prices, weights = solved(
        group["unit_cost"].to_numpy(float), np.stack(group["means"].to_numpy()).reshape(len(group), len(terms.bounds)),
        group["asset_class"].to_numpy(str), terms,
    )
    if phase != first["phase"]:
        best, bound = None, None
    # A step back towards the best prices so far keeps the next ones from swinging.
    q = prices if best is None else (prices + best) / 2
    size = max(float(group["unit_cost"].abs().max()), 1e-300)
    status = "optimal" if phase == 2 and bound is not None and value - bound <= tolerance * size else "open"
    used = np.flatnonzero(weights > 1e-12)
    shares = [{"item": str(group["item"].iloc[i]), "asset_class": str(group["asset_class"].iloc[i]), "weight": float(weights[i])} for i in used]
    state = {"status": status, "cost": value if phase == 2 else None, "bound": bound, "prices": None if best is None else list(best)}
    return pd.DataFrame([{**out, **state, "p": list(prices), "q": list(q), "phase": phase, "shares": shares if phase == 2 else []}])


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    renamed = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(broadcast_if_small(renamed), on, how).drop(*[f"__{k}" for k in keys])


def allocate_each(
    pool: DataFrame, keys: list[str], cost: Column, cap: float, limits: dict[str, tuple[str, float]],
    tolerance: float = 1e-9, most_rounds: int = 100,
) -> DataFrame:
    """One row for each key of ``pool``: status, cost, bound, gap, prices and shares.

    ``limits`` maps a column to ('max' or 'min', bound) on its weighted mean.
    ``shares`` lists the items with weight; ``bound`` is what no weights of the key
    can beat, shown by ``prices``; ``gap`` is the distance to it. Keys whose caps or
    limits cannot be kept are ``infeasible`` and have no shares. A key still open
    after ``most_rounds`` is ``unfinished`` and has its best weights and its gap.
    Items that are not eligible, and items without a cost or without a value of a
    limited column, take no part; equal costs go to the lower id. ``tolerance`` is a
    share of the largest cost among the items a key was solved with. The pool is read
    some times a round and never written: what is dear to derive is written before.
    """
    terms = Terms.of(cap, limits)
    k = len(terms.names)
    parts = [(F.col(c).cast("double") * float(s)).alias(f"__m{j}") for j, (c, s) in enumerate(zip(terms.names, terms.signs))]
    means = F.array(*(F.col(f"__m{j}") for j in range(k))) if k else F.array().cast("array<double>")
    priced = pool.where("eligible").select(
        *keys, F.col("collateral_id").alias("item_id"), F.col("collateral_id").cast("string").alias("item"), F.col("asset_class").cast("string"),
        cost.cast("double").alias("unit_cost"), *parts,
    )
    priced = priced.dropna(subset=["unit_cost", "asset_class", *(f"__m{j}" for j in range(k))])
    every = pool.select(*keys).distinct()
    enough = priced.groupBy(*keys).agg(F.countDistinct("asset_class").alias("types")).where(F.col("types") * cap >= 1 - 1e-9)
    enough = lineage_cut(enough, "enough")

    def dot(prices, values):
        return F.aggregate(F.zip_with(prices, values, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def cheapest(rows: DataFrame, reduced: dict[str, Column]) -> DataFrame:
        """The cheapest item of each key and type at each of the prices, of equal ones the lower id."""
        part = [*keys, "asset_class"]
        least = lineage_cut(rows.groupBy(*part).agg(*[F.min(r).alias(f"least_{n}") for n, r in reduced.items()]), "least")
        lowest = [F.min(F.when(r == F.col(f"least_{n}"), F.col("item_id"))).alias(f"id_{n}") for n, r in reduced.items()]
        ids = _same(rows, least, part).groupBy(*part).agg(*lowest)
        wanted = lineage_cut(ids.select(*part, F.explode(F.array(*(F.col(f"id_{n}") for n in reduced))).alias("item_id")).distinct(), "lowest")
        rows = _same(rows, wanted, [*part, "item_id"], "left_semi")
        item = F.struct("item", "unit_cost", means.alias("means"))
        picks = [F.min_by(F.struct(r.alias("reduced"), item.alias("i")), F.struct(r, F.col("item_id"))).alias(n) for n, r in reduced.items()]
        return lineage_cut(rows.groupBy(*keys, "asset_class").agg(*picks), "cheapest")

    def found(best: DataFrame, names: list[str]) -> DataFrame:
        picked = best.select(*keys, "asset_class", F.explode(F.array(*(F.col(n)["i"] for n in names))).alias("i"))
        return picked.select(*keys, "asset_class", "i.*").distinct()

    def reached(best: DataFrame, name: str) -> DataFrame:
        """What the cheapest fill at the prices costs: a bound, once the prices of the bounds are taken off."""
        filled = fill_in_order(best.select(*keys, "asset_class", F.col(name)["reduced"].alias("unit_cost")), cap, keys)
        return filled.groupBy(*keys).agg(F.sum(F.col("allocation_weight") * F.col("unit_cost")).alias(f"at_{name}"))

    open_keys = _same(priced, enough.select(*keys), keys, "left_semi") if keys else priced
    units = {"c": F.col("unit_cost")} | {f"l{j}": F.col(f"__m{j}") for j in range(k)}
    items = found(cheapest(open_keys, units), list(units))
    none = "CAST(NULL AS ARRAY<DOUBLE>)"
    state = enough.select(*keys).selectExpr(
        *keys, f"{none} AS p", f"{none} AS q", f"{none} AS prices", "CAST(NULL AS DOUBLE) AS bound", "CAST(NULL AS DOUBLE) AS at_p",
        "CAST(NULL AS DOUBLE) AS at_q", "1 AS phase",
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in every.schema) + ", " + STATE
    limit_of = F.array(*(F.lit(float(b)) for b in terms.bounds)) if k else F.array().cast("array<double>")
    ended = None
    for round_ in range(most_rounds):
        # Few rows and much work for each: a number keeps adaptive execution from gathering all keys in one task.
        tasks = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        solve = _same(items, state, keys).repartition(tasks, *keys).groupBy(*keys)
        now = lineage_cut(solve.applyInPandas(lambda g: _next_state(g, keys, terms, tolerance), schema), "solved")
        done = now.where("status <> 'open'") if round_ < most_rounds - 1 else now
        ended = done if ended is None else ended.unionByName(done)
        state = now.where("status = 'open'")
        if state.isEmpty():
            break
        if round_ == most_rounds - 1:
            break
        weight = F.when(F.col("phase") == 2, F.col("unit_cost")).otherwise(0.0)
        asked = _same(open_keys, state.select(*keys, "p", "q", "phase"), keys)
        best = cheapest(asked, {n: weight + sum((F.col(n)[j] * F.col(f"__m{j}") for j in range(k)), F.lit(0.0)) for n in ("p", "q")})
        items = lineage_cut(_same(items.unionByName(found(best, ["p", "q"])).distinct(), state.select(*keys), keys, "left_semi"), "items")
        for name in ("p", "q"):
            state = _same(state, reached(best, name), keys)
            state = state.withColumn(f"at_{name}", F.col(f"at_{name}") - dot(F.col(name), limit_of))
    ended = ended.withColumn("status", F.when(F.col("status") == "open", "unfinished").otherwise(F.col("status")))
    out = _same(every, ended.drop("p", "q", "phase"), keys, "left")
    return out.withColumns(
        {
            "status": F.coalesce("status", F.lit("infeasible")),
            "gap": F.greatest(F.col("cost") - F.col("bound"), F.lit(0.0)),
            "shares": F.coalesce("shares", F.array().cast(SHARE)),
        }
    )


def with_weights(pool: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """The pool with each item's allocation_weight in its key's run, and the run's status."""
    shares = runs.select(*keys, F.explode("shares").alias("s")).select(*keys, F.col("s.item").alias("__item"), F.col("s.weight").alias("w"))
    # A few rows for each key: written, so that their size is known and the pool stays where it is.
    named = lineage_cut(shares, "shares").withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("collateral_id").cast("string") == F.col("__item")]
    out = pool.join(broadcast_if_small(named), on, "left").drop("__item", *[f"__{k}" for k in keys])
    out = _same(out, runs.select(*keys, "status"), keys)
    weight = F.coalesce("w", F.lit(0.0))
    return out.withColumn("allocation_weight", weight).withColumn("recommended", weight > 1e-4).drop("w")


def checked(pool: DataFrame, runs: DataFrame, keys: list[str], cost: Column, cap: float, limits: dict[str, tuple[str, float]], slack: float = 1e-7) -> DataFrame:
    """What each run has to show, worked out from the whole pool: invested, inside, capped, and the distance to its dual bound.

    The bound follows from the run's prices alone: the cheapest fill of all eligible
    items at these prices, less what the limits are worth. No weights cost less.
    """
    signs = {c: 1.0 if kind == "max" else -1.0 for c, (kind, _) in limits.items()}
    weighed = with_weights(pool, runs, keys)
    x = F.col("allocation_weight")
    types = weighed.groupBy(*keys, "asset_class").agg(
        F.sum(x).alias("w"), F.count(F.lit(1)).alias("n"), F.sum(x * cost).alias("c"), *(F.sum(x * F.col(c)).alias(f"m_{c}") for c in limits)
    )
    inside = [F.sum(f"m_{c}") * signs[c] <= signs[c] * limits[c][1] + slack for c in limits]
    shown = types.groupBy(*keys).agg(
        F.sum("w").alias("invested"), F.every(F.col("w") <= cap + 1e-9).alias("capped"), F.sum("c").alias("cost_of_weights"), F.sum("n").alias("items"),
        *(hit.alias(f"in_{i}") for i, hit in enumerate(inside)),
    )
    priced = _same(pool.where("eligible"), runs.select(*keys, "prices"), keys)
    reduced = sum((F.col("prices")[i] * F.col(c) * signs[c] for i, c in enumerate(limits)), cost)
    best = priced.groupBy(*keys, "asset_class", "prices").agg(F.min(reduced).alias("unit_cost"))
    worth = sum((F.col("prices")[i] * signs[c] * limits[c][1] for i, c in enumerate(limits)), F.lit(0.0))
    filled = fill_in_order(best, cap, keys).groupBy(*keys).agg((F.sum(F.col("allocation_weight") * F.col("unit_cost")) - F.max(worth)).alias("dual"))
    kept = F.lit(True)
    for i in range(len(inside)):
        kept = kept & F.col(f"in_{i}")
    out = _same(_same(runs.select(*keys, "status"), shown, keys), filled, keys, "left")
    return out.select(*keys, "status", "invested", kept.alias("inside"), "capped", (F.col("cost_of_weights") - F.col("dual")).alias("distance"), "cost_of_weights", "items")
