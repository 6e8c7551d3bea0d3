"""Stress scenarios as a table: one row per scenario."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
    scenario_id: string, name: string, severity: string,
    shocks: struct<
        rate_shift_bps: double, sofr_shock_bps: double, short_end_shift_bps: double, long_end_shift_bps: double,
        ig_spread_shock_bps: double, hy_spread_shock_bps: double, sector_spread_shocks: map<string, double>,
        equity_shock_pct: double, name_specific_equity_shocks: map<string, double>,
        bid_ask_multiplier: double, market_depth_reduction_pct: double, demand_surge_factor: double,
        remove_counterparty_ids: array<string>, recall_risk_spillover_factor: double, replacement_cost_bps: double,
        haircut_floor_increase_pp: double, exclude_asset_classes: array<string>>,
    breach_thresholds: map<string, double>
"""
# Accepted severities.
SEVERITIES = ["Moderate", "Severe", "Extreme", "Regulatory"]
# Value of a shock that a scenario does not set.
NEUTRAL = {
    "rate_shift_bps": 0.0,
    "ig_spread_shock_bps": 0.0,
    "hy_spread_shock_bps": 0.0,
    "equity_shock_pct": 0.0,
    "bid_ask_multiplier": 1.0,
    "market_depth_reduction_pct": 0.0,
    "demand_surge_factor": 1.0,
    "recall_risk_spillover_factor": 1.0,
    "replacement_cost_bps": 0.0,
    "haircut_floor_increase_pp": 0.0,
}
# Thresholds of a scenario that sets none.
DEFAULT_THRESHOLDS = {
    "collateral_shortfall_usd": 10_000_000.0,
    "financing_cost_delta_bps": 50.0,
    "eligible_pool_shrinkage_pct": 0.15,
    "capital_charge_delta_usd": 5_000_000.0,
}
TOP_COUNTERPARTY = "TOP_1_COUNTERPARTY_BY_NOTIONAL"

# The six standard scenarios.
STANDARD = [
    {
        "scenario_id": "S01", "name": "Base Case", "severity": "Moderate",
        "shocks": {"sofr_shock_bps": 0.0},
        "breach_thresholds": {
            "collateral_shortfall_usd": 1e7, "financing_cost_delta_bps": 50.0, "eligible_pool_shrinkage_pct": 0.15,
        },
    },
    {
        "scenario_id": "S02", "name": "Rate Shock +200bps", "severity": "Severe",
        "shocks": {
            "rate_shift_bps": 200.0, "sofr_shock_bps": 200.0, "short_end_shift_bps": 200.0, "long_end_shift_bps": 200.0,
            "ig_spread_shock_bps": 30.0, "hy_spread_shock_bps": 100.0, "equity_shock_pct": -0.08,
            "bid_ask_multiplier": 1.5, "market_depth_reduction_pct": 0.15,
        },
        "breach_thresholds": {
            "collateral_shortfall_usd": 5e6, "financing_cost_delta_bps": 150.0, "eligible_pool_shrinkage_pct": 0.10,
            "capital_charge_delta_usd": 2e6,
        },
    },
    {
        "scenario_id": "S05", "name": "Credit Crunch 2008", "severity": "Extreme",
        "shocks": {
            "rate_shift_bps": -100.0, "sofr_shock_bps": -50.0, "short_end_shift_bps": -150.0, "long_end_shift_bps": -50.0,
            "ig_spread_shock_bps": 400.0, "hy_spread_shock_bps": 1500.0,
            "sector_spread_shocks": {"Financials": 600.0, "Real Estate": 800.0},
            "equity_shock_pct": -0.38, "name_specific_equity_shocks": {"C": -0.70, "BAC": -0.65, "GS": -0.55},
            "bid_ask_multiplier": 8.0, "market_depth_reduction_pct": 0.65, "demand_surge_factor": 0.40,
            "remove_counterparty_ids": ["COUNTERPARTY_LEHMAN"], "recall_risk_spillover_factor": 3.0,
            "replacement_cost_bps": 50.0, "haircut_floor_increase_pp": 5.0,
            "exclude_asset_classes": ["MBS_Non_Agency", "CDO"],
        },
        "breach_thresholds": {
            "collateral_shortfall_usd": 1e6, "financing_cost_delta_bps": 20.0, "eligible_pool_shrinkage_pct": 0.05,
            "capital_charge_delta_usd": 1e6,
        },
    },
    {
        "scenario_id": "S08", "name": "Top-1 Counterparty Default", "severity": "Severe",
        "shocks": {
            "sofr_shock_bps": 25.0, "ig_spread_shock_bps": 80.0, "hy_spread_shock_bps": 200.0, "equity_shock_pct": -0.05,
            "bid_ask_multiplier": 2.5, "market_depth_reduction_pct": 0.25, "demand_surge_factor": 1.2,
            "remove_counterparty_ids": [TOP_COUNTERPARTY], "recall_risk_spillover_factor": 2.0,
            "replacement_cost_bps": 20.0,
        },
        "breach_thresholds": {
            "collateral_shortfall_usd": 5e6, "financing_cost_delta_bps": 30.0, "eligible_pool_shrinkage_pct": 0.08,
        },
    },
    {
        "scenario_id": "S12", "name": "Liquidity Squeeze", "severity": "Extreme",
        "shocks": {
            "sofr_shock_bps": 50.0, "ig_spread_shock_bps": 100.0, "hy_spread_shock_bps": 400.0, "equity_shock_pct": -0.10,
            "bid_ask_multiplier": 7.0, "market_depth_reduction_pct": 0.70, "demand_surge_factor": 2.0,
            "recall_risk_spillover_factor": 1.8, "replacement_cost_bps": 15.0, "haircut_floor_increase_pp": 3.0,
        },
        "breach_thresholds": {
            "collateral_shortfall_usd": 5e6, "financing_cost_delta_bps": 60.0, "eligible_pool_shrinkage_pct": 0.15,
        },
    },
    {
        "scenario_id": "S13", "name": "Combined Stress", "severity": "Extreme",
        "shocks": {
            "rate_shift_bps": 150.0, "sofr_shock_bps": 150.0, "short_end_shift_bps": 175.0, "long_end_shift_bps": 100.0,
            "ig_spread_shock_bps": 200.0, "hy_spread_shock_bps": 600.0, "equity_shock_pct": -0.15,
            "bid_ask_multiplier": 3.5, "market_depth_reduction_pct": 0.35, "demand_surge_factor": 1.3,
            "recall_risk_spillover_factor": 1.5, "replacement_cost_bps": 10.0, "haircut_floor_increase_pp": 2.0,
        },
        "breach_thresholds": {
            "collateral_shortfall_usd": 3e6, "financing_cost_delta_bps": 75.0, "eligible_pool_shrinkage_pct": 0.12,
            "capital_charge_delta_usd": 3e6,
        },
    },
]


def as_table(spark: SparkSession, scenarios: list[dict]) -> DataFrame:
    """Scenario definitions as rows; keys a definition leaves out are NULL."""
    rows = [
        {
            "scenario_id": s.get("scenario_id"),
            "name": s.get("name"),
            "severity": s.get("severity"),
            "shocks": s["shocks"] if isinstance(s.get("shocks"), dict) else None,
            "breach_thresholds": s.get("breach_thresholds") or None,
        }
        for s in scenarios
    ]
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{SCHEMA}>>")
    return spark.range(1).select(F.inline(parsed))


def validated(scenarios: DataFrame) -> DataFrame:
    """Drop rows without the required fields or with an unknown severity; set unset shocks neutral."""
    ok = scenarios.dropna(subset=["scenario_id", "name", "severity", "shocks"]).where(
        F.col("severity").isin(SEVERITIES)
    )
    s = "shocks."
    shift = F.coalesce(F.col(s + "rate_shift_bps"), F.lit(0.0))
    plain = [F.coalesce(F.col(s + c), F.lit(v)).alias(c) for c, v in NEUTRAL.items()]
    return ok.select(
        "scenario_id", "name", "severity",
        *plain,
        F.coalesce(F.col(s + "sofr_shock_bps"), shift).alias("sofr_shock_bps"),
        F.coalesce(F.col(s + "sofr_shock_bps"), F.lit(0.0)).alias("sofr_shock_set"),
        F.coalesce(F.col(s + "short_end_shift_bps"), shift).alias("short_end_shift_bps"),
        F.coalesce(F.col(s + "long_end_shift_bps"), shift).alias("long_end_shift_bps"),
        *[F.col(s + c).alias(c) for c in ("sector_spread_shocks", "name_specific_equity_shocks")],
        *[
            F.coalesce(F.col(s + c), F.array().cast("array<string>")).alias(c)
            for c in ("remove_counterparty_ids", "exclude_asset_classes")
        ],
        F.coalesce("breach_thresholds", F.create_map(*[F.lit(x) for kv in DEFAULT_THRESHOLDS.items() for x in kv])).alias(
            "breach_thresholds"
        ),
    )


def standard(spark: SparkSession) -> DataFrame:
    return validated(as_table(spark, STANDARD))


def load(spark: SparkSession, directory: str) -> DataFrame:
    """Scenario files of a folder, in order of id; unreadable or invalid ones are left out."""
    import yaml

    found = []
    for path in sorted(glob.glob(os.path.join(directory, "*.yaml"))):
        try:
            with open(path, encoding="utf-8") as f:
                loaded = yaml.safe_load(f)
        except yaml.YAMLError:
            continue
        if isinstance(loaded, dict):
            limits = (loaded.get("reporting") or {}).get("breach_thresholds")
            found.append({**loaded, "breach_thresholds": loaded.get("breach_thresholds") or limits})
    return validated(as_table(spark, found)).orderBy("scenario_id")


def name_counterparties(scenarios: DataFrame, loans: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Replace placeholder ids: the largest counterparty by notional, and given aliases."""
    top = top_counterparties(loans, 1).agg(F.max("counterparty_id").cast("string").alias("__top"))
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None

    def resolve(i):
        named = F.when(i == TOP_COUNTERPARTY, F.col("__top"))
        if known is not None:
            named = F.coalesce(named, F.element_at(known, i))
        return F.coalesce(named, i)

    ids = F.transform("remove_counterparty_ids", resolve)
    return scenarios.crossJoin(F.broadcast(top)).withColumn("remove_counterparty_ids", ids).drop("__top")


def top_counterparties(loans: DataFrame, k: int) -> DataFrame:
    """The k largest counterparties by notional."""
    return (
        loans.groupBy("counterparty_id")
        .agg(F.sum("notional").alias("notional"))
        .orderBy(F.desc("notional"), "counterparty_id")
        .limit(k)
    )
