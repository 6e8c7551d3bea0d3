"""Stress-test queries."""

from pyspark.sql import functions as F

from ..operators import scenarios as sc
from ..operators import stress
from ..sources import views
from ..sources.views import MACRO_DAYS
from .registry import query

LEHMAN = "7"


def _sql_scenarios() -> str:
    """The standard scenarios as SQL rows."""
    rows = []
    for s in sc.STANDARD:
        k = s["shocks"]
        shift = k.get("rate_shift_bps", 0.0)
        ids = [{"COUNTERPARTY_LEHMAN": LEHMAN}.get(i, i) for i in k.get("remove_counterparty_ids", [])]
        numbers = [k.get(c, v) for c, v in sc.NEUTRAL.items()]
        numbers += [k.get("sofr_shock_bps", shift), k.get("sofr_shock_bps", 0.0)]
        numbers += [k.get("short_end_shift_bps", shift), k.get("long_end_shift_bps", shift)]
        rows.append(
            f"('{s['scenario_id']}', '{s['name']}', '{s['severity']}', "
            + ", ".join(f"CAST({n} AS DOUBLE)" for n in numbers)
            + f", CAST({ids!r} AS VARCHAR[]), CAST({k.get('exclude_asset_classes', [])!r} AS VARCHAR[]))"
        )
    names = ["scenario_id", "name", "severity", *sc.NEUTRAL, "sofr_shock_bps", "sofr_shock_set", "short_end_shift_bps",
             "long_end_shift_bps", "remove_ids", "exclude_classes"]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) s({', '.join(names)})"


def _nested(key: str, column: str, default: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN scenario_id = '{s['scenario_id']}' AND {column} = '{k}' THEN {v}"
        for s in sc.STANDARD
        for k, v in s["shocks"].get(key, {}).items()
    )
    return f"CASE {arms} ELSE {default} END"


SCEN = _sql_scenarios()
_FIXED = "asset_class IN ('UST', 'Agency', 'Corp', 'Muni')"
_RATE = f"CASE WHEN {_FIXED} AND (rate_shift_bps <> 0 OR sofr_shock_set <> 0) THEN 1 - modified_duration * rate_shift_bps / 10000 ELSE 1 END"
_WIDE = "CASE WHEN rating IN ('AAA', 'AA', 'A', 'BBB') THEN ig_spread_shock_bps ELSE hy_spread_shock_bps END"
_CREDIT = f"""CASE WHEN ig_spread_shock_bps <> 0 OR hy_spread_shock_bps <> 0 THEN (1 - spread_duration * {_WIDE} / 10000)
  * (1 - spread_duration * {_nested('sector_spread_shocks', 'gics_sector', '0')} / 10000) ELSE 1 END"""
_EQUITY = f"CASE WHEN asset_class = 'Equity' AND equity_shock_pct <> 0 THEN 1 + {_nested('name_specific_equity_shocks', 'ticker', 'equity_shock_pct')} ELSE 1 END"
_LIQUID = "CASE WHEN bid_ask_multiplier <> 1 THEN 1 - bid_ask_spread_pct * bid_ask_multiplier * (1 + market_depth_reduction_pct) / 2 ELSE 1 END"
_HAIRCUT = "CASE WHEN haircut_floor_increase_pp > 0 THEN least(haircut + haircut_floor_increase_pp / 100, 1) ELSE haircut END"
_ELIGIBLE = "CASE WHEN haircut_floor_increase_pp <> 0 AND len(exclude_classes) > 0 THEN NOT list_contains(exclude_classes, asset_class) ELSE eligible END"
_RECALL = "CASE WHEN len(remove_ids) > 0 AND recall_risk_spillover_factor > 1 THEN least(recall_prob * recall_risk_spillover_factor, 1) ELSE recall_prob END"
_PAIRS = f"v_pool CROSS JOIN ({SCEN}) s"


def _one(factor: str) -> str:
    return f"SELECT scenario_id, collateral_id, market_value * ({factor}) AS market_value FROM {_PAIRS}"


def _under(spark, sf):
    return stress.against(views.pool(spark, sf), sc.standard(spark))


KEY = ["scenario_id", "collateral_id"]


@query("stress_rate", _one(_RATE), "v_pool", "market_value")
def stress_rate(spark, sf):
    return stress.shock_rates(_under(spark, sf)).select(*KEY, "market_value")


@query("stress_credit", _one(_CREDIT), "v_pool", "market_value")
def stress_credit(spark, sf):
    return stress.shock_credit(_under(spark, sf)).select(*KEY, "market_value")


@query("stress_equity", _one(_EQUITY), "v_pool", "market_value")
def stress_equity(spark, sf):
    return stress.shock_equity(_under(spark, sf)).select(*KEY, "market_value")


@query("stress_liquidity", _one(_LIQUID), "v_pool", "market_value")
def stress_liquidity(spark, sf):
    return stress.shock_liquidity(_under(spark, sf)).select(*KEY, "market_value")


_TENOR = "least(greatest((modified_duration - 2) / 8, 0), 1)"


@query(
    "stress_twist",
    _one(f"CASE WHEN {_FIXED} THEN 1 - modified_duration * (short_end_shift_bps + (long_end_shift_bps - short_end_shift_bps) * {_TENOR}) / 10000 ELSE 1 END"),
    "v_pool",
    "market_value",
)
def stress_twist(spark, sf):
    return stress.shock_twist(_under(spark, sf)).select(*KEY, "market_value")


@query(
    "stress_regulatory",
    f"SELECT scenario_id, collateral_id, {_HAIRCUT} AS haircut, {_ELIGIBLE} AS eligible FROM {_PAIRS}",
    "v_pool",
    "haircut",
)
def stress_regulatory(spark, sf):
    return stress.shock_regulation(_under(spark, sf)).select(*KEY, "haircut", "eligible")


_TOP = "(SELECT CAST(counterparty_id AS VARCHAR) FROM v_loan GROUP BY counterparty_id ORDER BY sum(notional) DESC, counterparty_id LIMIT 1)"


@query(
    "stress_counterparty",
    f"""SELECT scenario_id, counterparty_id, count(*) AS trades, sum(notional) AS notional,
        sum(borrow_volume) * max(CASE WHEN bid_ask_multiplier <> 1 THEN demand_surge_factor ELSE 1 END) AS borrow_volume
        FROM v_loan CROSS JOIN ({SCEN}) s
        WHERE NOT list_contains(remove_ids, CAST(counterparty_id AS VARCHAR))
          AND NOT (list_contains(remove_ids, '{sc.TOP_COUNTERPARTY}') AND CAST(counterparty_id AS VARCHAR) = {_TOP})
        GROUP BY 1, 2""",
    "v_loan",
    "notional:3 borrow_volume:4",
)
def stress_counterparty(spark, sf):
    loans = views.loans(spark, sf)
    named = sc.name_counterparties(sc.standard(spark), loans, {"COUNTERPARTY_LEHMAN": LEHMAN})
    return stress.surviving_loans(loans, named)


@query("stress_recall", f"SELECT scenario_id, collateral_id, {_RECALL} AS recall_prob FROM {_PAIRS}", "v_pool", "recall_prob")
def stress_recall(spark, sf):
    return stress.shock_recall(_under(spark, sf)).select(*KEY, "recall_prob")


_ALL = f"""SELECT scenario_id, name, severity, sofr_shock_bps, replacement_cost_bps, len(remove_ids) > 0 AS cuts, collateral_id, asset_class,
  market_value * ({_RATE}) * ({_CREDIT}) * ({_EQUITY}) * ({_LIQUID}) AS mv, market_value AS mv0, {_HAIRCUT} AS hc, haircut AS hc0,
  {_ELIGIBLE} AS el, eligible AS el0, {_RECALL} AS rp, recall_prob AS rp0, financing_rate_bps, capital_charge_est FROM {_PAIRS}"""


def _stressed(spark, sf):
    return stress.apply_all(views.pool(spark, sf), sc.standard(spark))


@query(
    "stress_all",
    f"SELECT scenario_id, collateral_id, mv AS market_value, hc AS haircut, mv * (1 - hc) AS collateral_value, el AS eligible, rp AS recall_prob FROM ({_ALL})",
    "v_pool",
    "market_value haircut collateral_value recall_prob",
)
def stress_all(spark, sf):
    return _stressed(spark, sf).select(*KEY, "market_value", "haircut", "collateral_value", "eligible", "recall_prob")


_HHI = "SELECT scenario_id, sum(m * m) / pow(sum(m), 2) - sum(m0 * m0) / pow(sum(m0), 2) AS hhi_delta FROM (SELECT scenario_id, asset_class, sum(mv) AS m, sum(mv0) AS m0 FROM al GROUP BY 1, 2) GROUP BY 1"
_METRICS = f"""WITH al AS ({_ALL})
  SELECT scenario_id, name, severity,
    greatest(0, sum(mv0 * (1 - hc0)) - sum(mv * (1 - hc))) AS collateral_shortfall_usd,
    sum(mv * financing_rate_bps) / sum(mv) - sum(mv0 * financing_rate_bps) / sum(mv0) + max(sofr_shock_bps)
      + max(CASE WHEN cuts THEN replacement_cost_bps ELSE 0 END) AS financing_cost_delta_bps,
    sum(mv * capital_charge_est) - sum(mv0 * capital_charge_est) AS capital_charge_delta_usd,
    greatest(0, sum(mv0 * (1 - hc0)) - sum(mv * (1 - hc))) AS margin_call_estimate_usd,
    (count(*) FILTER (WHERE el0) - count(*) FILTER (WHERE el)) / (count(*) FILTER (WHERE el0)) AS eligible_pool_shrinkage_pct,
    (sum(mv * rp) / sum(mv)) / (sum(mv0 * rp0) / sum(mv0)) AS recall_risk_multiplier,
    max(h.hhi_delta) AS hhi_delta, CAST(0 AS DOUBLE) AS days_to_cover_delta
  FROM al JOIN ({_HHI}) h USING (scenario_id) GROUP BY 1, 2, 3"""
_DIGITS = (
    "collateral_shortfall_usd:3 financing_cost_delta_bps capital_charge_delta_usd:3 margin_call_estimate_usd:3 "
    "eligible_pool_shrinkage_pct recall_risk_multiplier hhi_delta days_to_cover_delta"
)


@query("stress_metrics", _METRICS, "v_pool", _DIGITS)
def stress_metrics(spark, sf):
    return stress.metrics(_stressed(spark, sf)).drop("breach_thresholds")


_IDS = ", ".join(f"('{s['scenario_id']}')" for s in sc.STANDARD)


@query(
    "stress_days_to_cover",
    f"""SELECT scenario_id, d AS days_to_cover_delta FROM (VALUES {_IDS}) s(scenario_id),
        (SELECT sum(CASE WHEN asset_class = 'Equity' THEN days_to_cover ELSE 0 END) / count(days_to_cover) AS d FROM v_pool)""",
    "v_pool",
    "days_to_cover_delta",
)
def stress_days_to_cover(spark, sf):
    """The days-to-cover measure, on a book whose equity takes twice as long to cover."""
    longer = F.when(F.col("asset_class") == "Equity", 2 * F.col("days_to_cover")).otherwise(F.col("days_to_cover"))
    return stress.metrics(_stressed(spark, sf).withColumn("days_to_cover", longer)).select("scenario_id", "days_to_cover_delta")


_PNL = f"""SELECT *, -(collateral_shortfall_usd + financing_cost_delta_bps / 10000 * 1e9 + capital_charge_delta_usd * 0.1) AS pnl_impact_usd
  FROM ({_METRICS})"""


@query("stress_pnl", f"SELECT scenario_id, pnl_impact_usd FROM ({_PNL})", "v_pool", "pnl_impact_usd:2")
def stress_pnl(spark, sf):
    return stress.with_pnl(stress.metrics(_stressed(spark, sf))).select("scenario_id", "pnl_impact_usd")


def _limit(metric: str) -> str:
    arms = " ".join(
        f"WHEN scenario_id = '{s['scenario_id']}' THEN {s['breach_thresholds'][metric]}"
        for s in sc.STANDARD
        if metric in s["breach_thresholds"]
    )
    return f"CASE {arms} END"


_BREACH = " UNION ALL ".join(
    f"SELECT scenario_id, '{m}' AS metric, {m} AS value FROM m WHERE {m} > {_limit(m)}" for m in stress.BREACHABLE
)


@query("stress_breaches", f"WITH m AS ({_METRICS}) {_BREACH}", "v_pool", "value:3")
def stress_breaches(spark, sf):
    found = stress.with_breaches(stress.metrics(_stressed(spark, sf)))
    return found.select("scenario_id", F.explode("breach_details").alias("metric", "value"))


@query(
    "stress_summary",
    f"""SELECT m.*, coalesce(b.n, 0) > 0 AS any_breach FROM ({_PNL}) m LEFT JOIN
        (SELECT scenario_id, count(*) AS n FROM (WITH m AS ({_METRICS}) {_BREACH}) GROUP BY 1) b USING (scenario_id)""",
    "v_pool",
    _DIGITS + " pnl_impact_usd:2",
)
def stress_summary(spark, sf):
    return stress.summary(_stressed(spark, sf)).drop("breach_details")


@query(
    "stress_diff",
    f"""SELECT scenario_id, collateral_id, mv0 AS base_market_value, mv AS market_value, mv - mv0 AS value_change,
        hc - hc0 AS haircut_change, el0 AND NOT el AS became_ineligible FROM ({_ALL})""",
    "v_pool",
    "base_market_value market_value value_change haircut_change",
)
def stress_diff(spark, sf):
    return stress.differences(_stressed(spark, sf), "collateral_id")


def _catalogue_sql():
    rows = []
    for s in sc.STANDARD:
        shocks = s["shocks"]
        left_out = ", ".join(f"'{c}'" for c in shocks.get("exclude_asset_classes") or [])
        rows.append(
            f"('{s['scenario_id']}', '{s['name']}', '{s['severity']}', {shocks.get('rate_shift_bps', 0.0)},"
            f" {shocks.get('equity_shock_pct', 0.0)}, CAST([{left_out}] AS VARCHAR[]))"
        )
    fixed = ", ".join(f"'{c}'" for c in stress.FIXED_INCOME)
    return f"""SELECT scenario_id, name, severity, count(*) FILTER (WHERE asset_class IN ({fixed}) AND rate <> 0) AS rate_items,
      count(*) FILTER (WHERE asset_class = 'Equity' AND equity <> 0) AS equity_items,
      count(*) FILTER (WHERE list_contains(left_out, asset_class)) AS excluded_items
      FROM v_pool, (VALUES {', '.join(rows)}) s(scenario_id, name, severity, rate, equity, left_out) GROUP BY 1, 2, 3"""


@query("scenario_catalog", _catalogue_sql(), "v_pool")
def scenario_catalog(spark, sf):
    """Every scenario with the number of pool items each of its shocks reaches."""
    pairs = _under(spark, sf)
    reached = pairs.groupBy("scenario_id", "name", "severity").agg(
        F.count_if(F.col("asset_class").isin(*stress.FIXED_INCOME) & (F.col("rate_shift_bps") != 0)).alias("rate_items"),
        F.count_if((F.col("asset_class") == "Equity") & (F.col("equity_shock_pct") != 0)).alias("equity_items"),
        F.count_if(F.array_contains("exclude_asset_classes", F.col("asset_class"))).alias("excluded_items"),
    )
    return reached


@query(
    "topk_counterparty",
    "SELECT counterparty_id, sum(notional) AS notional FROM v_loan GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "v_loan",
    "notional:3",
)
def topk_counterparty(spark, sf):
    return sc.top_counterparties(views.loans(spark, sf), 5)


SIGMAS = {
    "rate_shift_bps": 100.0, "ig_spread_shock_bps": 50.0, "hy_spread_shock_bps": 150.0, "equity_shock_pct": 0.10,
    "bid_ask_multiplier": 0.5, "haircut_floor_increase_pp": 2.0,
}


def _tornado_sql() -> str:
    """One scenario per parameter and sign over neutral shocks, each reduced to its loss."""
    rows = []
    for p, sigma in SIGMAS.items():
        for sign in (1, -1):
            v = {c: (1.0 if c == "bid_ask_multiplier" else 0.0) for c in SIGMAS}
            v[p] += sigma * sign
            sofr = sigma * sign if p == "rate_shift_bps" else 0.0
            rows.append(f"('{p}', {sign}, " + ", ".join(f"CAST({v[c]} AS DOUBLE)" for c in SIGMAS) + f", CAST({sofr} AS DOUBLE))")
    table = f"(VALUES {', '.join(rows)}) t(param, sign, {', '.join(SIGMAS)}, sofr)"
    rate = f"CASE WHEN {_FIXED} THEN 1 - modified_duration * rate_shift_bps / 10000 ELSE 1 END"
    credit = f"1 - spread_duration * {_WIDE} / 10000"
    equity = "CASE WHEN asset_class = 'Equity' THEN 1 + equity_shock_pct ELSE 1 END"
    liquid = "CASE WHEN bid_ask_multiplier <> 1 THEN 1 - bid_ask_spread_pct * bid_ask_multiplier / 2 ELSE 1 END"
    moved = f"""SELECT param, sign, sofr, market_value AS mv0, haircut AS hc0, financing_rate_bps AS f, capital_charge_est AS k,
      market_value * ({rate}) * ({credit}) * ({equity}) * ({liquid}) AS mv, {_HAIRCUT} AS hc FROM v_pool CROSS JOIN {table}"""
    loss = f"""SELECT param, sign, -(greatest(0, sum(mv0 * (1 - hc0)) - sum(mv * (1 - hc)))
      + (sum(mv * f) / sum(mv) - sum(mv0 * f) / sum(mv0) + max(sofr)) / 10000 * 1e9
      + (sum(mv * k) - sum(mv0 * k)) * 0.1) AS pnl FROM ({moved}) GROUP BY 1, 2"""
    return f"SELECT param, max(pnl) FILTER (WHERE sign = 1) AS up_impact, max(pnl) FILTER (WHERE sign = -1) AS dn_impact FROM ({loss}) GROUP BY 1"


def _tornado(spark, sf):
    return stress.tornado(views.pool(spark, sf), sc.standard(spark), SIGMAS)


@query("tornado", _tornado_sql(), "v_pool", "up_impact:2 dn_impact:2")
def tornado(spark, sf):
    return _tornado(spark, sf)


@query(
    "tornado_topk",
    f"SELECT * FROM ({_tornado_sql()}) ORDER BY abs(up_impact) DESC, abs(dn_impact) DESC, param LIMIT 4",
    "v_pool",
    "up_impact:2 dn_impact:2",
)
def tornado_topk(spark, sf):
    return stress.tornado_top(_tornado(spark, sf), 4)


def _reverse_sql(share_of_pool: float) -> str:
    k = "k / 100.0"
    s = next(s for s in sc.STANDARD if s["scenario_id"] == "S13")["shocks"]
    rate = f"CASE WHEN {_FIXED} THEN 1 - modified_duration * {s['rate_shift_bps']} * {k} / 10000 ELSE 1 END"
    wide = f"CASE WHEN rating IN ('AAA', 'AA', 'A', 'BBB') THEN {s['ig_spread_shock_bps']} ELSE {s['hy_spread_shock_bps']} END"
    credit = f"1 - spread_duration * {wide} * {k} / 10000"
    equity = f"CASE WHEN asset_class = 'Equity' THEN 1 + ({s['equity_shock_pct']}) * {k} ELSE 1 END"
    liquid = f"1 - bid_ask_spread_pct * (1 + {s['bid_ask_multiplier'] - 1} * {k}) * (1 + {s['market_depth_reduction_pct']}) / 2"
    haircut = f"least(haircut + {s['haircut_floor_increase_pp']} * {k} / 100, 1)"
    return f"""SELECT min(k) / 100.0 AS share FROM (SELECT k, sum(market_value * (1 - haircut)) AS v0,
      sum(market_value * ({rate}) * ({credit}) * ({equity}) * ({liquid}) * (1 - {haircut})) AS v
      FROM v_pool CROSS JOIN (SELECT unnest(range(1, 101)) AS k) GROUP BY 1) WHERE v0 - v > {share_of_pool}"""


@query("reverse_stress", _reverse_sql(100_000.0), "v_pool", "share")
def reverse_stress(spark, sf):
    scenario = sc.standard(spark).where(F.col("scenario_id") == "S13")
    return stress.reverse_stress(views.pool(spark, sf), scenario, "collateral_shortfall_usd", 100_000.0)


FACTORS = ["sofr", "hy_oas", "vix"]
_CHANGES = "SELECT * FROM (SELECT " + ", ".join(f"{c} - lag({c}) OVER (ORDER BY date) AS {c}" for c in FACTORS) + " FROM v_macro) WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in FACTORS
)


def _changes(spark, sf):
    return stress.factor_changes(views.macro(spark, sf), FACTORS, MACRO_DAYS.window())


@query(
    "factor_cov",
    f"WITH d AS ({_CHANGES}) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) AS cov FROM d" for i, a in enumerate(FACTORS) for b in FACTORS[: i + 1]
    ),
    "v_macro",
    "cov",
)
def factor_cov(spark, sf):
    return stress.covariance_long(_changes(spark, sf), FACTORS)


@query("mc_var_es")
def mc_var_es(spark, sf):
    units = [0.01, 0.01, -0.01]
    pnl = stress.simulate(views.pool(spark, sf), _changes(spark, sf), FACTORS, units, draws=10_000)
    return stress.var_es(pnl)


_SAMPLE = "SELECT l_extendedprice * (l_discount - l_tax) AS pnl FROM lineitem"


@query(
    "var_es_from_sample",
    f"""WITH p AS ({_SAMPLE}), q AS (SELECT quantile_cont(pnl, 0.05) AS a, quantile_cont(pnl, 0.01) AS b FROM p)
        SELECT max(a) AS var_95, avg(pnl) FILTER (WHERE pnl <= a) AS es_95, max(b) AS var_99,
        avg(pnl) FILTER (WHERE pnl <= b) AS es_99 FROM p, q""",
    "",
    "var_95:4 es_95:4 var_99:4 es_99:4",
)
def var_es_from_sample(spark, sf):
    pnl = views.table(spark, sf, "lineitem").select((F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"))
    return stress.var_es(pnl)


@query(
    "stress_market_rates",
    f"""SELECT scenario_id, date, sofr / 100 + CASE WHEN rate_shift_bps <> 0 OR sofr_shock_set <> 0 THEN sofr_shock_bps / 10000 ELSE 0 END AS sofr,
        fed_funds / 100 + CASE WHEN rate_shift_bps <> 0 OR sofr_shock_set <> 0 THEN sofr_shock_bps / 10000 ELSE 0 END AS fed_funds
        FROM v_macro CROSS JOIN ({SCEN}) s""",
    "v_macro",
    "sofr:8 fed_funds:8",
    "date",
)
def stress_market_rates(spark, sf):
    rates = views.macro(spark, sf).select("date", (F.col("sofr") / 100).alias("sofr"), (F.col("fed_funds") / 100).alias("fed_funds"))
    return stress.shift_market(rates, sc.standard(spark)).select("scenario_id", "date", "sofr", "fed_funds")
