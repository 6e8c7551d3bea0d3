"""Allocations of every portfolio under every scenario, solved together, and candidates over the whole pool."""

from pyspark.sql import functions as F

from ..operators import allocation_batch, allocation_candidates, collateral, stress
from ..operators import scenarios as sc
from ..session import lineage_cut
from ..sources import views
from .collateral import _RATED
from .registry import query
from .stress import _ALL

KEYS = ["portfolio_id", "scenario_id"]


def _pools(spark, sf):
    """The items that each portfolio holds, under each scenario.

    What is written has a row for each item and scenario, with the item's portfolios
    as an array: portfolios times items are rows only while they are read.
    """
    held = views.positions(spark, sf).select("portfolio_id", F.col("isin").alias("collateral_id")).distinct()
    held = held.groupBy("collateral_id").agg(F.collect_list(F.struct("portfolio_id")).alias("holders"))
    stressed = stress.apply_all(views.pool(spark, sf), sc.standard(spark))
    items = collateral.cost_of_carry(collateral.rating_score(stressed)).withColumn("coverage", 1 - F.col("haircut"))
    used = ["collateral_id", "scenario_id", "asset_class", "eligible", "cost_of_carry", *LIMITS]
    landed = lineage_cut(items.select(*used).join(held, "collateral_id"), "pools")
    return landed.select(*used, F.explode("holders").alias("holder")).select(*used, "holder.portfolio_id")


LIMITS = {
    "haircut": ("max", 0.35), "coverage": ("min", 0.60), "recall_prob": ("max", 0.70), "capital_charge_est": ("max", 0.04),
    "rating_score": ("min", 0.60), "modified_duration": ("max", 4.0), "spread_duration": ("max", 2.5), "bid_ask_spread_pct": ("max", 0.02),
    "fee_rate": ("min", 0.006), "days_to_cover": ("max", 5.0),
}
# Six types reach the whole at this cap, five do not.
CAP = 0.19
_HELD = f"""SELECT h.portfolio_id, s.* FROM ({_ALL}) s JOIN (SELECT DISTINCT portfolio_id, isin FROM v_pos) h ON h.isin = s.collateral_id"""


@query(
    "allocation_scenarios",
    f"""SELECT portfolio_id, scenario_id, CASE WHEN types * {CAP} >= 1 THEN 'optimal' ELSE 'infeasible' END AS status,
          CASE WHEN types * {CAP} >= 1 THEN 1.0 ELSE 0.0 END AS invested, types * {CAP} >= 1 AS inside, true AS capped,
          types * {CAP} >= 1 AS exact, items
        FROM (SELECT portfolio_id, scenario_id, count(DISTINCT asset_class) FILTER (WHERE el) AS types, count(*) AS items FROM ({_HELD}) GROUP BY ALL)""",
    "v_pool v_pos",
    "invested:9",
)
def allocation_scenarios(spark, sf):
    """Every portfolio under every scenario with ten limits: kept, and at the bound that the whole pool gives at the run's prices."""
    pool = _pools(spark, sf)
    cost = F.col("cost_of_carry") - 0.2 * F.col("fee_rate") + 0.01 * F.col("capital_charge_est")
    runs = lineage_cut(allocation_batch.allocate_each(pool, KEYS, cost, CAP, LIMITS), "runs")
    shown = allocation_batch.checked(pool, runs, KEYS, cost, CAP, LIMITS)
    solved = F.col("status") == "optimal"
    return shown.select(
        *KEYS, "status", "invested", (solved & F.col("inside")).alias("inside"), "capped",
        F.coalesce(solved & (F.abs("distance") <= 1e-6), F.lit(False)).alias("exact"), "items",
    )


# With one limit the least cost is the largest dual value, which lies at price zero or where two items of a type change places.
_ONE = f"""WITH scored AS (SELECT portfolio_id, scenario_id, asset_class, 0.6 * hc * financing_rate_bps / 10000 AS c, rating_score AS q
    FROM ({_HELD}) h JOIN (SELECT collateral_id, rating_score FROM ({_RATED})) USING (collateral_id) WHERE el),
  steps AS (SELECT *, max(q) OVER (PARTITION BY portfolio_id, scenario_id, asset_class ORDER BY c, q DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS better FROM scored),
  undominated AS (SELECT portfolio_id, scenario_id, asset_class, c, q FROM steps WHERE better IS NULL OR q > better),
  prices AS (SELECT DISTINCT portfolio_id, scenario_id, 0.0 AS l FROM undominated
    UNION SELECT a.portfolio_id, a.scenario_id, (a.c - b.c) / (a.q - b.q) FROM undominated a JOIN undominated b USING (portfolio_id, scenario_id)
      WHERE a.q > b.q AND a.c > b.c AND a.asset_class = b.asset_class
    UNION SELECT a.portfolio_id, a.scenario_id, (a.c - b.c) / (a.q - b.q) FROM undominated a JOIN undominated b USING (portfolio_id, scenario_id)
      WHERE a.q > b.q AND a.c > b.c AND a.asset_class <> b.asset_class),
  best AS (SELECT portfolio_id, scenario_id, l, asset_class, min(c - l * q) AS r FROM prices JOIN undominated USING (portfolio_id, scenario_id) GROUP BY ALL),
  filled AS (SELECT *, least(0.3, greatest(0, 1 - 0.3 * (row_number() OVER (PARTITION BY portfolio_id, scenario_id, l ORDER BY r, asset_class) - 1))) AS w FROM best)
  SELECT portfolio_id, scenario_id, 'optimal' AS status, max(d) AS cost
  FROM (SELECT portfolio_id, scenario_id, l, sum(w * r) + l * 0.85 AS d FROM filled GROUP BY portfolio_id, scenario_id, l) GROUP BY ALL"""


@query("allocation_scenarios_floor", _ONE, "v_pool v_pos", "cost:12")
def allocation_scenarios_floor(spark, sf):
    """The least cost of every portfolio under every scenario that keeps a rating floor."""
    runs = allocation_batch.allocate_each(_pools(spark, sf), KEYS, 0.6 * F.col("cost_of_carry"), 0.30, {"rating_score": ("min", 0.85)}, tolerance=1e-12)
    return runs.select(*KEYS, "status", "cost")


CANDIDATES = 600
MOST_RECALL = 0.45
SCORE_WEIGHTS = (0.5, 0.3, 0.2)
_P = allocation_candidates.PRIME


def _fifth(x, name, source):
    """SQL: ``source`` with the fifth power of ``x`` modulo the prime as a further column."""
    return (
        f"SELECT * EXCLUDE (s2, s4, base), s4 * base % {_P} AS {name} FROM (SELECT *, s2 * s2 % {_P} AS s4 FROM "
        f"(SELECT *, base * base % {_P} AS s2 FROM (SELECT *, ({x}) % {_P} AS base FROM ({source}))))"
    )


def _drawn(source):
    """SQL: ``source`` (id, key) with the draw u."""
    first = _fifth(f"id * 48271 % {_P} + key * 69621 % {_P} + 42", "m1", source)
    return f"SELECT * EXCLUDE (m1, m2), (m2 + 1) / CAST({_P + 1} AS DOUBLE) AS u FROM ({_fifth('m1 + id', 'm2', first)})"


_COLS = allocation_candidates.COLUMNS
_ITEMS = """SELECT CAST(collateral_id AS BIGINT) AS key, haircut * financing_rate_bps / 10000 AS f1, -fee_rate AS f2, capital_charge_est AS f3,
  recall_prob AS risk FROM v_pool WHERE eligible"""
_Z = ", ".join(
    f"CASE WHEN (SELECT stddev_pop({c}) FROM items) > 1e-12 THEN greatest(-8.0, least(8.0, ({c} - (SELECT avg({c}) FROM items)) / "
    f"(SELECT stddev_pop({c}) FROM items))) ELSE 0 END AS {c}_z"
    for c in _COLS
)
_MEANS = f"""WITH items AS ({_ITEMS}), scaled AS (SELECT *, {_Z} FROM items), ids AS (SELECT range AS id FROM range({CANDIDATES})),
  lean AS (SELECT id, {", ".join(f"4.0 * max(u) FILTER (WHERE key = {_P + 1 + j}) AS {c}_t" for j, c in enumerate(_COLS))}
    FROM ({_drawn(f"SELECT id, {_P + 1} + j AS key FROM ids, (SELECT range AS j FROM range({len(_COLS)}))")}) GROUP BY id),
  weighed AS (SELECT d.*, u * exp(-({" + ".join(f"{c}_t * {c}_z" for c in _COLS)})) AS w
    FROM ({_drawn("SELECT id, s.* FROM ids, scaled s")}) d JOIN lean USING (id)),
  cands AS (SELECT id, {", ".join(f"round(sum(w * {c}) / sum(w), 12) AS {c}" for c in _COLS)} FROM weighed GROUP BY id)"""
_FRONT = f"""{_MEANS}, inside AS (SELECT * FROM cands WHERE risk <= {MOST_RECALL}),
  front AS (SELECT id, f1, f2, f3, {" + ".join(f"{w} * {c}" for w, c in zip(SCORE_WEIGHTS, _COLS))} AS score FROM inside p WHERE NOT EXISTS
    (SELECT 1 FROM inside q WHERE q.f1 <= p.f1 AND q.f2 <= p.f2 AND q.f3 <= p.f3 AND (q.f1 < p.f1 OR q.f2 < p.f2 OR q.f3 < p.f3)))"""


def _candidates(spark, sf):
    pool = collateral.cost_of_carry(views.pool(spark, sf).where("eligible"))
    columns = {"f1": F.col("cost_of_carry"), "f2": -F.col("fee_rate"), "f3": F.col("capital_charge_est"), "risk": F.col("recall_prob")}
    return allocation_candidates.objectives_of(pool, columns, CANDIDATES, F.col("collateral_id"))


@query("candidate_objectives", f"{_MEANS} SELECT * FROM cands", "v_pool", "f1:9 f2:9 f3:9 risk:9")
def candidate_objectives(spark, sf):
    """Cost, fee (negative), capital and recall risk of every candidate over the whole pool."""
    return _candidates(spark, sf)


@query("candidate_front", f"{_FRONT} SELECT *, id = (SELECT id FROM front ORDER BY score, id LIMIT 1) AS chosen FROM front", "v_pool", "f1:9 f2:9 f3:9 score:9")
def candidate_front(spark, sf):
    """The candidates within the recall limit that none dominates, and the one of least weighted score."""
    landed = lineage_cut(_candidates(spark, sf), "candidates")
    return allocation_candidates.chosen(lineage_cut(allocation_candidates.front_within(landed, MOST_RECALL), "front"), SCORE_WEIGHTS)
