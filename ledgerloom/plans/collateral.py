"""Collateral quality, allocation and recommendation queries."""

from pyspark.sql import functions as F

from ..functions.numeric import clip, first_available
from ..operators import allocation, collateral
from ..sources import views
from .registry import query

AS_OF = "2024-07-01"


def _minmax(x, src):
    return f"coalesce(({x} - (SELECT min({x}) FROM {src})) / nullif((SELECT max({x}) - min({x}) FROM {src}), 0), 0)"


_SCALE = ", ".join(f"('{k}', {v})" for k, v in collateral.RATING_SCALE.items())
_RATED = f"""SELECT p.*, coalesce(r.n, 18) AS rating_numeric, 1 - (coalesce(r.n, 18) - 1) / 17.0 AS rating_score
  FROM v_pool p LEFT JOIN (VALUES {_SCALE}) r(rating, n) ON r.rating = p.rating"""
_DURATION = f"""SELECT *, greatest(maturity_date - DATE '{AS_OF}', 0) / 365.25 / (1 + coalesce(coupon_rate, 0.05)) AS md FROM v_pool"""
_CARRY = "SELECT *, haircut * financing_rate_bps / 10000 AS cost_of_carry FROM v_pool"


@query("rating_score", f"SELECT collateral_id, CAST(rating_numeric AS INTEGER) AS rating_numeric, rating_score FROM ({_RATED})", "v_pool", "rating_score")
def rating_score(spark, sf):
    return collateral.rating_score(views.pool(spark, sf)).select("collateral_id", "rating_numeric", "rating_score")


@query(
    "duration_score",
    f"WITH d AS ({_DURATION}) SELECT collateral_id, 1 - {_minmax('md', 'd')} AS duration_score FROM d",
    "v_pool",
    "duration_score",
)
def duration_score(spark, sf):
    return collateral.duration_score(views.pool(spark, sf), AS_OF).select("collateral_id", "duration_score")


_LIQ = """SELECT *, least(1 / (haircut + 1e-6), (SELECT quantile_cont(1 / (haircut + 1e-6), 0.99) FROM v_pool)) AS inverse FROM v_pool"""


@query(
    "liquidity_score",
    f"WITH d AS ({_LIQ}) SELECT collateral_id, {_minmax('inverse', 'd')} AS liquidity_score FROM d",
    "v_pool",
    "liquidity_score",
)
def liquidity_score(spark, sf):
    return collateral.liquidity_score(views.pool(spark, sf)).select("collateral_id", "liquidity_score")


@query(
    "cost_of_carry",
    f"WITH d AS ({_CARRY}) SELECT collateral_id, cost_of_carry, {_minmax('cost_of_carry', 'd')} AS cost_of_carry_norm FROM d",
    "v_pool",
    "cost_of_carry:9 cost_of_carry_norm",
)
def cost_of_carry(spark, sf):
    return collateral.cost_of_carry(views.pool(spark, sf)).select("collateral_id", "cost_of_carry", "cost_of_carry_norm")


_SHARE = """SELECT *, sum(market_value) OVER (PARTITION BY asset_class) / sum(market_value) OVER () AS concentration_pct FROM v_pool"""


@query(
    "asset_type_share",
    f"SELECT collateral_id, concentration_pct, concentration_pct > 0.165 AS is_concentrated FROM ({_SHARE})",
    "v_pool",
    "concentration_pct",
)
def asset_type_share(spark, sf):
    return collateral.type_share(views.pool(spark, sf), limit=0.165).select(
        "collateral_id", "concentration_pct", "is_concentrated"
    )


@query(
    "percent_to_fraction",
    "SELECT p_partkey, p_size / CASE WHEN (SELECT max(p_size) FROM part) > 1 THEN 100.0 ELSE 1 END AS haircut FROM part",
    "",
    "haircut",
)
def percent_to_fraction(spark, sf):
    sizes = views.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("haircut"))
    return collateral.percent_to_fraction(sizes, "haircut")


@query(
    "column_fallback",
    "SELECT p_partkey, coalesce(p_retailprice, 0) AS exposure, 0.05 AS coupon_rate FROM part",
    "",
    "exposure coupon_rate",
)
def column_fallback(spark, sf):
    part = views.table(spark, sf, "part")
    return part.select(
        "p_partkey",
        first_available(part, ["shares_on_loan", "notional", "p_retailprice"], 0.0).alias("exposure"),
        first_available(part, ["coupon_rate"], 0.05).alias("coupon_rate"),
    )


@query(
    "clip_range",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_discount, 0.02), 0.08) AS haircut,
       least(l_quantity, 40) AS volume, greatest(l_tax, 0.01) AS cost FROM lineitem""",
    "",
    "haircut volume cost",
)
def clip_range(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        clip(F.col("l_discount"), 0.02, 0.08).alias("haircut"),
        clip(F.col("l_quantity"), high=40).alias("volume"),
        clip(F.col("l_tax"), low=0.01).alias("cost"),
    )


def _rules(spark, sf):
    """Eligibility rules: several per asset class, in the order of their id."""
    return views.table(spark, sf, "part").select(
        views.asset_class(F.col("p_type")).alias("asset_class"),
        F.col("p_partkey").alias("rule_id"),
        (F.col("p_size") > 5).alias("rule_eligible"),
        F.col("p_size").alias("max_maturity_years"),
    )


@query(
    "dim_dedup_left_join",
    """SELECT collateral_id, r.rule_eligible, r.max_maturity_years FROM v_pool LEFT JOIN (
         SELECT asset_class, min_by(financing_rate_bps > 5, collateral_id) AS rule_eligible,
           CAST(min_by(financing_rate_bps, collateral_id) AS INTEGER) AS max_maturity_years
         FROM v_pool GROUP BY 1) r USING (asset_class)""",
    "v_pool",
)
def dim_dedup_left_join(spark, sf):
    out = collateral.join_first_rule(views.pool(spark, sf), _rules(spark, sf), "asset_class", ["rule_id"])
    return out.select("collateral_id", "rule_eligible", "max_maturity_years")


@query(
    "haircut_avg_join",
    """SELECT collateral_id, h.haircut_pct FROM v_pool LEFT JOIN
       (SELECT asset_class, avg(haircut) AS haircut_pct FROM v_pool GROUP BY 1) h USING (asset_class)""",
    "v_pool",
    "haircut_pct",
)
def haircut_avg_join(spark, sf):
    pool = views.pool(spark, sf)
    table = pool.select("asset_class", F.col("haircut").alias("haircut_pct"))
    return collateral.join_average(pool, table, "asset_class", "haircut_pct").select("collateral_id", "haircut_pct")


@query(
    "attach_scalar_row",
    """SELECT p_partkey, (SELECT arg_min(l_tax, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) FROM lineitem) AS financing_rate,
       (SELECT arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) FROM lineitem) AS required_value FROM part""",
    "",
    "financing_rate required_value",
)
def attach_scalar_row(spark, sf):
    trades = views.table(spark, sf, "lineitem").select(
        F.col("l_tax").alias("financing_rate"), F.col("l_extendedprice").alias("required_value"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
    )
    items = views.table(spark, sf, "part").select("p_partkey")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return collateral.attach_first(items, trades, order, ["financing_rate", "required_value"])


# Quality score stand-in: the rating, so that allocation has something to weigh.
def _scored(spark, sf):
    pool = collateral.rating_score(collateral.cost_of_carry(views.pool(spark, sf)))
    return pool.withColumn("quality_score", F.col("rating_score")).withColumn("financing_cost", F.col("cost_of_carry"))


def _objective():
    return 0.6 * F.col("cost_of_carry") - 0.4 * F.col("quality_score")


_SCORED = f"""SELECT *, rating_score AS quality_score, haircut * financing_rate_bps / 10000 AS cost_of_carry,
  haircut * financing_rate_bps / 10000 AS financing_cost FROM ({_RATED})"""


def _fill_sql(cap):
    return f"""SELECT s.*, coalesce(f.w, 0) AS allocation_weight FROM ({_SCORED}) s LEFT JOIN (
      SELECT collateral_id, CASE WHEN count(*) OVER () * {cap} >= 1 - 1e-9 THEN
        least({cap}, greatest(0, 1 - coalesce({cap} * count(*) OVER (ORDER BY u, asset_class
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS w
      FROM (SELECT asset_class, arg_min(collateral_id, (u, collateral_id)) AS collateral_id, min(u) AS u
            FROM (SELECT *, 0.6 * cost_of_carry - 0.4 * quality_score AS u FROM ({_SCORED}) WHERE eligible)
            GROUP BY 1)) f USING (collateral_id)"""


@query("allocation_fill", f"SELECT collateral_id, allocation_weight, allocation_weight > 1e-4 AS recommended FROM ({_fill_sql(0.30)})", "v_pool", "allocation_weight")
def allocation_fill(spark, sf):
    out = allocation.allocate(_scored(spark, sf), _objective(), cap=0.30)
    return out.select("collateral_id", "allocation_weight", "recommended")


@query("allocation_infeasible", f"SELECT collateral_id, allocation_weight, allocation_weight > 1e-4 AS recommended FROM ({_fill_sql(0.15)})", "v_pool", "allocation_weight")
def allocation_infeasible(spark, sf):
    out = allocation.allocate(_scored(spark, sf), _objective(), cap=0.15)
    return out.select("collateral_id", "allocation_weight", "recommended")


_REC = f"""SELECT *, cost_of_carry * allocation_weight AS optimization_cost,
  ((SELECT sum(cost_of_carry) / count(*) FROM ({_fill_sql(0.30)})) - cost_of_carry * allocation_weight) * 10000 AS cost_savings_bps
  FROM ({_fill_sql(0.30)}) WHERE allocation_weight > 1e-4"""


def _recommended(spark, sf):
    return allocation.recommendations(allocation.allocate(_scored(spark, sf), _objective(), cap=0.30))


@query(
    "recommendations",
    f"SELECT collateral_id, asset_class, quality_score, allocation_weight, optimization_cost, cost_savings_bps FROM ({_REC})",
    "v_pool",
    "quality_score allocation_weight optimization_cost:9 cost_savings_bps:3",
)
def recommendations(spark, sf):
    return _recommended(spark, sf).select(
        "collateral_id", "asset_class", "quality_score", "allocation_weight", "optimization_cost", "cost_savings_bps"
    )


_CALERT = """SELECT collateral_id, CASE WHEN quality_score < {q} OR cost_savings_bps >= 10 THEN 'CRITICAL'
  WHEN cost_savings_bps >= 5 THEN 'WARNING' ELSE 'INFO' END AS alert_level,
  CASE WHEN quality_score < {q} THEN 'SUBOPTIMAL_COLLATERAL' ELSE 'COST_SAVINGS_AVAILABLE' END AS alert_type"""


@query(
    "collateral_alerts",
    f"""{_CALERT.format(q=0.55)} FROM (SELECT collateral_id, rating_score AS quality_score, (SELECT avg(haircut * financing_rate_bps / 10000)
        FROM v_pool) * 10000 - haircut * financing_rate_bps AS cost_savings_bps FROM ({_RATED}))""",
    "v_pool",
)
def collateral_alerts(spark, sf):
    # Every item as if recommended at full weight.
    whole = _scored(spark, sf).withColumn("allocation_weight", F.lit(1.0)).withColumn("recommended", F.lit(True))
    alerts = collateral.collateral_alerts(allocation.recommendations(whole))
    return alerts.select("collateral_id", "alert_level", "alert_type")


@query(
    "concentration_alerts",
    f"""SELECT asset_class, max(concentration_pct) AS concentration_pct, 'CONCENTRATION_BREACH' AS alert_type
        FROM ({_SHARE}) WHERE concentration_pct > 0.165 GROUP BY 1""",
    "v_pool",
    "concentration_pct",
)
def concentration_alerts(spark, sf):
    return collateral.concentration_alerts(collateral.type_share(views.pool(spark, sf), limit=0.165))


@query(
    "allocation_totals",
    f"""SELECT sum(allocation_weight * financing_cost) AS total_cost, sum(allocation_weight * fee_rate) AS fee_revenue,
        sum(allocation_weight * capital_charge_est) AS capital_charge, sum(allocation_weight * recall_prob) AS recall_risk_weighted
        FROM ({_fill_sql(0.30)})""",
    "v_pool",
    "total_cost:9 fee_revenue:9 capital_charge recall_risk_weighted",
)
def allocation_totals(spark, sf):
    return allocation.totals(allocation.allocate(_scored(spark, sf), _objective(), cap=0.30))


def _allocated(out, *columns):
    return out.select("collateral_id", "asset_class", *columns, "allocation_weight", "recommended", "status", "gap")


@query("allocation_dual")
def allocation_dual(spark, sf):
    limits = {"haircut": ("max", 0.10), "quality_score": ("min", 0.55)}
    cost = 0.6 * F.col("cost_of_carry") - 0.05 * F.col("quality_score")
    return _allocated(allocation.allocate_within_limits(_scored(spark, sf), cost, 0.30, limits), "haircut", "quality_score")


def _multi(spark, sf):
    cost = allocation.blended_cost((0.8, 0.2, 0.6, 0.5))
    pool = _scored(spark, sf).withColumn("coverage", 1 - F.col("haircut"))
    # Quality floor, coverage less one, capital budget and recall limit.
    limits = {"quality_score": ("min", 0.55), "coverage": ("min", 0.05), "capital_charge_est": ("max", 0.04), "recall_prob": ("max", 0.15)}
    return allocation.allocate_within_limits(pool, cost, 0.35, limits)


@query("allocation_multi")
def allocation_multi(spark, sf):
    return _allocated(_multi(spark, sf), "quality_score", "coverage", "capital_charge_est", "recall_prob")


@query(
    "allocation_status",
    "SELECT 'optimal' AS status, 1.0 AS invested, true AS inside, true AS capped, true AS exact, count(*) AS items FROM v_pool",
    "v_pool",
    "invested:9",
)
def allocation_status(spark, sf):
    """What an optimum has to show: limits and caps kept, and no distance to its dual bound."""
    x = F.col("allocation_weight")
    types = _multi(spark, sf).groupBy("asset_class").agg(
        F.sum(x).alias("w"), F.count(F.lit(1)).alias("n"), F.first("status").alias("status"), F.max("gap").alias("gap"),
        *[F.sum(x * F.col(c)).alias(c) for c in ("quality_score", "coverage", "capital_charge_est", "recall_prob")],
    )
    inside = F.expr(
        "sum(quality_score) >= 0.55 - 1e-7 AND sum(coverage) >= 0.05 - 1e-7 AND sum(capital_charge_est) <= 0.04 + 1e-7 AND sum(recall_prob) <= 0.15 + 1e-7"
    )
    return types.agg(
        F.first("status").alias("status"), F.sum("w").alias("invested"), inside.alias("inside"), (F.max("w") <= 0.35 + 1e-9).alias("capped"),
        (F.max("gap") <= 1e-6).alias("exact"), F.sum("n").alias("items"),
    )


# The optimum under one limit is the largest dual value, and that lies at zero or where two items change places.
_FLOOR = f"""WITH scored AS (SELECT asset_class, 0.6 * haircut * financing_rate_bps / 10000 AS c, rating_score AS q FROM ({_RATED}) WHERE eligible),
  undominated AS (SELECT DISTINCT asset_class, c, q FROM scored s WHERE NOT EXISTS (SELECT 1 FROM scored o WHERE o.asset_class = s.asset_class
    AND o.c <= s.c AND o.q >= s.q AND (o.c < s.c OR o.q > s.q))),
  prices AS (SELECT 0.0 AS l UNION SELECT (a.c - b.c) / (a.q - b.q) FROM undominated a JOIN undominated b ON a.q > b.q AND a.c > b.c),
  best AS (SELECT l, asset_class, min(c - l * q) AS r FROM prices, undominated GROUP BY 1, 2),
  filled AS (SELECT l, r, least(0.3, greatest(0, 1 - 0.3 * (row_number() OVER (PARTITION BY l ORDER BY r, asset_class) - 1))) AS w FROM best)
  SELECT 'optimal' AS status, max(d) AS cost FROM (SELECT l, sum(w * r) + l * 0.9 AS d FROM filled GROUP BY 1)"""


@query("allocation_quality_floor", _FLOOR, "v_pool", "cost:8")
def allocation_quality_floor(spark, sf):
    pool = collateral.cost_of_carry(collateral.rating_score(views.pool(spark, sf)))
    out = allocation.allocate_within_limits(pool, 0.6 * F.col("cost_of_carry"), 0.30, {"rating_score": ("min", 0.9)})
    return out.groupBy("status").agg(F.sum(0.6 * F.col("cost_of_carry") * F.col("allocation_weight")).alias("cost"))


@query(
    "allocation_no_feasible",
    "SELECT collateral_id, 0.0 AS allocation_weight, false AS recommended, 'infeasible' AS status FROM v_pool",
    "v_pool",
    "allocation_weight",
)
def allocation_no_feasible(spark, sf):
    """No item reaches the floor, so no weights can."""
    pool = collateral.cost_of_carry(collateral.rating_score(views.pool(spark, sf)))
    out = allocation.allocate_within_limits(pool, F.col("cost_of_carry"), 0.30, {"rating_score": ("min", 1.5)})
    return out.select("collateral_id", "allocation_weight", "recommended", "status")


@query(
    "normalise_weights",
    """SELECT c_custkey, a / (a + b + c) AS w_cost, b / (a + b + c) AS w_revenue, c / (a + b + c) AS w_capital FROM (
         SELECT c_custkey, greatest(c_acctbal / 1000, 1e-6) AS a, greatest((c_custkey % 7) / 1.0, 1e-6) AS b,
           greatest((c_nationkey - 5) / 1.0, 1e-6) AS c FROM customer)""",
    "",
    "w_cost w_revenue w_capital",
)
def normalise_weights(spark, sf):
    raw = views.table(spark, sf, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 1000).alias("w_cost"),
        (F.col("c_custkey") % 7).cast("double").alias("w_revenue"),
        (F.col("c_nationkey") - 5).cast("double").alias("w_capital"),
    )
    return allocation.normalise_weights(raw, ["w_cost", "w_revenue", "w_capital"])


@query(
    "allocation_alerts",
    """SELECT s_suppkey, 'OPTIMIZATION_FAILURE' AS alert_type, 'CRITICAL' AS severity FROM supplier WHERE s_acctbal <= 0
       UNION ALL SELECT s_suppkey, 'HIGH_RECALL_RISK', 'WARNING' FROM supplier WHERE (s_suppkey % 20) / 50.0 > 0.15""",
)
def allocation_alerts(spark, sf):
    runs = views.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_acctbal") > 0, "optimal").otherwise("infeasible").alias("status"),
        ((F.col("s_suppkey") % 20) / 50).alias("recall_risk_weighted"),
    )
    return allocation.allocation_alerts(runs).select("s_suppkey", "alert_type", "severity")


@query(
    "allocation_run_alerts",
    "SELECT 'unreachable floor' AS run, 'OPTIMIZATION_FAILURE' AS alert_type, 'CRITICAL' AS severity",
)
def allocation_run_alerts(spark, sf):
    """Alerts on two solves: one inside its recall limit, and one whose floor no item reaches."""
    pool = collateral.cost_of_carry(collateral.rating_score(views.pool(spark, sf)))
    failed = allocation.allocate_within_limits(pool, F.col("cost_of_carry"), 0.30, {"rating_score": ("min", 1.5)})
    solves = {"limited": _multi(spark, sf), "unreachable floor": failed}
    runs = None
    for name, out in solves.items():
        one = out.agg(
            F.lit(name).alias("run"), F.first("status").alias("status"),
            F.sum(F.col("allocation_weight") * F.col("recall_prob")).alias("recall_risk_weighted"),
        )
        runs = one if runs is None else runs.unionByName(one)
    return allocation.allocation_alerts(runs, limit=0.15 + 1e-7).select("run", "alert_type", "severity")


@query("recall_class", "SELECT collateral_id, CASE WHEN recall_prob >= 0.3 THEN 1 ELSE 0 END AS recall_class FROM v_pool", "v_pool")
def recall_class(spark, sf):
    return views.pool(spark, sf).select("collateral_id", allocation.recall_class(F.col("recall_prob")).alias("recall_class"))
