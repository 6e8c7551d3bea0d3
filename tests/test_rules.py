"""Analytic cases and boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.functions.numeric import clip, nan_to_null, right_closed_bin
from ledgerloom.operators import allocation, anomaly, collateral, exposure, financing, macro, squeeze
from ledgerloom.operators.series import Series


def _values(spark, xs, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_hhi_of_one_and_of_ten_equal(spark):
    rows = [(1, 1, 5.0)] + [(2, 1, 7.0)] * 10 + [(3, 1, 0.0)]
    df = spark.createDataFrame(rows, "portfolio_id int, date int, market_value double")
    got = {r["portfolio_id"]: r["hhi_portfolio"] for r in exposure.hhi(df).collect()}
    assert got == {1: 1.0, 2: pytest.approx(0.1), 3: 0.0}


def test_risk_levels(spark):
    assert _values(spark, [0.0, 0.349, 0.35, 0.60, 0.85, 1.0], exposure.risk_level) == [
        "LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL",
    ]


def test_squeeze_tiers(spark):
    assert _values(spark, [0.1, 0.35, 0.6, 0.8], squeeze.squeeze_tier) == ["LOW", "ELEVATED", "HIGH", "CRITICAL"]


def test_right_closed_bins(spark):
    got = _values(spark, [0.0, 15.0, 15.1, 40.0, 1000.0, None], lambda x: right_closed_bin(x, macro.VIX_EDGES))
    assert got == [-1, 0, 1, 3, -1, -1]


def test_clip_keeps_missing(spark):
    assert _values(spark, [-1.0, 0.5, 9.0, None], lambda x: clip(x, 0, 1)) == [0.0, 0.5, 1.0, None]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (math.inf,), (1.0,)], "x double")
    assert [r["x"] for r in nan_to_null(df).collect()] == [None, None, 1.0]


def test_horizon_shift(spark):
    df = spark.createDataFrame([(i, 1, float(i)) for i in range(1, 6)], "id int, k int, v double")
    s = Series(("k",), ("id",), one_per_slot=True)
    out = financing.horizon_targets(df, s, "v", horizons=(2,)).orderBy("id").collect()
    assert [r["target_2d"] for r in out] == [3.0, 4.0, 5.0, None, None]


def test_forecast_alerts_can_give_both_rules(spark):
    f = spark.createDataFrame([("GC", 500.0, 505.0, 520.0, 500.0), ("X", 1.0, 1.0, 1.0, 1.0)],
                              "instrument_type string, current_rate_bps double, forecast_1d_bps double, forecast_3d_bps double, forecast_5d_bps double")
    b = spark.createDataFrame([("GC", 510.0)], "instrument_type string, budget_rate_bps double")
    out = financing.forecast_alerts(f, b).collect()
    assert {(r["horizon_days"], r["alert_type"]) for r in out} == {(3, "RATE_SPIKE"), (3, "BUDGET_BREACH")}


def test_anomaly_levels(spark):
    df = spark.createDataFrame([(0.69, False), (0.70, True), (0.80, True), (0.95, True)], "combined_score double, is_anomaly boolean")
    out = {r["combined_score"]: r["alert_level"] for r in anomaly.anomaly_alerts(df, 0.70).collect()}
    assert out == {0.70: "INFO", 0.80: "WARNING", 0.95: "CRITICAL"}


def test_unknown_rating_is_worst(spark):
    df = spark.createDataFrame([(" AAA ",), ("D",), ("??",), (None,)], "rating string")
    got = [(r["rating_numeric"], round(r["rating_score"], 6)) for r in collateral.rating_score(df).collect()]
    assert sorted(got) == [(1, 1.0), (18, 0.0), (18, 0.0), (18, 0.0)]


def test_month_end_rolls_past_the_last_business_day(spark):
    days = ["2024-03-28", "2024-03-29", "2024-03-30", "2024-03-25", "2024-12-31"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    out = df.select("d", calendar.is_month_end(F.col("d")).alias("m"), calendar.is_quarter_end(F.col("d")).alias("q")).collect()
    # The 30th of March 2024 is a Saturday after the last business day, so April's counts.
    assert {str(r["d"]): (r["m"], r["q"]) for r in out} == {
        "2024-03-28": (1, 1), "2024-03-29": (1, 1), "2024-03-30": (0, 0), "2024-03-25": (0, 0), "2024-12-31": (1, 1),
    }


def test_allocation_obeys_caps_and_sums_to_one(spark):
    pool = spark.createDataFrame(
        [(i, "abcde"[i % 5], i % 4 != 0, float(i % 7), i % 3 / 2.0, 0.05 * (i % 4)) for i in range(60)],
        "collateral_id int, asset_class string, eligible boolean, cost double, quality_score double, haircut double",
    )
    out = allocation.allocate(pool, F.col("cost"), cap=0.30).collect()
    assert sum(r["allocation_weight"] for r in out) == pytest.approx(1.0)
    assert all(r["eligible"] for r in out if r["allocation_weight"] > 0)
    by = {}
    for r in out:
        by[r["asset_class"]] = by.get(r["asset_class"], 0.0) + r["allocation_weight"]
    assert max(by.values()) <= 0.30 + 1e-12


def test_allocation_within_limits_is_near_the_optimum(spark):
    """Brute force over blends of a small pool agrees with the priced allocation."""
    import itertools

    items = [
        (1, "a", 1.0, 0.2), (2, "a", 3.0, 0.9), (3, "b", 2.0, 0.3), (4, "b", 2.5, 0.8), (5, "c", 1.5, 0.1), (6, "c", 4.0, 1.0),
    ]
    pool = spark.createDataFrame([(*i, True) for i in items], "collateral_id int, asset_class string, cost double, quality_score double, eligible boolean")
    out = allocation.allocate_within_limits(
        pool, F.col("cost"), 0.5, {"quality_score": ("min", 0.6)}
    ).collect()
    assert sum(r["allocation_weight"] for r in out) == pytest.approx(1.0)
    assert sum(r["allocation_weight"] * r["quality_score"] for r in out) >= 0.6 - 1e-9
    cost = sum(r["allocation_weight"] * r["cost"] for r in out)
    best = min(
        c for w in itertools.product(range(0, 11), repeat=5)
        if sum(w) <= 20
        for w6 in [20 - sum(w)]
        if all(x + y <= 10 for x, y in ((w[0], w[1]), (w[2], w[3]), (w[4], w6)))
        for ws in [[v / 20 for v in (*w, w6)]]
        if sum(v * i[3] for v, i in zip(ws, items)) >= 0.6 - 1e-12
        for c in [sum(v * i[2] for v, i in zip(ws, items))]
    )
    assert cost <= best + 1e-9
    assert out[0]["gap"] == pytest.approx(0.0, abs=1e-6) and out[0]["status"] == "optimal"


def test_limits_that_no_single_item_keeps(spark):
    pool = spark.createDataFrame([(1, "a", True, 0.3, 0.9, 1.0), (2, "b", True, 0.0, 0.2, 2.0)], "collateral_id int, asset_class string, eligible boolean, haircut double, quality_score double, cost double")
    limits = {"haircut": ("max", 0.16), "quality_score": ("min", 0.55)}
    first = next(r for r in allocation.allocate_within_limits(pool, F.col("cost"), 1.0, limits).collect() if r["collateral_id"] == 1)
    # The cheaper item goes as far as its haircut allows.
    assert first["allocation_weight"] == pytest.approx(0.16 / 0.3) and first["gap"] < 1e-6
    none = allocation.allocate_within_limits(pool, F.col("cost"), 1.0, {**limits, "haircut": ("max", 0.1)}).collect()
    assert [(r["allocation_weight"], r["recommended"], r["status"]) for r in none] == [(0.0, False, "infeasible")] * 2


def test_limited_allocation_beats_random_blends(spark):
    """No random feasible weights of a random pool cost less, and small changes of the optimum do not either."""
    import numpy as np

    rng = np.random.default_rng(7)
    n = 24
    a, q, c = rng.uniform(0, 1, n), rng.uniform(0, 1, n), rng.uniform(1, 3, n)
    kinds = ["abcd"[i % 4] for i in range(n)]
    pool = spark.createDataFrame(
        [(i, kinds[i], True, float(a[i]), float(q[i]), float(c[i])) for i in range(n)],
        "collateral_id int, asset_class string, eligible boolean, haircut double, quality_score double, cost double",
    )
    out = allocation.allocate_within_limits(pool, F.col("cost"), 0.4, {"haircut": ("max", 0.3), "quality_score": ("min", 0.7)}).orderBy("collateral_id").collect()
    x = np.array([r["allocation_weight"] for r in out])
    share = np.array([[k == t for k in kinds] for t in "abcd"], float)
    assert x.sum() == pytest.approx(1) and (share @ x <= 0.4 + 1e-9).all() and a @ x <= 0.3 + 1e-7 and q @ x >= 0.7 - 1e-7
    tries = np.vstack([rng.dirichlet(np.full(n, 0.1), 200_000), 0.9 * x + 0.1 * rng.dirichlet(np.full(n, 0.1), 200_000)])
    good = (tries @ share.T <= 0.4).all(axis=1) & (tries @ a <= 0.3) & (tries @ q >= 0.7)
    assert good.any() and (tries[good] @ c).min() >= c @ x - 1e-6


def test_infeasible_caps_give_zero_weights(spark):
    pool = spark.createDataFrame([(1, "a", True, 1.0), (2, "b", True, 1.0), (3, "c", True, 1.0)], "collateral_id int, asset_class string, eligible boolean, cost double")
    out = allocation.allocate(pool, F.col("cost"), cap=0.30).collect()
    assert [r["allocation_weight"] for r in out] == [0.0, 0.0, 0.0]
    assert not any(r["recommended"] for r in out)


def test_severity_floor(spark):
    df = spark.createDataFrame([("INFO",), ("WARNING",), ("CRITICAL",), ("odd",)], "severity string")
    assert {r["severity"] for r in macro.at_least(df, "WARNING").collect()} == {"WARNING", "CRITICAL"}


def test_quality_features_equal_the_single_scores(spark, sf):
    from ledgerloom.sources import views

    pool = views.pool(spark, sf).withColumn("haircut", F.col("haircut") * 300)
    single = collateral.cost_of_carry(
        collateral.type_share(collateral.liquidity_score(collateral.rating_score(collateral.duration_score(pool, "2024-07-01"))))
    )
    names = ["collateral_id", *[c for c in collateral.QUALITY_FEATURES if c != "eligible"], "cost_of_carry"]
    a = single.select(*names).orderBy("collateral_id").toPandas()
    b = collateral.build_features(pool, "2024-07-01").select(*names).orderBy("collateral_id").toPandas()
    assert ((a - b).abs().max() < 1e-9).all()
