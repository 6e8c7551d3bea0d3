import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import scenarios as sc
from ledgerloom.operators import stress
from ledgerloom.sources import views


def test_base_case_changes_nothing(spark, sf):
    base = stress.apply_all(views.pool(spark, sf), sc.standard(spark).where("scenario_id = 'S01'"))
    moved = base.where(
        (F.col("market_value") != F.col("base_market_value"))
        | (F.col("haircut") != F.col("base_haircut"))
        | (F.col("recall_prob") != F.col("base_recall_prob"))
    )
    assert moved.count() == 0
    row = stress.summary(base).first()
    assert row["pnl_impact_usd"] == 0 and not row["any_breach"]


def test_all_scenarios_run_in_one_table(spark, sf):
    rows = stress.summary(stress.apply_all(views.pool(spark, sf), sc.standard(spark))).collect()
    assert {r["scenario_id"] for r in rows} == {"S01", "S02", "S05", "S08", "S12", "S13"}
    assert all(r["collateral_shortfall_usd"] >= 0 for r in rows)


def test_name_shock_replaces_the_uniform_one_even_at_minus_100_percent(spark):
    s = sc.validated(sc.as_table(spark, [{
        "scenario_id": "T", "name": "t", "severity": "Severe",
        "shocks": {"equity_shock_pct": -1.0, "name_specific_equity_shocks": {"C": -0.5}},
    }]))
    book = spark.createDataFrame([("C", 10.0), ("X", 10.0)], "ticker string, market_value double").withColumn("asset_class", F.lit("Equity"))
    got = {r["ticker"]: r["market_value"] for r in stress.shock_equity(stress.against(book, s)).collect()}
    assert got == {"C": 5.0, "X": 0.0}


def test_haircut_points_or_floor(spark):
    s = sc.validated(sc.as_table(spark, [{"scenario_id": "T", "name": "t", "severity": "Severe", "shocks": {"haircut_floor_increase_pp": 5}}]))
    book = spark.createDataFrame([("UST", 0.02, True), ("UST", 0.98, True)], "asset_class string, haircut double, eligible boolean")
    added = sorted(r["haircut"] for r in stress.shock_regulation(stress.against(book, s)).collect())
    floored = sorted(r["haircut"] for r in stress.shock_regulation(stress.against(book, s), floor=True).collect())
    assert added == [pytest.approx(0.07), 1.0]
    assert floored == [0.05, 0.98]


def test_invalid_scenarios_are_left_out(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(
        "scenario_id: A\nname: ok\nseverity: Severe\nshocks:\n  rate_shift_bps: 10\nreporting:\n  breach_thresholds:\n    financing_cost_delta_bps: 7\n"
    )
    (tmp_path / "b.yaml").write_text("scenario_id: B\nname: no severity\nshocks: {}\n")
    (tmp_path / "c.yaml").write_text("scenario_id: C\nname: odd\nseverity: Mild\nshocks: {}\n")
    (tmp_path / "d.yaml").write_text("scenario_id: D\nname: list\nseverity: Severe\nshocks: [1]\n")
    (tmp_path / "e.yaml").write_text("a: [unclosed\n")
    rows = sc.load(spark, str(tmp_path)).collect()
    assert [r["scenario_id"] for r in rows] == ["A"]
    assert rows[0]["sofr_shock_bps"] == 10.0 and rows[0]["breach_thresholds"] == {"financing_cost_delta_bps": 7.0}


def test_largest_counterparty_takes_the_placeholder(spark):
    loans = spark.createDataFrame([(1, 5.0, 1.0), (2, 9.0, 1.0), (2, 9.0, 1.0), (3, 17.0, 1.0)], "counterparty_id int, notional double, borrow_volume double")
    named = sc.name_counterparties(sc.standard(spark), loans, {"COUNTERPARTY_LEHMAN": "3"})
    left = stress.surviving_loans(loans, named)
    gone = {s: {1, 2, 3} - {r["counterparty_id"] for r in left.where(F.col("scenario_id") == s).collect()} for s in ("S01", "S05", "S08")}
    assert gone == {"S01": set(), "S05": {3}, "S08": {2}}


def test_monte_carlo_matches_its_covariance(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    cov = np.array([[4.0, 1.0, -0.5], [1.0, 2.0, 0.3], [-0.5, 0.3, 1.0]])
    moves = spark.createDataFrame([tuple(map(float, r)) for r in rng.multivariate_normal([0, 0, 0], cov, 20_000)], "a double, b double, c double")
    book = spark.createDataFrame([("UST", 100.0, 0.0, 2.0, 0.0), ("Equity", 50.0, 0.0, 0.0, 0.0)], "asset_class string, market_value double, haircut double, modified_duration double, spread_duration double")
    pnl = stress.simulate(book, moves, ["a", "b", "c"], [0.01, 0.01, 0.01], draws=50_000)
    row = stress.var_es(pnl).first()
    load = np.array([-200.0, 0.0, 50.0]) * 0.01
    sd = float(np.sqrt(load @ np.cov(moves.toPandas().to_numpy().T) @ load))
    assert row["var_95"] == pytest.approx(-1.645 * sd, rel=0.05)
    assert row["var_99"] == pytest.approx(-2.326 * sd, rel=0.06)
    assert row["es_95"] <= row["var_95"] and row["es_99"] <= row["var_99"]


def test_reverse_stress_finds_the_first_breach(spark, sf):
    one = sc.standard(spark).where("scenario_id = 'S13'")
    pool = views.pool(spark, sf)
    share = stress.reverse_stress(pool, one, "collateral_shortfall_usd", 5_000.0).first()["share"]
    assert 0 < share <= 1
    assert stress.reverse_stress(pool, one, "collateral_shortfall_usd", 1e15).first()["share"] is None
