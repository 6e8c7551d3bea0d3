"""The plans are the ones intended: few exchanges, pruned scans, no Python in the hot path."""

import re

import pytest

from __spark_entry__ import queries
from ledgerloom.operators import anomaly
from ledgerloom.operators.series import Series

Q = queries()
WITH_PYTHON = {"isolation_score", "pareto_front", "forecast_band"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_families_share_one_exchange(spark, sf):
    ticks = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id ticker", "ts date", "value rate", "1.0D benchmark")
    plan = _plan(anomaly.build_features(ticks, Series(("ticker",), ("date", "event_id"), "hour")))
    assert plan.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1


@pytest.mark.parametrize(
    "name", ["days_to_cover", "si_momentum", "price_momentum", "volume_ratio", "borrow_zscore", "utilization_change", "rsi_14"]
)
def test_panel_features_shuffle_once(spark, sf, name):
    assert _plan(Q[name](spark, sf)).count("Exchange hashpartitioning") == 1


def test_top_n_is_limited_before_the_shuffle(spark, sf):
    plan = _plan(Q["top_n_exposure"](spark, sf))
    assert re.search(r"WindowGroupLimit .*row_number\(\), 5, Partial", plan)


@pytest.mark.parametrize("name", ["price_momentum", "si_momentum", "lag_features"])
def test_scans_read_only_what_they_need(spark, sf, name):
    read = re.findall(r"ReadSchema: struct<(.*?)>", _plan(Q[name](spark, sf)))
    assert all("l_returnflag" not in r and "props" not in r for r in read)


@pytest.mark.parametrize("name", ["scan_sql_cutoff", "lookback_asof"])
def test_date_bounds_reach_the_scan(spark, sf, name):
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", _plan(Q[name](spark, sf)))


@pytest.mark.parametrize("name", ["rolling_zscore", "rsi_14", "portfolio_rollup", "stress_all", "macro_levels", "asof_fill", "demand_features"])
def test_no_python_in_the_hot_path(spark, sf, name):
    assert not re.search(r"EvalPython|InPandas|MapInArrow|Cartesian", _plan(Q[name](spark, sf)))


def test_scenarios_are_broadcast_against_the_book(spark, sf):
    plan = _plan(Q["stress_all"](spark, sf))
    assert "BroadcastNestedLoopJoin" in plan and "hashpartitioning" not in plan
