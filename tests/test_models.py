"""Invariants of the fitted models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerloom.operators import isolation, models
from ledgerloom.operators.series import Series
from ledgerloom.plans.models import RISK_INPUTS

Q = queries()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(8, 0.5, (5, 3))])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(205))
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("trees", [10, 50])
def test_outliers_score_highest(points, trees):
    cols = ["a", "b", "c"]
    forest = isolation.fit(points, "id", cols, trees=trees, sample=64)
    again = isolation.fit(points.repartition(3), "id", cols, trees=trees, sample=64)
    assert forest["tree"].nunique() == trees
    key = ["tree", "node"]
    pd.testing.assert_frame_equal(
        forest.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True)
    )
    got = isolation.score(points, forest, cols, sample=64).toPandas()
    assert got["anomaly_raw"].between(0, 1).all()
    assert set(got.nlargest(5, "anomaly_raw")["id"]) == set(range(200, 205))


@pytest.mark.parametrize("rows", [60, 1500, 20_000])
def test_isolation_samples_are_of_one_size_at_any_number_of_rows(spark, rows):
    df = spark.range(rows).select("id", F.col("id").cast("double").alias("x"))
    forest = isolation.fit(df, "id", ["x"], trees=20, sample=100)
    roots = forest[forest["node"] == 0]["size"]
    assert len(roots) == 20 and roots.between(min(rows, 55), 155).all()


def test_draws_for_trees_are_independent(spark):
    df = spark.range(4000).select("id")
    drawn = isolation._drawn(df, "id", 30, 0.05, 42).toPandas()
    assert not drawn.duplicated().any() and drawn["tree"].between(0, 29).all()
    assert abs(len(drawn) / (4000 * 30) - 0.05) < 0.004
    both = drawn[drawn["tree"] == 3].merge(drawn[drawn["tree"] == 4], on="id")
    assert len(both) < 30


def test_bootstrap_band_covers_the_line(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 500)
    pdf = pd.DataFrame({"id": range(500), "x": x, "y": 2 + 3 * x + rng.normal(0, 0.1, 500)})
    df = spark.createDataFrame(pdf)
    latest = spark.createDataFrame([(1.0,), (-1.0,)], "x double")
    for r in models.bootstrap_band(df, ["x"], "y", "id", latest, passes=50).collect():
        assert r["lower"] <= r["forecast"] <= r["upper"]
        assert r["forecast"] == pytest.approx(2 + 3 * r["x"], abs=0.05)
        assert 0 < r["upper"] - r["lower"] < 0.1


def test_every_row_walks_the_isolation_trees_once(spark, sf, monkeypatch):
    walked, plain = spark.sparkContext.accumulator(0), isolation.score

    def counted(rows, forest, features):
        def run(batches):
            for pdf in batches:
                walked.add(len(pdf))
                yield pdf

        out = plain(rows, forest, features)
        return out.mapInPandas(run, out.schema)

    monkeypatch.setattr(isolation, "score", counted)
    assert len(Q["isolation_score"](spark, sf).collect()) == walked.value > 0


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    out = {r["label"]: r["weight"] for r in models.balanced_weights(df, "label").collect()}
    assert out == {1: 2.0, 0: pytest.approx(4 / 6)}


@pytest.mark.parametrize("only", [0, 1])
def test_a_table_of_one_class_is_scored(spark, only):
    rows = [(i, float(i), float(i % 7), only) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, z double, label int")
    model = models.fit_forest(df, ["x", "z"], "label", trees=3, depth=2)
    assert {r["p"] for r in models.class_probability(model, df, "p").collect()} == {float(only)}
    cells = models.row_attribution(model, df, ["x", "z"], models.positive_probability(), ["id"]).collect()
    assert len(cells) == 120 and {r["contribution"] for r in cells} == {0.0}


def test_smoothed_regimes_are_probabilities(spark, sf):
    row = Q["regime_gmm"](spark, sf).toPandas()
    total = row[[f"regime_prob_{i}" for i in range(5)]].sum(axis=1)
    assert np.allclose(total, 1.0)
    assert set(row["regime_id"]) <= set(range(5))


def test_kmeans_regimes_are_ordered(spark, sf):
    ids = Q["regime_kmeans"](spark, sf).toPandas()
    assert set(ids["regime_id"]) == set(range(5))


@pytest.mark.parametrize(
    "name,column",
    [("isolation_score", "if_score"), ("quality_score", "quality_score"), ("risk_probability", "risk_score"),
     ("calibrated_probability", "squeeze_probability")],
)
def test_scores_lie_between_0_and_1(spark, sf, name, column):
    low, high, n, missing = Q[name](spark, sf).agg(
        F.min(column), F.max(column), F.count(F.lit(1)), F.count_if(F.col(column).isNull())
    ).first()
    assert n > 0 and missing == 0 and 0 <= low <= high <= 1


def test_reconstruction_error_is_padded(spark, sf):
    out = Q["reconstruction_error"](spark, sf).toPandas()
    assert len(out) == spark.read.parquet(f"{sf}/events.parquet").count()
    scored = out.groupby("ticker").filter(lambda g: len(g) >= 20)
    assert scored["reconstruction_error"].notna().all()


def test_quantile_forecast_floor_and_coverage(spark, sf):
    out = Q["quantile_forecast"](spark, sf).toPandas()
    assert (out["demand_forecast"] >= 0).all()
    known = out.dropna(subset=["target_1d"])
    assert 0.5 < (known["target_1d"] <= known["demand_forecast"]).mean() < 0.7


def test_forecasts_per_horizon(spark, sf):
    out = Q["multi_horizon_forecast"](spark, sf).toPandas()
    assert {"forecast_1d_bps", "forecast_3d_bps", "forecast_5d_bps"} <= set(out.columns) and len(out) == 5


def test_horizons_with_few_rows_are_left_out(spark):
    df = spark.createDataFrame([(float(i), float(i), None if i > 3 else 1.0) for i in range(30)], "x double, a double, b double")
    assert set(models.multi_horizon(df, ["x"], {1: "a", 5: "b"}, rounds=2)) == {1}


def test_attribution_sums_over_used_features(spark, sf):
    out = Q["row_attribution"](spark, sf).toPandas()
    assert set(out.groupby(["portfolio_id", "date"]).size()) == {len(RISK_INPUTS)}
    assert out["contribution"].abs().max() > 0


def test_curve_factors_explain_in_falling_order(spark, sf):
    r = Q["curve_pca"](spark, sf).first()
    assert r["explained_1"] >= r["explained_2"] >= r["explained_3"] > 0


def test_series_type(spark):
    assert Series(("k",), ("t",)).slot == "day"


def test_calibrated_scores_travel_to_python_once_and_no_rows_are_kept(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.random(400)
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "x": x, "label": (rng.random(400) < x).astype(int)}))

    def persist(*_):
        raise AssertionError("rows are kept in memory")

    monkeypatch.setattr(type(df), "persist", persist)
    out = models.calibrated_probability(df, ["x"], "label", ["id"], "p", folds=3, rounds=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapIn" not in plan
    assert out.columns == ["id", "x", "label", "p"]
    got = out.toPandas()
    assert len(got) == 400 and got["p"].between(0, 1).all() and got["p"][got.x > 0.8].mean() > got["p"][got.x < 0.2].mean()
