"""Model queries: seeded, checked by row counts and invariants."""

from pyspark.sql import functions as F

from ..functions.numeric import numeric_columns
from ..operators import anomaly, collateral, exposure, financing, isolation, macro, models, squeeze
from ..operators.quantiles import exact_quantiles
from ..operators.sequences import pad_first_score, sliding_sequences
from ..operators.series import latest_row, over_history
from ..operators.sizes import attach_one_row
from ..session import lineage_cut, shared_dir
from ..sources import views
from ..sources.views import MACRO_DAYS, PANEL_SERIES, RATE_SERIES, REPO_SERIES, Series
from . import portfolio
from .registry import query


@query("isolation_score")
def isolation_score(spark, sf):
    rows = anomaly.build_features(views.rates(spark, sf), RATE_SERIES).select("event_id", "ticker", *anomaly.FEATURES)
    rows = lineage_cut(rows, "rate-features")
    forest = isolation.fit(rows, "event_id", anomaly.FEATURES)
    # The range, the cut and the result read the scores: the walk over all trees runs once.
    scored = lineage_cut(isolation.score(rows, forest, anomaly.FEATURES).select("event_id", "ticker", "anomaly_raw"), "isolation")
    raw = scored.withColumn("raw", -F.col("anomaly_raw"))
    out = anomaly.normalise_score(raw, anomaly.training_range(raw, "raw"), "raw", "if_score")
    cut = exact_quantiles(out, "if_score", {"cut": 0.95})
    return attach_one_row(out, cut).select(
        "event_id", "ticker", "if_score", (F.col("if_score") > F.col("cut")).alias("is_anomaly")
    )


@query("reconstruction_error")
def reconstruction_error(spark, sf):
    sequences = sliding_sequences(views.rates(spark, sf), RATE_SERIES, "rate", 20)
    errors = models.reconstruction_error(sequences, "sequence").select("event_id", "reconstruction_error")
    scored = sequences.drop("sequence").join(errors, "event_id", "left")
    padded = pad_first_score(scored, RATE_SERIES, "reconstruction_error")
    cut = exact_quantiles(padded, "reconstruction_error", {"cut": 0.95})
    return attach_one_row(padded, cut).select(
        "event_id", "ticker", "reconstruction_error", (F.col("reconstruction_error") > F.col("cut")).alias("is_anomaly")
    )


@query("quality_score")
def quality_score(spark, sf):
    """Fit on a blend of rating, liquidity and duration; save, load and score with the loaded model."""
    pool = collateral.build_features(views.pool(spark, sf), "2024-07-01").withColumn(
        "label", 0.5 * F.col("rating_score") + 0.3 * F.col("liquidity_score") + 0.2 * F.col("duration_score")
    )
    model = models.fit_regression(pool, collateral.QUALITY_FEATURES, "label", rounds=10)
    path = shared_dir(spark, "quality-model")
    models.save(model, path)
    scored = models.predict(models.load(path), pool, "quality_score", 0.0, 1.0)
    return scored.select("collateral_id", "asset_class", "quality_score")


RISK_INPUTS = [c for c in exposure.RISK_FEATURES if c != "top5_exposure_pct"]


def _risk_table(spark, sf):
    table = portfolio.rollup(spark, sf).withColumn("label", (F.col("top5_exposure_pct") > 45).cast("int"))
    # One row per portfolio and month; fitting passes over it many times.
    return lineage_cut(table.select("portfolio_id", "date", *exposure.RISK_FEATURES, "label"), "risk")


@query("risk_probability")
def risk_probability(spark, sf):
    table = _risk_table(spark, sf)
    scored = models.class_probability(models.fit_forest(table, RISK_INPUTS, "label"), table, "risk_score")
    return exposure.risk_alerts(scored, "risk_score").select("portfolio_id", "date", "risk_score", "risk_level", "alert_flag")


@query("row_attribution")
def row_attribution(spark, sf):
    table = _risk_table(spark, sf)
    model = models.fit_forest(table, RISK_INPUTS, "label")
    return models.row_attribution(model, table, RISK_INPUTS, models.positive_probability(), ["portfolio_id", "date"])


# Every round is a few Spark jobs one after another; the README has what a round takes.
SQUEEZE_ROUNDS, REPO_ROUNDS = 20, 20
PANEL_KEY = ["ticker", "order_id", "line_no", "counterparty_id"]


@query("calibrated_probability")
def calibrated_probability(spark, sf):
    """Chance that the next price is at least a tenth higher."""
    panel = squeeze.build_features(views.panel(spark, sf), PANEL_SERIES)
    panel = over_history(
        panel, PANEL_SERIES, lambda d, w: d.withColumn("next_close", F.lag("close").over(w)), depth=1, descending=True
    )
    labelled = panel.withColumn("label", (F.col("next_close") >= F.col("close") * 1.1).cast("int"))
    labelled = lineage_cut(labelled.select(*PANEL_KEY, *squeeze.SQUEEZE_FEATURES, "label"), "squeeze")
    scored = models.calibrated_probability(
        labelled, squeeze.SQUEEZE_FEATURES, "label", PANEL_KEY, "squeeze_probability", folds=3, rounds=SQUEEZE_ROUNDS
    )
    return scored.select(*PANEL_KEY, "squeeze_probability", squeeze.squeeze_tier(F.col("squeeze_probability")).alias("risk_tier"))


def _repo_features(spark, sf):
    rows = financing.build_features(views.repo(spark, sf), REPO_SERIES)
    return financing.horizon_targets(rows, REPO_SERIES, "rate_bps")


def _fitted(spark, sf):
    rows = lineage_cut(_repo_features(spark, sf), "repo")
    targets = {h: f"target_{h}d" for h in (1, 3, 5)}
    inputs = numeric_columns(rows, exclude=("event_id", *targets.values()))
    return rows, inputs, models.multi_horizon(rows, inputs, targets, rounds=REPO_ROUNDS)


@query("multi_horizon_forecast")
def multi_horizon_forecast(spark, sf):
    rows, _, fitted = _fitted(spark, sf)
    latest = latest_row(rows, REPO_SERIES)
    out = models.forecast(fitted, latest)
    return out.select("instrument_type", F.col("rate_bps").alias("current_rate_bps"), *[f"forecast_{h}d_bps" for h in fitted])


@query("feature_importance")
def feature_importance(spark, sf):
    _, inputs, fitted = _fitted(spark, sf)
    return models.feature_importance(list(fitted.values()), inputs, spark)


@query("forecast_band")
def forecast_band(spark, sf):
    days = views.macro(spark, sf).select("date", "vix")
    days = financing.lag_features(days, MACRO_DAYS, "vix", lags=(1, 2, 3, 5)).withColumn("id", F.unix_date("date"))
    lags = ["vix_lag_1", "vix_lag_2", "vix_lag_3", "vix_lag_5"]
    return models.bootstrap_band(days, lags, "vix", "id", days.select("date", "vix", *lags), passes=100).select(
        "date", "vix", "forecast", "lower", "upper"
    )


MACRO_INPUTS = ["sofr", "fed_funds", "t_2yr", "t_10yr", "hy_oas", "ig_oas", "vix", "ted_spread"]


def _macro(spark, sf):
    return views.macro(spark, sf).select("date", *MACRO_INPUTS).dropna()


@query("regime_kmeans")
def regime_kmeans(spark, sf):
    return models.kmeans_regimes(_macro(spark, sf), MACRO_INPUTS, "vix").select("date", "regime_id")


@query("regime_gmm")
def regime_gmm(spark, sf):
    out = models.mixture_regimes(_macro(spark, sf), MACRO_INPUTS, MACRO_DAYS, "vix")
    return out.select("date", "regime_id", *[f"regime_prob_{i}" for i in range(5)])


@query("demand_signal")
def demand_signal(spark, sf):
    """Five-day change of reserves, five days ahead, from spread features."""
    days = macro.spread_features(views.macro(spark, sf), MACRO_DAYS, windows=(60,))
    days = squeeze.momentum(days, MACRO_DAYS, "reserve_balances", "reserves_change", windows=(5,))
    days = financing.horizon_targets(days, MACRO_DAYS, "reserves_change_5", horizons=(5,))
    inputs = [f"{c}_mom5d" for c in macro.SPREADS] + ["reserves_change_5"]
    model = models.fit_regression(days.dropna(subset=inputs), inputs, "target_5d", rounds=10)
    out = models.predict(model, days.dropna(subset=inputs), "demand_signal")
    direction = F.when(F.col("demand_signal") > 0.01, "Increasing").when(F.col("demand_signal") < -0.01, "Decreasing")
    return out.select("date", "demand_signal", direction.otherwise("Stable").alias("demand_direction"))


@query("curve_pca")
def curve_pca(spark, sf):
    tenors = ["t_3mo", "t_2yr", "t_5yr", "t_10yr"]
    scores, explained = models.curve_factors(views.macro(spark, sf), tenors)
    return scores.withColumns({f"explained_{i + 1}": F.lit(v) for i, v in enumerate(explained)})
