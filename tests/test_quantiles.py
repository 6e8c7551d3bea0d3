import numpy as np
import pytest

from ledgerloom.operators import quantiles
from ledgerloom.operators.quantiles import exact_quantiles

SAMPLES = {
    "normal": np.random.default_rng(0).normal(0, 1, 20_000),
    "heavy tail": np.random.default_rng(1).pareto(0.5, 20_000),
    "ties": np.random.default_rng(2).integers(0, 4, 20_000).astype(float),
    "one third equal": np.where(np.random.default_rng(3).random(20_000) < 0.34, 5.0, np.random.default_rng(4).normal(5, 2, 20_000)),
    "constant": np.full(500, 3.0),
    "two": np.array([1.0, 2.0]),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_narrowing_is_exact(spark, name):
    x = SAMPLES[name]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    wanted = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q99": 0.99, "q1": 1.0}
    got = exact_quantiles(df, "x", wanted, narrow=True).first().asDict()
    want = exact_quantiles(df, "x", wanted, narrow=False).first().asDict()
    for k, q in wanted.items():
        assert got[k] == pytest.approx(np.quantile(x, q), rel=1e-12)
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_missing_values_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert exact_quantiles(df, "x", {"m": 0.5}, narrow=True).first()["m"] == 2.0


def test_many_values_are_narrowed_however_small_their_files(spark, monkeypatch, tmp_path):
    spark.range(3_000).selectExpr("CAST(id AS DOUBLE) AS x").write.parquet(str(tmp_path / "x"))
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", 1_000)
    called, plain = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda values, qs: called.append(qs) or plain(values, qs))
    assert exact_quantiles(spark.read.parquet(str(tmp_path / "x")), "x", {"m": 0.5}).first()["m"] == 1499.5
    assert called == [[0.5]]
