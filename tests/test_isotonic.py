"""Isotonic fits over ranges against one-task fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from ledgerloom.operators import isotonic


def cases():
    rng = np.random.default_rng(9)
    x = rng.random(3000)
    yield "noisy labels", x, (rng.random(3000) < x).astype(float)
    yield "few scores", np.round(x, 1), (rng.random(3000) < x).astype(float)
    yield "rising", x, x
    yield "falling", x, 1 - x
    yield "steps", x, np.floor(x * 4) % 2
    yield "one", np.array([0.5]), np.array([1.0])


@pytest.mark.parametrize("name,x,y", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_fits_equal_the_fit_in_one_task(spark, name, x, y):
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(3)
    blocks = isotonic.fit(frame, "x", "y")
    found = blocks.toPandas().sort_values("low")
    value = (found.total / found.weight).to_numpy()
    assert (np.diff(value) > 0).all() and found.weight.sum() == len(x)
    grid = spark.createDataFrame(pd.DataFrame({"x": np.concatenate([np.linspace(-0.1, 1.1, 400), x[:400]])}))
    points = frame.groupBy("x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    want = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(points).transform(grid).orderBy("x").toPandas()["prediction"]
    for travel in (10**6, 0):
        got = isotonic.apply(grid, "x", blocks, "p", travel=travel).orderBy("x").toPandas()["p"]
        assert np.allclose(got, want, atol=1e-9)


def test_missing_scores_and_no_points(spark):
    frame = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (None, 1.0), (0.3, None), (float("nan"), 1.0)], "x double, y double")
    blocks = isotonic.fit(frame, "x", "y")
    assert blocks.agg(F.sum("weight")).first()[0] == 2
    got = {r["x"]: r["p"] for r in isotonic.apply(frame.dropna(subset=["y"]).where("x IS NULL OR x < 1"), "x", blocks, "p").collect()}
    assert got == {0.1: 0.0, 0.2: 1.0, None: None}
    none = isotonic.fit(frame.where("false"), "x", "y")
    assert none.count() == 0 and isotonic.apply(frame, "x", none, "p").where("p IS NOT NULL").count() == 0
