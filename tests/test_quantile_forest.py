"""Quantile forests: leaves against plain quantiles, spread that moves with the features, and coverage that can fail."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import quantile_forest

ALPHA = 0.7


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 6000
    x, wide = rng.random(n) * 10, rng.integers(0, 2, n)
    near = x + rng.normal(size=n) * np.where(wide, 3.0, 0.3)
    far = -2 * x + rng.normal(size=n) * np.where(wide, 0.5, 5.0)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "wide": wide.astype(float), "near": near, "far": far})
    frame = spark.createDataFrame(pdf)
    # Outputs are not known everywhere, nor is a feature.
    frame = frame.withColumn("far", F.when(F.col("id") % 7 != 0, F.col("far"))).withColumn("x", F.when(F.col("id") % 50 != 1, F.col("x")))
    return frame.withColumn("fold", F.col("id") % 5).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return quantile_forest.fit(rows.where("fold < 3"), ["x", "wide"], ["near", "far"], ALPHA, rows.where("fold = 3"), "wide", trees=15, depth=6)


def test_leaves_hold_the_quantiles_of_their_rows(rows, fitted):
    train = rows.where("fold < 3").dropna(subset=["x"])
    fallen = quantile_forest._fallen(fitted.forest, train).select("near", "far", F.posexplode("__leaf").alias("tree", "leaf")).toPandas()
    kept = fitted.leaves.first()
    seen = 0
    for (tree, leaf), g in fallen.groupby(["tree", "leaf"]):
        for c in ("near", "far"):
            known = np.sort(g[c].dropna())
            got = kept[f"__{c}"][tree][int(leaf)]
            assert got in (known[int(np.ceil(ALPHA * len(known))) - 1], known[min(len(known) - 1, int(np.floor(ALPHA * len(known))))])
            seen += 1
    assert seen > 200 and len(kept["__near"]) == 15


def test_the_spread_moves_with_the_features(rows, fitted):
    out = fitted.predict(rows.where("fold = 4")).toPandas()
    assert len(out) == rows.where("fold = 4 AND x IS NOT NULL").count()
    z = 0.5244
    for wide, near, far in ((1, 3.0, 0.5), (0, 0.3, 5.0)):
        part = out[out.wide == wide]
        assert (part.near_q - part.x).mean() == pytest.approx(z * near, abs=0.35)
        assert (part.far_q + 2 * part.x).mean() == pytest.approx(z * far, abs=0.6)


def test_coverage_holds_and_can_fail(rows, fitted):
    out = fitted.predict(rows.where("fold = 4"))
    good = quantile_forest.coverage(out, ["near", "far"], ALPHA, F.col("wide"), "wide").collect()
    assert len(good) == 4 and all(r["covered"] for r in good)
    moved = quantile_forest.coverage(out.withColumn("near_q", F.col("near_q") + 0.4), ["near"], ALPHA, F.col("wide"), "wide").collect()
    assert {r["wide"]: r["covered"] for r in moved}[0.0] is False
    # A constant shift would be right in all and wrong in each group.
    flat = rows.where("fold = 4").withColumn("near_q", F.col("x") + F.lit(1.1)).dropna(subset=["x"])
    assert not all(r["covered"] for r in quantile_forest.coverage(flat, ["near"], ALPHA, F.col("wide"), "wide").collect())


def test_floor_missing_groups_and_no_calibration(rows, fitted):
    strange = rows.where("fold = 4").withColumn("wide", F.lit(7.0))
    assert fitted.predict(strange).where("near_q IS NULL").count() == 0
    plain = quantile_forest.fit(rows.where("fold < 3"), ["x", "wide"], ["near", "far"], ALPHA, trees=5, depth=4, floor=0.0)
    out = plain.predict(rows)
    assert out.columns == [*rows.columns, "near_q", "far_q"]
    assert out.agg(F.min("far_q")).first()[0] == 0.0
    assert plain.predict(rows.where("false")).count() == 0
    none = quantile_forest.fit(rows.where("false"), ["x", "wide"], ["near"], ALPHA, rows.where("fold = 3"), "wide")
    assert none.predict(rows).where("near_q IS NOT NULL").count() == 0


def test_quantiles_of_leaves_are_exact_however_rows_are_dealt(spark):
    rng = np.random.default_rng(4)
    n = 5000
    leaf = np.column_stack([rng.integers(0, 40, n), rng.integers(0, 300, n), np.zeros(n, int)]).astype(float)
    near, far = rng.normal(size=n), rng.integers(0, 9, n).astype(float)
    pdf = pd.DataFrame({"__leaf": leaf.tolist(), "near": near, "far": far, "id": np.arange(n)})
    frame = spark.createDataFrame(pdf).withColumn("near", F.when(F.col("id") % 3 != 0, F.col("near"))).repartition(7)
    got = quantile_forest.leaf_quantiles(frame, ["near", "far"], ALPHA, counted=400).toPandas().set_index(["tree", "leaf"])
    assert len(got) == sum(len(set(leaf[:, t])) for t in range(3))
    for (tree, at), row in got.iterrows():
        own = leaf[:, tree] == at
        for c, y in (("near", near[own & (np.arange(n) % 3 != 0)]), ("far", far[own])):
            assert np.isnan(row[c]) if not len(y) else row[c] == np.sort(y)[int(np.ceil(ALPHA * len(y))) - 1]
    # Of a leaf with more values than a task keeps, ranks move by a share of the rows.
    rank = {v: r for r, v in enumerate(np.sort(near[np.arange(n) % 3 != 0]))}
    thin = quantile_forest.leaf_quantiles(frame, ["near", "far"], ALPHA, accuracy=50).where("tree = 2").first()
    assert abs(rank[thin["near"]] / len(rank) - ALPHA) <= 1 / 50 and thin["far"] == got.loc[(2, 0), "far"]


def test_training_rows_are_not_kept_in_memory_and_leaves_are_looked_up_once(spark, rows, monkeypatch):
    def persist(*_):
        raise AssertionError("rows are kept in memory")

    monkeypatch.setattr(type(rows), "persist", persist)
    fitted = quantile_forest.fit(rows.where("fold < 3"), ["x", "wide"], ["near", "far"], ALPHA, rows.where("fold = 3"), "wide", trees=3, depth=3)
    plan = fitted.raw(rows.select("id", "x", "wide"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "zip_with" not in plan
