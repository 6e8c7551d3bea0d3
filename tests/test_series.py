"""Cut histories give what uncut ones give, whatever the balance of keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.rolling import Rolling
from ledgerloom.operators import anomaly, exposure, financing, squeeze
from ledgerloom.operators import series as series_operators
from ledgerloom.operators.series import (
    Series,
    first_row,
    last_known,
    latest_row,
    latest_rows,
    numbered,
    over_history,
    oversized_keys,
)

S = Series(("k",), ("t", "id"), "day")


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows under one key, uneven days, missing values, a NULL key."""
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    day = np.minimum(rng.exponential(20, n).astype(int), 90)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "k": key,
            "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(day, "D") + pd.to_timedelta(rng.integers(0, 3, n), "h"),
            "x": rng.random(n) * 100,
        }
    )
    df = spark.createDataFrame(pdf)
    return df.select(
        "id",
        F.when(F.col("id") % 97 != 0, F.col("k").cast("int")).alias("k"),
        "t",
        F.when(F.col("x") >= 5, F.col("x")).alias("x"),
    ).cache()


def _compute(d, w):
    r = Rolling(w)
    return r.add(d, {"lag7": r.lag("x", 7), "mean10": r.mean("x", 10, 3), "sd20": r.sd("x", 20, 2)})


def _rows(df, digits=9):
    pdf = df.toPandas().sort_values("id").reset_index(drop=True)
    return pdf[sorted(pdf.columns)].round(digits)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("chunk", [21, 50, 200])
def test_cut_equals_uncut(hot, conf, descending, chunk):
    plain = _rows(over_history(hot, S, _compute, depth=19, descending=descending))
    conf(smallInputBytes=0, chunkRows=chunk)
    assert oversized_keys(hot, S.keys, chunk) is not None
    cut = _rows(over_history(hot, S, _compute, depth=19, descending=descending))
    pd.testing.assert_frame_equal(plain, cut)


def test_cut_without_broadcast(hot, conf):
    plain = _rows(over_history(hot, S, _compute, depth=19))
    conf(smallInputBytes=0, chunkRows=50, broadcastRows=0)
    pd.testing.assert_frame_equal(plain, _rows(over_history(hot, S, _compute, depth=19)))


def test_cut_spreads_the_hot_key(hot, conf):
    conf(smallInputBytes=0, chunkRows=100)
    seen = {}

    def compute(d, w):
        seen["chunks"] = d.groupBy("k", "__chunk").count().where("k = 0").count()
        seen["largest"] = d.groupBy("k", "__chunk").count().agg(F.max("count")).first()[0]
        return d

    assert over_history(hot, S, compute, depth=5).count() == hot.count()
    assert seen["chunks"] > 5
    largest_day = hot.groupBy("k", F.to_date("t")).count().agg(F.max("count")).first()[0]
    assert seen["largest"] <= 100 + 2 * largest_day


def test_operators_agree_when_cut(spark, hot, conf):
    rates = hot.withColumnRenamed("x", "rate").withColumn("benchmark", F.lit(40.0)).where("rate is not null")
    plain = _rows(anomaly.build_features(rates, S))
    targets = _rows(financing.horizon_targets(rates, S, "rate"))
    conf(smallInputBytes=0, chunkRows=60)
    pd.testing.assert_frame_equal(plain, _rows(anomaly.build_features(rates, S)))
    pd.testing.assert_frame_equal(targets, _rows(financing.horizon_targets(rates, S, "rate")))


def _wilder(prices, n=14):
    step = np.diff(prices, prepend=prices[0])
    up = down = 0.0
    out = []
    for i, s in enumerate(step):
        up, down = up * (n - 1) / n + max(s, 0) / n, down * (n - 1) / n + max(-s, 0) / n
        out.append(np.nan if i < n - 1 else 100.0 if down == 0 else 100 - 100 / (1 + up / down))
    return np.array(out)


def test_rsi_over_long_history(spark, conf):
    rng = np.random.default_rng(2)
    n = 60_000
    step = rng.normal(0, 1, n)
    step[20_000:26_000] = 0.0  # a flat stretch longer than a block
    price = 1000 + np.cumsum(step)
    pdf = pd.DataFrame({"id": np.arange(n), "k": 1, "t": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n) // 40, "D"), "close": price})
    df = spark.createDataFrame(pdf)
    want = _wilder(price)
    plain = squeeze.rsi(df, S).orderBy("id").toPandas()["rsi_14"].to_numpy()
    flat = slice(20_600, 26_000)  # beyond 600 flat rows both averages are rounding noise
    for got in (plain,):
        ok = np.ones(n, dtype=bool)
        ok[flat] = False
        np.testing.assert_allclose(got[ok], want[ok], rtol=0, atol=1e-6, equal_nan=True)
    conf(smallInputBytes=0, chunkRows=17_000)
    cut = squeeze.rsi(df, S).orderBy("id").toPandas()["rsi_14"].to_numpy()
    ok = np.ones(n, dtype=bool)
    ok[flat] = False
    np.testing.assert_allclose(cut[ok], want[ok], rtol=0, atol=1e-6, equal_nan=True)


def test_rsi_without_losses_is_100(spark):
    df = spark.range(40).select("id", F.lit(1).alias("k"), F.timestamp_seconds("id").alias("t"), F.col("id").cast("double").alias("close"))
    out = [r["rsi_14"] for r in squeeze.rsi(df, S).orderBy("id").collect()]
    assert out[:13] == [None] * 13
    assert out[13:] == [100.0] * 27


@pytest.mark.parametrize("chunk", [None, 40, 300])
def test_last_known(hot, conf, chunk):
    known = hot.where("k is not null")
    pdf = known.toPandas().sort_values(["t", "id"])
    want = pdf.assign(x=pdf.groupby("k")["x"].ffill()).sort_values("id")["x"].to_numpy()
    if chunk:
        conf(smallInputBytes=0, chunkRows=chunk)
    got = last_known(known, S, "x", "known").orderBy("id").toPandas()["known"].to_numpy(dtype=float)
    np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("descending", [False, True])
def test_one_moment_holds_a_third_of_all_rows(spark, conf, descending):
    """Cutting by time cannot help here, so rows are cut by position."""
    df = spark.range(1500).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).cast("int").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("timestamp").alias("t"),
        ((F.col("id") * 7919) % 1000).cast("double").alias("x"),
    )
    plain = _rows(over_history(df, S, _compute, depth=19, descending=descending))
    known = _rows(last_known(df, S, "x", "known"))
    conf(smallInputBytes=0, chunkRows=60)
    largest = {}

    def compute(d, w):
        largest["n"] = d.groupBy("k", "__chunk").count().agg(F.max("count")).first()[0]
        return _compute(d, w)

    pd.testing.assert_frame_equal(plain, _rows(over_history(df, S, compute, depth=19, descending=descending)))
    assert largest["n"] <= 60 + 19
    pd.testing.assert_frame_equal(known, _rows(last_known(df, S, "x", "known")))


def test_asof_fill_is_per_key_and_never_looks_ahead(spark):
    p = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "order_id int, isin string, d int")
    m = spark.createDataFrame([("a", 2, 10.0), ("a", 5, 20.0), ("b", 10, 30.0)], "isin string, d int, price double")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))
    out = exposure.asof_fill(p.withColumn("date", day), m.withColumn("date", day), "price", "isin", "date", "order_id")
    assert {r["order_id"]: r["asof_price"] for r in out.collect()} == {1: 20.0, 2: None, 3: None}


def test_latest_and_first_rows(hot):
    pdf = hot.where("k is not null").toPandas().sort_values(["t", "id"])
    last = pdf.groupby("k").tail(1).set_index("k")["id"].to_dict()
    assert {r["k"]: r["id"] for r in latest_row(hot.where("k is not null"), S).collect()} == last
    tail = set(pdf.groupby("k").tail(3)["id"])
    assert {r["id"] for r in latest_rows(hot.where("k is not null"), S, 3).collect()} == tail
    first = pdf.groupby("k").head(1).set_index("k")["id"].to_dict()
    assert {r["k"]: r["id"] for r in first_row(hot.where("k is not null"), ["k"], ["t", "id"]).collect()} == first


def test_numbering_over_slices(spark):
    ids = spark.range(0, 5000, 7).select("id")
    out = numbered(ids, "id", "n", slices=7).orderBy("id").toPandas()
    assert list(out["n"]) == list(range(1, len(out) + 1))


def test_numbering_of_sparse_ids_takes_few_ranges(spark):
    ids = spark.range(3000).select(F.xxhash64("id").alias("id"))
    out = numbered(ids, "id", "n", slices=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert list(out.orderBy("id").toPandas()["n"]) == list(range(1, 3001))


def test_long_histories_in_small_files_are_cut(spark, tmp_path):
    spark.range(600_000).selectExpr("CAST(1 AS BIGINT) AS k", "xxhash64(id) AS x").write.parquet(str(tmp_path / "x"))
    long = series_operators.oversized_keys(spark.read.parquet(str(tmp_path / "x")), ("k",), series_operators.CHUNK_ROWS)
    assert [r["k"] for r in long.collect()] == [1]
