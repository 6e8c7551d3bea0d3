import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import publish, scan
from ledgerloom.sources.contracts import Contract, coerce_numeric, merged, normalise_headers
from ledgerloom.sources.synthetic import random_walk_panel


def test_json_payload_shapes(spark, tmp_path):
    lines = [{"data": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]}, {"rows": [{"a": 3, "b": "z"}]}, {"a": 4, "b": "w"}]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in lines))
    rows = scan.load(spark, {"source_type": "json", "path": str(tmp_path), "schema": "a bigint, b string"}).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]


def test_headers_and_numbers(spark):
    df = spark.createDataFrame([("1.5", "x"), ("bad", "y"), ("NaN", "z")], "`Rate BPS ` string, Name string")
    out = coerce_numeric(normalise_headers(df), ["rate_bps"]).collect()
    assert [r["rate_bps"] for r in out] == [1.5, None, None]


def test_contract_modes(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "ticker string, rate double")
    assert not Contract(("ticker",), keys=("ticker",)).check(df)
    assert Contract(("ticker",), warn_null=("ticker",)).check(df)
    with pytest.raises(ValueError, match="missing columns"):
        Contract(("nope",), mode="raise").check(df)


def test_cache_refreshes_only_when_stale(spark, tmp_path):
    path, calls = str(tmp_path / "series"), []

    def refresh(day):
        def fetch():
            calls.append(day)
            return spark.createDataFrame([(day, 1.0)], "d string, v double").withColumn("d", F.to_date("d"))
        return fetch

    def failing():
        raise OSError("source is down")

    with pytest.raises(OSError):
        scan.cached_series(spark, path, "d", "2024-01-10", failing)
    scan.cached_series(spark, path, "d", "2024-01-10", refresh("2024-01-10"))
    scan.cached_series(spark, path, "d", "2024-01-12", refresh("2024-01-12"))
    assert calls == ["2024-01-10"]
    stale = scan.cached_series(spark, path, "d", "2024-01-20", failing)
    assert str(stale.first()["d"]) == "2024-01-10"


def test_a_refresh_that_fails_while_it_runs_leaves_the_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    days = spark.createDataFrame([("2024-01-10", 1)], "day string, v int").selectExpr("CAST(day AS DATE) AS d", "v")
    scan.cached_series(spark, path, "d", "2024-01-10", lambda: days)
    lazily = lambda: days.withColumn("v", F.expr("raise_error('source gone')").cast("int"))
    for _ in range(2):
        assert [r["v"] for r in scan.cached_series(spark, path, "d", "2024-02-01", lazily).collect()] == [1]


def test_a_refresh_may_read_its_own_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    day = lambda d: spark.createDataFrame([(d,)], "day string").selectExpr("CAST(day AS DATE) AS d")
    old = scan.cached_series(spark, path, "d", "2024-01-10", lambda: day("2024-01-10"))
    new = scan.cached_series(spark, path, "d", "2024-02-01", lambda: old.unionByName(day("2024-02-01")))
    assert sorted(str(r["d"]) for r in new.collect()) == ["2024-01-10", "2024-02-01"]
    assert old.count() == 1 and scan.cached_series(spark, path, "d", "2024-02-01", lambda: 1 / 0).count() == 2


def test_cutoff_reaches_the_scan(spark, sf):
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("ticks")
    df = scan.table_since(spark, "ticks", "ts", "2024-01-15").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "value" not in plan.split("ReadSchema")[1]


def test_publish_needs_its_columns(spark):
    with pytest.raises(ValueError, match="lacks"):
        publish.to_contract(spark.range(1), ["id", "score"])


def test_walk_is_repeatable_and_never_negative(spark):
    base = spark.createDataFrame([("a", 3.0), ("b", 500.0)], "k string, base double")
    out = random_walk_panel(base, "k", "base", "2024-01-31")
    assert out.count() == 800
    assert out.agg(F.min("rate_bps")).first()[0] >= 0
    assert out.where(F.weekday("date") > 4).count() == 0
    again = random_walk_panel(base.repartition(3), "k", "base", "2024-01-31")
    assert out.exceptAll(again).count() == 0


def test_later_sections_win():
    config = {"rates": {"sofr": "A", "ff": "B"}, "curve": {"ff": "C"}, "empty": None}
    assert merged(config, ["rates", "curve", "empty", "absent"]) == {"sofr": "A", "ff": "C"}
