from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.streaming import alerts


def _landed(spark, tmp_path, sf, files=4):
    """Events in several files, in order of time."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("value", F.col("value") * 4)
    bounds = [r["b"] for r in events.select(F.percentile_approx("event_id", [0.25, 0.5, 0.75]).alias("b")).select(F.explode("b").alias("b")).collect()]
    cuts = [None, *bounds, None]
    for i in range(files):
        part = events
        if cuts[i] is not None:
            part = part.where(F.col("event_id") >= cuts[i])
        if cuts[i + 1] is not None:
            part = part.where(F.col("event_id") < cuts[i + 1])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, str(tmp_path / "in")


def _land(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_level_changes_do_not_depend_on_batches(spark, tmp_path, sf):
    events, folder = _landed(spark, tmp_path, sf)
    found = []
    for n in (1, None):
        stream = alerts.events(spark, folder, "*.parquet", files_per_trigger=n)
        out = alerts.run_to_table(alerts.level_changes(stream), str(tmp_path / f"out-{n}"))
        found.append({tuple(r) for r in out.collect()})
    late = F.expr("ts < (max(ts) OVER ()) - INTERVAL 10 MINUTES")
    before = F.lag("risk_level").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    whole = alerts.levelled(events).withColumn("before", before).withColumn("settled", late).where("settled AND before <> risk_level")
    want = {tuple(r) for r in whole.select("user_id", "event_id", "before", "risk_level").collect()}
    assert found[0] == found[1] == want and want


def test_a_late_row_takes_its_place_in_event_order(spark, tmp_path):
    out = str(tmp_path / "out")

    def run(late="8 hours"):
        stream = alerts.events(spark, str(tmp_path / "in"), "*.parquet")
        return {tuple(r)[1:] for r in alerts.run_to_table(alerts.level_changes(stream, late), out).collect()}

    _land(spark, tmp_path, [(1, "2024-01-01 10:00:00", 1, "a", 310.0, "")])
    assert run() == set()
    _land(spark, tmp_path, [(2, "2024-01-01 05:00:00", 1, "a", 1.0, ""), (3, "2024-01-01 12:00:00", 1, "a", 310.0, "")])
    assert run() == set()
    _land(spark, tmp_path, [(4, "2024-01-02 12:00:00", 2, "a", 1.0, "")])
    assert run() == {(1, "LOW", "HIGH")}


def test_nothing_new_adds_nothing(spark, tmp_path, sf):
    _, folder = _landed(spark, tmp_path, sf)
    out = str(tmp_path / "rows")
    first = alerts.run_to_table(alerts.actionable(alerts.events(spark, folder, "*.parquet")), out).count()
    again = alerts.run_to_table(alerts.actionable(alerts.events(spark, folder, "*.parquet")), out).count()
    assert first == again > 0


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    def land(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    out = str(tmp_path / "out")

    def run():
        stream = alerts.events(spark, str(tmp_path / "in"), "*.parquet")
        return {(str(r["window_start"]), r["n"]) for r in alerts.run_to_table(alerts.alert_counts(stream), out).collect()}

    land([(1, "2024-01-01 00:10:00", 1, "a", 1.0, ""), (2, "2024-01-01 05:00:00", 1, "a", 1.0, "")])
    assert run() == {("2024-01-01 00:00:00", 1)}
    land([(3, "2024-01-01 00:20:00", 1, "a", 1.0, ""), (4, "2024-01-01 09:00:00", 1, "a", 1.0, "")])
    assert run() == {("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 1)}
